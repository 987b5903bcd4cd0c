"""The event schema and the key columns: the one place that names them."""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

EVENT_DDL = """
seq bigint, cm_id string, processing_time timestamp, event_type string, timestamp timestamp, parent_id string,
event struct<duration_ns:bigint,outcome:string,received:timestamp>,
agent struct<name:string>,
service struct<name:string,environment:string,version:string,language:struct<name:string,version:string>,runtime:struct<name:string,version:string>,node:struct<name:string>,target:struct<type:string,name:string>>,
container struct<id:string>, kubernetes struct<pod_name:string>,
host struct<hostname:string,name:string,os:struct<platform:string>>,
faas struct<cold_start:boolean,id:string,name:string,version:string,trigger_type:string>,
cloud struct<provider:string,region:string,availability_zone:string,service_name:string,account_id:string,account_name:string,machine_type:string,project_id:string,project_name:string>,
transaction struct<name:string,type:string,result:string,representative_count:double,dropped_spans_stats:array<struct<destination_service_resource:string,service_target_type:string,service_target_name:string,outcome:string,duration:struct<count:bigint,sum_ns:bigint>>>>,
span struct<name:string,representative_count:double,destination_service:struct<resource:string>,composite:struct<count:bigint,sum_ms:double>>,
labels map<string,struct<value:string,values:array<string>,global:boolean>>,
numeric_labels map<string,struct<value:double,values:array<double>,global:boolean>>
"""


@cache
def event_schema() -> StructType:
    """The schema as Spark parses it, which needs a session."""
    return StructType.fromDDL(EVENT_DDL)



#: The combined key: interval, processing-time bucket, tenant, partition.
COMBINED = ("interval_s", "processing_time", "cm_id", "partition_id")
SERVICE = ("svc_timestamp", "svc_name", "svc_environment", "svc_language", "agent_name", "global_labels")

#: Transaction key columns and the event fields they come from.
TRANSACTION_FIELDS = {
    "container_id": "container.id",
    "kubernetes_pod_name": "kubernetes.pod_name",
    "service_version": "service.version",
    "service_node_name": "service.node.name",
    "service_runtime_name": "service.runtime.name",
    "service_runtime_version": "service.runtime.version",
    "service_language_version": "service.language.version",
    "host_hostname": "host.hostname",
    "host_name": "host.name",
    "host_os_platform": "host.os.platform",
    "event_outcome": "event.outcome",
    "transaction_name": "transaction.name",
    "transaction_type": "transaction.type",
    "transaction_result": "transaction.result",
    "faas_id": "faas.id",
    "faas_name": "faas.name",
    "faas_version": "faas.version",
    "faas_trigger_type": "faas.trigger_type",
    "cloud_provider": "cloud.provider",
    "cloud_region": "cloud.region",
    "cloud_availability_zone": "cloud.availability_zone",
    "cloud_service_name": "cloud.service_name",
    "cloud_account_id": "cloud.account_id",
    "cloud_account_name": "cloud.account_name",
    "cloud_machine_type": "cloud.machine_type",
    "cloud_project_id": "cloud.project_id",
    "cloud_project_name": "cloud.project_name",
}
TRANSACTION = ("trace_root", "faas_cold_start", *TRANSACTION_FIELDS)
SERVICE_TRANSACTION = ("transaction_type",)
SPAN = ("span_name", "span_outcome", "target_type", "target_name", "resource")
GROUP = {"transaction": TRANSACTION, "service_transaction": SERVICE_TRANSACTION, "service_destination": SPAN}
#: Measures of each metricset; histogram rows carry a bucket and its scaled count besides.
SUMS = {"transaction": (), "service_transaction": ("success", "failure"), "service_destination": ("count", "total")}
HISTOGRAM = {"transaction", "service_transaction"}
MAX_DROPPED_SPANS = 128
#: Arrival order is one number, seq x ORDER + pos; pos is below MAX_DROPPED_SPANS within a partition.
ORDER = 1 << 8
