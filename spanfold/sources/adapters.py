"""The driver's tables as events, by rules that SQL can state too (see spanfold.catalog)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import conform

BATCH_TIME = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _label(value, is_global: bool):
    return F.struct(value.alias("value"), F.array().cast("array<string>").alias("values"), F.lit(is_global).alias("global"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as transactions: k (0-99 in props) sets weight, name and the global label tier."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").withColumns({"k": k, "u": F.col("user_id"), "t": F.col("ts").cast("timestamp")})
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "unknown").otherwise("success")
    no_drops = F.array().cast("array<struct<destination_service_resource:string,service_target_type:string,service_target_name:string,outcome:string,duration:struct<count:bigint,sum_ns:bigint>>>")
    drops = F.transform(F.sequence(F.lit(1), F.col("k") % 4), lambda i: F.struct(F.concat(F.lit("drop"), ((F.col("k") + i) % 7).cast("string")).alias("destination_service_resource"), F.lit("").alias("service_target_type"), F.lit("").alias("service_target_name"), F.lit("success").alias("outcome"), F.struct((i + 1).cast("bigint").alias("count"), (i * 1000000).cast("bigint").alias("sum_ns")).alias("duration")))
    return conform(
        rows.select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit("t"), F.col("u") % 2).alias("cm_id"),
            F.lit(BATCH_TIME).cast("timestamp").alias("processing_time"),
            F.lit("transaction").alias("event_type"),
            F.col("t").alias("timestamp"),
            F.when(F.col("k") % 5 == 0, F.lit("")).otherwise("p").alias("parent_id"),
            F.struct((F.col("value") * 1e6).cast("bigint").alias("duration_ns"), outcome.alias("outcome"), F.col("t").alias("received")).alias("event"),
            F.struct(F.concat(F.lit("agent"), F.col("u") % 4).alias("name")).alias("agent"),
            F.struct(F.concat(F.lit("svc"), F.col("u") % 20).alias("name"), F.element_at(F.array(F.lit("dev"), F.lit("qa"), F.lit("prod")), (F.col("u") % 3 + 1).cast("int")).alias("environment"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("struct<name:string,version:string>").alias("language"), F.lit(None).cast("struct<name:string,version:string>").alias("runtime"), F.lit(None).cast("struct<name:string>").alias("node"), F.lit(None).cast("struct<type:string,name:string>").alias("target")).alias("service"),
            F.struct(F.when(F.col("k") % 3 == 0, F.lit(True)).when(F.col("k") % 3 == 1, F.lit(False)).alias("cold_start"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("trigger_type")).alias("faas"),
            F.struct(F.concat(F.col("event_type"), F.lit("/"), F.col("k") % 25).alias("name"), F.col("event_type").alias("type"), F.lit("").alias("result"), (F.lit(1.0) + (F.col("k") % 4) * 0.5).alias("representative_count"), F.when(F.col("k") % 4 == 0, no_drops).otherwise(drops).alias("dropped_spans_stats")).alias("transaction"),
            F.create_map(F.lit("tier"), _label((F.col("k") % 3).cast("string"), True), F.lit("user"), _label(F.col("u").cast("string"), False)).alias("labels"),
        )
    )


def exit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as composite exit spans, in the order of a key that is unique."""
    rows = table(spark, sf_dir, "lineitem")
    # Order and line first; (order, line) repeats, so a mix of the other columns tells such rows apart.
    mix = (F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_quantity").cast("bigint") * 7 + F.round(F.col("l_extendedprice") * 100).cast("bigint") * 13) % 1000003
    sequence = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000003 + mix
    outcome = F.when(F.col("l_returnflag") == "R", "failure").when(F.col("l_returnflag") == "A", "success").otherwise("unknown")
    return conform(
        rows.select(
            sequence.alias("seq"),
            F.lit("t0").alias("cm_id"),
            F.lit(BATCH_TIME).cast("timestamp").alias("processing_time"),
            F.lit("span").alias("event_type"),
            F.col("l_shipdate").cast("timestamp").alias("timestamp"),
            F.struct((F.col("l_extendedprice") * 1000).cast("bigint").alias("duration_ns"), outcome.alias("outcome"), F.col("l_shipdate").cast("timestamp").alias("received")).alias("event"),
            F.struct(F.lit("java").alias("name")).alias("agent"),
            F.struct(F.concat(F.lit("supp"), F.col("l_suppkey") % 50).alias("name"), F.lit("prod").alias("environment"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("struct<name:string,version:string>").alias("language"), F.lit(None).cast("struct<name:string,version:string>").alias("runtime"), F.lit(None).cast("struct<name:string>").alias("node"), F.when(F.col("l_linenumber") % 3 == 0, F.struct(F.lit("db").alias("type"), F.concat(F.lit("t"), F.col("l_linenumber")).alias("name"))).alias("target")).alias("service"),
            F.struct(F.concat(F.lit("part"), F.col("l_partkey") % 40).alias("name"), F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.lit(1.0) + (F.col("l_partkey") % 2)).alias("representative_count"), F.struct(F.when(F.col("l_linestatus") == "O", F.concat(F.lit("res"), F.col("l_returnflag"))).otherwise("").alias("resource")).alias("destination_service"), F.when(F.col("l_partkey") % 2 == 0, F.struct(F.col("l_quantity").cast("bigint").alias("count"), (F.col("l_quantity") * 2.0).alias("sum_ms"))).alias("composite")).alias("span"),
        )
    )


def wide_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` with customer, nation and region as transactions with many key fields."""
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    nothing = F.lit(None).cast("string")
    day = F.col("o_orderdate").cast("timestamp")
    return conform(
        rows.select(
            F.col("o_orderkey").alias("seq"),
            F.lit("t0").alias("cm_id"),
            F.lit(BATCH_TIME).cast("timestamp").alias("processing_time"),
            F.lit("transaction").alias("event_type"),
            day.alias("timestamp"),
            F.lit("p").alias("parent_id"),
            F.struct((F.col("o_custkey") % 1000 * 1000000).cast("bigint").alias("duration_ns"), F.when(F.col("o_orderstatus") == "F", "failure").otherwise("success").alias("outcome"), day.alias("received")).alias("event"),
            F.struct(F.lit("go").alias("name")).alias("agent"),
            F.struct(F.col("c_mktsegment").alias("name"), F.lit("prod").alias("environment"), F.col("o_orderstatus").alias("version"), F.struct(F.lit("go").alias("name"), F.lit("1").alias("version")).alias("language"), F.lit(None).cast("struct<name:string,version:string>").alias("runtime"), F.lit(None).cast("struct<name:string>").alias("node"), F.lit(None).cast("struct<type:string,name:string>").alias("target")).alias("service"),
            F.struct(F.col("r_name").alias("hostname"), nothing.alias("name"), F.lit(None).cast("struct<platform:string>").alias("os")).alias("host"),
            F.struct(F.lit("aws").alias("provider"), F.col("r_name").alias("region"), F.col("n_name").alias("availability_zone"), nothing.alias("service_name"), nothing.alias("account_id"), nothing.alias("account_name"), nothing.alias("machine_type"), nothing.alias("project_id"), nothing.alias("project_name")).alias("cloud"),
            F.struct(F.col("o_orderpriority").alias("name"), F.lit("order").alias("type"), F.lit("").alias("result"), F.lit(1.0).alias("representative_count"), F.lit(None).cast("array<struct<destination_service_resource:string,service_target_type:string,service_target_name:string,outcome:string,duration:struct<count:bigint,sum_ns:bigint>>>").alias("dropped_spans_stats")).alias("transaction"),
        )
    )
