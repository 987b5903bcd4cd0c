"""Readers and sinks of events, partials and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import event_schema


def events_json(spark: SparkSession, path: str) -> DataFrame:
    """Events as JSON lines, in the event schema (never inferred)."""
    return spark.read.schema(event_schema()).json(path)


def events_parquet(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path))


def events_stream(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(event_schema()).format(kind).load(path)


def conform(events: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Any subset of the event schema's top-level columns, the absent ones null."""
    have, schema = dict(events.dtypes), schema or event_schema()
    return events.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def console(documents: DataFrame, interval: int) -> None:
    """The default sink."""
    documents.show(truncate=False)


def parquet_sink(folder: str):
    """A sink that appends to a table divided by metricset and interval."""

    def write(documents: DataFrame, interval: int) -> None:
        documents.write.mode("append").partitionBy("metricset_name", "metricset_interval").parquet(folder)

    return write


def json_sink(folder: str):
    def write(documents: DataFrame, interval: int) -> None:
        documents.write.mode("append").json(f"{folder}/interval={interval}")

    return write


def noop_sink(documents: DataFrame, interval: int) -> None:
    documents.write.format("noop").mode("overwrite").save()


class MemorySink:
    """Collects documents, for tests."""

    def __init__(self) -> None:
        self.rows: list = []

    def __call__(self, documents: DataFrame, interval: int) -> None:
        self.rows += documents.collect()
