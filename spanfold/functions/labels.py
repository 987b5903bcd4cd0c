"""Global labels: the canonical text that takes part in the service key, and its way back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

_TEXT = ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType()), StructField("values", ArrayType(StringType()))]))
_NUMBER = ArrayType(StructType([StructField("key", StringType()), StructField("value", DoubleType()), StructField("values", ArrayType(DoubleType()))]))
SCHEMA = StructType([StructField("labels", _TEXT), StructField("numeric_labels", _NUMBER)])


def _entries(labels: Column, kind: str) -> Column:
    kept = F.filter(F.map_entries(labels), lambda e: e["value"]["global"])
    rows = F.transform(kept, lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"]["value"], F.lit("" if kind == "string" else 0.0)).alias("value"), F.coalesce(e["value"]["values"], F.array().cast(f"array<{kind}>")).alias("values")))
    return F.coalesce(F.array_sort(rows, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), F.array().cast(f"array<struct<key:string,value:{kind},values:array<{kind}>>>"))


def canonical(labels: Column, numeric_labels: Column) -> Column:
    """JSON of the global labels sorted by key, values in their own order; the empty string if there are none."""
    text, number = _entries(labels, "string"), _entries(numeric_labels, "double")
    return F.when((F.size(text) == 0) & (F.size(number) == 0), F.lit("")).otherwise(F.to_json(F.struct(text.alias("labels"), number.alias("numeric_labels"))))


def parse(text: Column) -> Column:
    """struct<labels: map, numeric_labels: map> of canonical labels, null where there are none; every label is global."""
    found = F.from_json(text, SCHEMA)

    def as_map(entries):
        return F.when(F.size(entries) > 0, F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.struct(e["value"].alias("value"), e["values"].alias("values"), F.lit(True).alias("global"))))))

    return F.struct(as_map(found["labels"]).alias("labels"), as_map(found["numeric_labels"]).alias("numeric_labels"))
