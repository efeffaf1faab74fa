"""Metric exports in JSON, flattened to a row for each data point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ATTRIBUTES = "attributes array<struct<key: string, value: struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>>>"
_POINT = f"struct<timeUnixNano: string, startTimeUnixNano: string, asDouble: double, asInt: string, sum: double, count: string, {_ATTRIBUTES.replace(' ', ': ', 1)}>"
_POINTS = f"struct<dataPoints: array<{_POINT}>>"
#: The parts of an export that are read; a field beside them is ignored.
EXPORT = (
    f"resourceMetrics array<struct<resource: struct<{_ATTRIBUTES.replace(' ', ': ', 1)}>, scopeMetrics: array<struct<metrics: array<struct<"
    f"name: string, unit: string, description: string, gauge: {_POINTS}, sum: {_POINTS}, histogram: {_POINTS}>>>>>>"
)
KINDS = ("gauge", "sum", "histogram")


def _json(attributes: Column) -> Column:
    def text(a: Column) -> Column:
        v = a["value"]
        return F.struct(a["key"], F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string")))

    return F.when(F.size(attributes) > 0, F.to_json(F.map_from_entries(F.transform(attributes, text))))


def flatten_metrics(exports: DataFrame, column: str) -> DataFrame:
    """name, value, timestamp, kind, unit, description, attributes, resource_attributes, count, start_timestamp
    of each gauge, sum and histogram point of the JSON exports in ``column``; a histogram's value is its sum."""
    parsed = exports.select(F.explode(F.from_json(column, EXPORT)["resourceMetrics"]).alias("r"))
    scopes = parsed.select(_json(F.col("r.resource.attributes")).alias("resource_attributes"), F.explode("r.scopeMetrics").alias("s"))
    metrics = scopes.select("resource_attributes", F.explode("s.metrics").alias("m"))
    def tagged(kind: str) -> Column:
        points = F.coalesce(F.col(f"m.{kind}.dataPoints"), F.array().cast(f"array<{_POINT}>"))
        return F.transform(points, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p")))

    points = metrics.select("resource_attributes", "m.name", "m.unit", "m.description", F.explode(F.flatten(F.array(*map(tagged, KINDS)))).alias("t"))
    p = F.col("t.p")
    return points.select(
        "name", F.coalesce(p["asDouble"], p["asInt"].cast("double"), p["sum"]).alias("value"), p["timeUnixNano"].cast("long").alias("timestamp"), F.col("t.kind").alias("kind"), "unit", "description",
        _json(p["attributes"]).alias("attributes"), "resource_attributes", p["count"].cast("long").alias("count"), p["startTimeUnixNano"].cast("long").alias("start_timestamp"),
    )
