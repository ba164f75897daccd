"""Reading the entity part of an event log as field changes.

Shared by the change-feed replay and the attribute history. A row counts only
if it has an event id, an aggregate id and an aggregate version; rows lacking
one of them can't be placed and change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SET, CLEAR, MERGE, OTHER = "S", "C", "M", "-"


def _text(doc: Column, path: str) -> Column:
    return F.variant_get(doc, path, "string")


def value_key(doc: Column) -> Column:
    """A text that is equal for equal values.

    Strings are compared as they are. Dates are compared by timestamp (or its
    absence) and precision; their phrase plays no part.
    """
    precision = _text(doc, "$.value.precision")
    stamp = F.coalesce(_text(doc, "$.value.timestamp"), F.lit(""))
    return F.when(
        precision.isNotNull(),
        F.concat(F.lit("d:"), stamp, F.lit("|"), precision),
    ).otherwise(F.concat(F.lit("s:"), F.coalesce(_text(doc, "$.value"), F.lit(""))))


def field_changes(log: DataFrame, with_values: bool) -> DataFrame:
    """One row per Entity event, spoken for by its row of smallest position.

    Columns: aggregate_id, aggregate_version, position, event_id, action
    (S set, C clear, M merge, - none), field, at_us, and value with
    ``with_values``. ``field`` of a merge is the id that was merged away. A
    payload that isn't a JSON object with the needed text members gives ``-``:
    the event keeps its place in the order and changes nothing. Positions that
    are null come last. Payloads are parsed before the shuffle, so that only
    the few needed members travel.
    """
    doc = F.col("__doc")
    kind = F.col("type")
    named = F.when(kind == "EntityCreated", F.when(_text(doc, "$.name").isNotNull(), F.lit("name")))
    named = named.when(kind.isin("FieldSet", "FieldCleared"), _text(doc, "$.field"))
    named = named.when(kind == "EntitiesMerged", _text(doc, "$.mergedId"))
    action = (
        F.when(F.col("field").isNull(), OTHER)
        .when(kind.isin("EntityCreated", "FieldSet"), SET)
        .when(kind == "FieldCleared", CLEAR)
        .when(kind == "EntitiesMerged", MERGE)
        .otherwise(OTHER)
    )
    touching = kind.isin("EntityCreated", "FieldSet", "FieldCleared", "EntitiesMerged")
    rows = (
        log.select(
            "position", "event_id", "type", "aggregate_type", "aggregate_id",
            "aggregate_version", "payload", "recorded_at",
        )
        .filter(
            (F.col("aggregate_type") == "Entity")
            & F.col("event_id").isNotNull()
            & F.col("aggregate_id").isNotNull()
            & F.col("aggregate_version").isNotNull()
        )
        .withColumn("__doc", F.when(touching, F.try_parse_json("payload")))
        .withColumn("field", named)
        .withColumn("action", action)
    )
    kept = {
        "aggregate_id": F.col("aggregate_id"),
        "aggregate_version": F.col("aggregate_version"),
        "action": F.col("action"),
        "field": F.when(F.col("action") != OTHER, F.col("field")),
        "at_us": F.unix_micros(F.col("recorded_at").cast("timestamp")),
    }
    if with_values:
        kept["value"] = F.when(
            F.col("action") == SET,
            F.when(kind == "EntityCreated", F.concat(F.lit("s:"), _text(doc, "$.name"))).otherwise(value_key(doc)),
        )
    rows = rows.select(
        "event_id",
        F.struct(
            F.coalesce(F.col("position"), F.lit(2**63 - 1)).alias("position"),
            *[c.alias(n) for n, c in kept.items()],
        ).alias("r"),
    )
    # two rows of one event at one position are copies of each other, or the smaller one speaks
    return rows.groupBy("event_id").agg(F.min("r").alias("r")).select("event_id", "r.*")
