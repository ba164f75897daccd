"""Current state of a table from its change feed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorefold.operators.entity_changes import MERGE, OTHER, field_changes

#: Versions of one aggregate that a replay task takes in one go; longer feeds are split at its multiples.
SEGMENT_VERSIONS = 4096

_EFFECT = pa.schema([
    ("aggregate_id", pa.string()),
    ("segment", pa.int64()),
    ("field_name", pa.string()),
    ("action", pa.string()),
    ("event_id", pa.string()),
])


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State machine over rows sorted by aggregate, segment, version and position.

    Holds the partial state of one aggregate segment: the last effect on each
    field. A version that was already applied is skipped.
    """
    key: tuple | None = None
    applied = None
    state: dict[str, tuple[str, str]] = {}
    out: list[tuple] = []

    def flush() -> None:
        if key is not None:
            out.extend((key[0], key[1], field, action, event) for field, (action, event) in state.items())

    def drain() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist([dict(zip(_EFFECT.names, r, strict=True)) for r in out], schema=_EFFECT)
        out.clear()
        return batch

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("aggregate_id", "segment", "aggregate_version", "action", "field", "event_id")]
        for aggregate, segment, version, action, field, event in zip(*columns, strict=True):
            if key != (aggregate, segment):
                flush()
                key, applied, state = (aggregate, segment), None, {}
            if version == applied:
                continue
            applied = version
            if action == MERGE:
                out.append((field, -1, None, MERGE, event))
            elif action != OTHER:
                state[field] = (action, event)
        if len(out) > 20_000:
            yield drain()
    flush()
    if out:
        yield drain()


def current_fields(log: DataFrame, segment_versions: int = SEGMENT_VERSIONS) -> DataFrame:
    """The fields each entity holds after all changes: (aggregate_id, field_name, event_id).

    ``event_id`` is the last standing event that set the field. Per-key ordered
    replay: rows are partitioned by aggregate and version segment, sorted by
    version and position within the partition, and applied by a state machine
    which skips versions it has applied. Segments keep a hot aggregate from
    landing in one task: each gives its last effect per field, and the effects
    are applied in segment order afterwards, on at most one row per field and
    segment.

    Nulls: rows without event id, aggregate id or version are ignored; null
    positions come last; unreadable payloads change nothing but take their
    version. Repeated rows and redeliveries are one event. Entities merged away
    hold nothing. An empty log gives no rows; extra columns are not read.
    """
    rows = field_changes(log, with_values=False).withColumn(
        "segment", F.floor(F.col("aggregate_version") / segment_versions).cast("long")
    )
    ordered = rows.select("aggregate_id", "segment", "aggregate_version", "position", "action", "field", "event_id")
    ordered = ordered.repartition("aggregate_id", "segment").sortWithinPartitions(
        "aggregate_id", "segment", "aggregate_version", "position", "event_id"
    )
    effects = ordered.mapInArrow(
        _replay, "aggregate_id string, segment long, field_name string, action string, event_id string"
    )
    whole = Window.partitionBy("aggregate_id")
    return (
        effects.groupBy("aggregate_id", "field_name")
        .agg(F.max(F.struct("segment", "action", "event_id")).alias("last"))
        .withColumn("merged", F.max(F.col("last.action") == MERGE).over(whole))
        .filter(~F.col("merged") & (F.col("last.action") == "S"))
        .select("aggregate_id", "field_name", F.col("last.event_id").alias("event_id"))
    )
