"""The append-only event log: validation, append, reads, versions, upcasting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefold.functions.text import is_filled
from lorefold.session import cut

REQUIRED_TEXTS = ("event_id", "type", "aggregate_type", "aggregate_id", "capture_id", "provider", "model_version")


def event_violations() -> Column:
    """Names of the fields that an event violates, in order; empty for a good event."""
    checks = [F.when(~is_filled(F.col(c)), c) for c in REQUIRED_TEXTS]
    checks.append(F.when(F.coalesce(F.col("version") < 1, F.lit(True)), "version"))
    checks.append(F.when(F.coalesce(F.col("aggregate_version") < 0, F.lit(True)), "aggregate_version"))
    checks.append(F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)) | F.coalesce(F.isnan("confidence"), F.lit(False)), "confidence"))
    return F.array_compact(F.array(*checks))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good events, bad events with ``violations``)."""
    marked = events.withColumn("violations", event_violations())
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def first_deliveries(log: DataFrame) -> DataFrame:
    """One row per event id: that of the smallest position. Rows without an event id are left out."""
    return log.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.min_by(F.struct(*[c for c in log.columns if c != "event_id"]), "position").alias("r")).select("event_id", "r.*").select(*log.columns)


def append_events(log: DataFrame, arriving: DataFrame, order_by: str = "event_id") -> DataFrame:
    """The rows that appending ``arriving`` adds to ``log``, with their positions.

    Malformed events are refused, events whose id is stored or repeated are
    ignored, the first to arrive counting. Positions go on from the last one in
    the order of ``order_by``, ties by event id: rows are put into ranges of
    that order, and the sizes of the ranges before give each its offset, so
    numbering needs no sort in one task.
    """
    good, _ = split_valid(arriving)
    first = good.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in good.columns if c != "event_id"]), order_by).alias("r")).select("event_id", "r.*")
    fresh = first.join(log.select("event_id").distinct(), "event_id", "left_anti")
    start = log.agg(F.coalesce(F.max("position"), F.lit(0)).alias("start"))
    keys = dict.fromkeys((order_by, "event_id"))
    ranged = cut(fresh.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("range").orderBy(*keys))
    return (
        ranged.withColumn("within", within).join(F.broadcast(offsets), "range").join(F.broadcast(start))
        .withColumn("position", F.col("start") + F.coalesce("before", F.lit(0)) + F.col("within"))
        .drop("range", "within", "n", "before", "start")
    )


def read_forward(log: DataFrame, position: int, limit: int = -1) -> DataFrame:
    """Events after ``position`` in order; all for a negative limit."""
    rows = log.filter(F.col("position") > position).orderBy("position", "event_id")
    return rows if limit < 0 else rows.limit(limit)


def current_versions(log: DataFrame) -> DataFrame:
    """(aggregate_id, next_version): the version the next event of each aggregate has to expect."""
    return log.groupBy("aggregate_id").agg((F.max("aggregate_version") + 1).alias("next_version"))


def stale_commands(commands: DataFrame, log: DataFrame) -> DataFrame:
    """Commands with ``current_version`` and ``is_stale``: what they expect is no longer so. Unknown aggregates are at 0."""
    return (
        commands.join(current_versions(log), "aggregate_id", "left")
        .withColumn("current_version", F.coalesce("next_version", F.lit(0)))
        .withColumn("is_stale", F.col("current_version") != F.col("expected_version"))
        .drop("next_version")
    )


def upcast(events: DataFrame, current: dict[str, int], steps: dict[tuple[str, int], Callable[[Column], Column]]) -> DataFrame:
    """Payloads brought to the current version of their type, step by step.

    A missing step or a version from the future is an error; a type that isn't
    declared passes unchanged.
    """
    for version in range(1, max(current.values(), default=1)):
        for kind, top in current.items():
            if version >= top:
                continue
            here = (F.col("type") == kind) & (F.col("version") == version)
            step = steps.get((kind, version))
            new = step(F.col("payload")) if step else F.raise_error(F.concat(F.lit(f"no step from {kind} version {version}"), F.col("event_id"))).cast("string")
            events = events.withColumn("payload", F.when(here, new).otherwise(F.col("payload"))).withColumn("version", F.when(here, version + 1).otherwise(F.col("version")))
    future = F.lit(False)
    for kind, top in current.items():
        future = future | ((F.col("type") == kind) & (F.col("version") > top))
    return events.withColumn("payload", F.when(future, F.raise_error(F.lit("version from the future")).cast("string")).otherwise(F.col("payload")))
