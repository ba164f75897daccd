"""Validity history of entity attributes, kept as checkpoints and patches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorefold.operators.entity_changes import MERGE, field_changes
from lorefold.session import cut

#: Changes of one entity from which on it has checkpoints, and about as many lie between two of them.
CHECKPOINT_CHANGES = 2048
#: Time quantiles from which the places of checkpoints are taken; an entity has no more segments than this.
QUANTILES = 256
#: Entities with checkpoints up to which their few boundaries are broadcast.
SMALL_ROWS = 10_000


@dataclass
class HistoryStore:
    """Checkpoint-delta storage. The changes of a large entity are cut into segments of time.

    patches: (aggregate_id, segment, field_name, at_us, value) — one attribute
    change each, null value for a cleared field.
    checkpoints: (aggregate_id, segment, field_name, value, since_us) — the full
    version of the entity when a segment begins: every field held then.
    last_segments: (aggregate_id, last_segment) — where the periods that still hold end up.
    removals: (aggregate_id, removed_us) — entities that were merged away.
    """

    patches: DataFrame
    checkpoints: DataFrame
    last_segments: DataFrame
    removals: DataFrame


def _segmented(patches: DataFrame, checkpoint_changes: int) -> DataFrame:
    """Patches with ``segment``, a stretch of the entity's time; entities of few changes have one."""
    many = patches.groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("changes")).filter(F.col("changes") > checkpoint_changes)
    many = cut(many)
    few_of_them = many.count() <= SMALL_ROWS
    small = F.broadcast if few_of_them else lambda df: df
    fractions = [i / QUANTILES for i in range(1, QUANTILES)]
    every = F.greatest(F.lit(1), F.floor(F.lit(QUANTILES * checkpoint_changes) / F.col("changes")))
    bounds = (
        patches.select("aggregate_id", "at_us").join(small(many), "aggregate_id").groupBy("aggregate_id")
        .agg(F.percentile_approx("at_us", fractions, 10_000).alias("q"), F.first("changes").alias("changes"))
        .select("aggregate_id", F.array_distinct(F.filter("q", lambda b, i: (i + 1) % every == 0)).alias("bounds"))
    )
    bounds = cut(bounds)
    placed = patches.join(small(bounds), "aggregate_id", "left")
    return placed.withColumn("segment", F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col("at_us"))), F.lit(0))).drop("bounds")


def build_store(log: DataFrame, checkpoint_changes: int = CHECKPOINT_CHANGES) -> HistoryStore:
    """The store of a log. Its patches are written to the shared checkpoint folder."""
    standing = (
        field_changes(log, with_values=True)
        .groupBy("aggregate_id", "aggregate_version")
        .agg(F.min(F.struct("position", "event_id", "action", "field", "value", "at_us")).alias("e"))
        .select("aggregate_id", "aggregate_version", "e.*")
        .filter(F.col("action").isin("S", "C", MERGE) & F.col("at_us").isNotNull())
    )
    # of several changes of a field at one instant the last version counts
    patches = cut(
        standing.groupBy("aggregate_id", "field", "at_us", (F.col("action") == MERGE).alias("is_merge"))
        .agg(F.max(F.struct("aggregate_version", "value")).alias("e"))
        .select(
            "aggregate_id",
            "is_merge",
            F.col("field").alias("field_name"),
            "at_us",
            F.col("e.value").alias("value"),
        )
    )
    removals = (
        patches.filter("is_merge").groupBy(F.col("field_name").alias("aggregate_id")).agg(F.min("at_us").alias("removed_us"))
    )
    patches = _segmented(patches.filter("NOT is_merge").drop("is_merge"), checkpoint_changes)

    # what each segment leaves a field with, and since when if it began there
    last = patches.groupBy("aggregate_id").agg(F.max("segment").alias("last_segment"))
    several = last.filter("last_segment > 0")
    inside = Window.partitionBy("aggregate_id", "segment", "field_name").orderBy("at_us")
    summary = (
        patches.join(several, "aggregate_id").withColumn("nth", F.row_number().over(inside))
        .withColumn("turn", (F.col("nth") == 1) | ~F.lag("value").over(inside).eqNullSafe(F.col("value")))
        .groupBy("aggregate_id", "segment", "field_name")
        .agg(F.max_by("value", "at_us").alias("value"), F.max(F.when(F.col("turn"), F.col("at_us"))).alias("run_us"), F.count_if("turn").alias("runs"))
    )
    # full versions: every field of the entity at the start of every segment, carried on from the one before
    fields = summary.select("aggregate_id", "field_name").distinct()
    grid = several.select("aggregate_id", F.explode(F.sequence(F.lit(0), F.col("last_segment"))).alias("segment")).join(fields, "aggregate_id")
    across = Window.partitionBy("aggregate_id", "field_name").orderBy("segment")
    up_to = across.rowsBetween(Window.unboundedPreceding, -1)
    changed = F.col("runs").isNotNull()
    known = grid.join(summary, ["aggregate_id", "segment", "field_name"], "left").withColumn("state", F.when(changed, F.struct("value")))
    known = known.withColumn("before", F.last("state", ignorenulls=True).over(up_to))
    carried = (F.col("runs") == 1) & F.col("before").isNotNull() & F.col("value").eqNullSafe(F.col("before.value"))
    checkpoints = (
        known.withColumn("since", F.when(changed & ~carried, F.col("run_us"))).withColumn("since_us", F.last("since", ignorenulls=True).over(up_to))
        .filter("before.value IS NOT NULL").select("aggregate_id", "segment", "field_name", F.col("before.value").alias("value"), "since_us")
    )
    return HistoryStore(patches, checkpoints, last, removals)


def validity_periods(store: HistoryStore) -> DataFrame:
    """(aggregate_id, field_name, value, valid_from_us, valid_to_us), -1 while it still holds.

    Every segment is folded forward from its own checkpoint. A period is put
    out by the segment in which it ends, or by the last one if it never does.
    Periods of an entity merged away end then; later ones are dropped.
    """
    states = store.checkpoints.select("aggregate_id", "segment", "field_name", "value", F.col("since_us").alias("at_us")).unionByName(
        store.patches.select("aggregate_id", "segment", "field_name", "value", "at_us")
    )
    forward = Window.partitionBy("aggregate_id", "segment", "field_name").orderBy("at_us")
    folded = (
        states.withColumn("nth", F.row_number().over(forward))
        .withColumn("previous", F.lag("value").over(forward))
        .filter((F.col("nth") == 1) | ~F.col("previous").eqNullSafe(F.col("value")))
        .withColumn("until", F.lead("at_us").over(forward))
        .filter("value IS NOT NULL")
        .join(store.last_segments, "aggregate_id")
        .filter("until IS NOT NULL OR segment = last_segment")
        .select("aggregate_id", "field_name", "value", F.col("at_us").alias("valid_from_us"), F.coalesce("until", F.lit(-1)).cast("long").alias("valid_to_us"))
    )
    ended = F.col("removed_us").isNotNull() & ((F.col("valid_to_us") == -1) | (F.col("valid_to_us") > F.col("removed_us")))
    return (
        folded.join(store.removals, "aggregate_id", "left")
        .filter(F.col("removed_us").isNull() | (F.col("valid_from_us") < F.col("removed_us")))
        .withColumn("valid_to_us", F.when(ended, F.col("removed_us")).otherwise(F.col("valid_to_us")))
        .drop("removed_us")
    )


def attribute_history(log: DataFrame, checkpoint_changes: int = CHECKPOINT_CHANGES) -> DataFrame:
    """Every longest period in which a field of an entity held one value.

    Versions decide between changes of one instant, ``recorded_at`` the rest:
    changes without a time are left out, and times may fall with the versions.
    Nulls, unreadable payloads, repeated and late rows are treated as in
    ``current_fields``. A hot entity is split into segments of time, each folded
    from its own checkpoint; where the cuts are plays no part in the result. An
    empty log gives no rows.
    """
    return validity_periods(build_store(log, checkpoint_changes))
