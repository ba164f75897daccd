"""Captures: identity, ingestion, corrections, missing events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.functions.ids import capture_id, content_hash, iso_instant
from lorefold.functions.text import is_filled


def with_identity(arriving: DataFrame) -> DataFrame:
    """Adds content_hash and capture_id to (source, text, source_timestamp)."""
    hashed = arriving.withColumn("content_hash", content_hash(F.col("text")))
    return hashed.withColumn("capture_id", capture_id(F.col("source"), iso_instant(F.col("source_timestamp")), F.col("content_hash")))


def ingest(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """The captures that ``arriving`` adds: first write wins, what is stored or repeated is ignored."""
    fresh = with_identity(arriving.filter("text IS NOT NULL AND source IS NOT NULL AND source_timestamp IS NOT NULL"))
    first = fresh.groupBy("capture_id").agg(F.min(F.struct("source", "text", "source_timestamp", "content_hash")).alias("r")).select("capture_id", "r.*")
    return first.join(stored.select("capture_id").distinct(), "capture_id", "left_anti")


def without_event(captures: DataFrame, log: DataFrame) -> DataFrame:
    """Stored captures whose CaptureIngested event is missing from the log."""
    known = log.filter("type = 'CaptureIngested'").select(F.col("aggregate_id").alias("capture_id")).distinct()
    return captures.join(known, "capture_id", "left_anti")


def effective_text(captures: DataFrame) -> DataFrame:
    """(capture_id, text): the correction if there is one, else the raw text; one row for each capture."""
    return captures.groupBy("capture_id").agg(F.min(F.struct(F.coalesce("corrected_text", "raw_text").alias("t"))).alias("r")).select("capture_id", F.col("r.t").alias("text"))


def record_corrections(captures: DataFrame, corrections: DataFrame) -> DataFrame:
    """Captures with the first correction of each voice capture that has none; blank ones are refused.

    corrections: (capture_id, corrected_text, corrected_at).
    """
    first = corrections.filter(F.length(F.trim("corrected_text")) > 0).groupBy("capture_id").agg(F.min(F.struct("corrected_at", "corrected_text")).alias("c"))
    may = (F.col("source") == "voice") & F.col("corrected_text").isNull()
    return captures.join(first, "capture_id", "left").withColumn("corrected_text", F.when(may, F.col("c.corrected_text")).otherwise(F.col("corrected_text"))).drop("c")


def get(captures: DataFrame, capture_id: str) -> DataFrame:
    """The capture of an id; nothing for an unknown one."""
    return captures.filter(F.col("capture_id") == capture_id).limit(1)


def request_violations() -> Column:
    """Names of what is wrong with a request (source, text, source_timestamp as text); empty for a good one.

    A source is typed or voice, a text is more than white space, a timestamp is
    an ISO instant with date and time.
    """
    stamp = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("source").isin("typed", "voice"), F.lit(False)), "source"), F.when(~is_filled(F.col("text")), "text"),
        F.when(~F.coalesce(F.col("source_timestamp").rlike(stamp), F.lit(False)), "source_timestamp"),
    ))


def append_only_violations(before: DataFrame, after: DataFrame, key: str, may_fill: str | None = None) -> DataFrame:
    """(key, violation): rows of ``before`` that ``after`` lacks (removed) or has otherwise (changed).

    Only ``may_fill`` may go from null to a value, all else staying as it was.
    """
    columns = [c for c in before.columns if c not in (key, may_fill)]
    own = before.select(F.col(key), F.struct(*columns).alias("was"), *([F.col(may_fill).alias("held")] if may_fill else [])).distinct()
    now = after.select(F.col(key), F.struct(*columns).alias("is"), *([F.col(may_fill).alias("holds")] if may_fill else [])).distinct()
    same = F.col("was").eqNullSafe(F.col("is"))
    if may_fill:
        same = same & (F.col("held").isNull() | F.col("held").eqNullSafe(F.col("holds")))
    matched = own.join(now, key, "left").groupBy(key).agg(F.max(F.col("is").isNotNull()).alias("there"), F.max(same).alias("same"))
    return matched.filter("NOT there OR NOT same").select(key, F.when(~F.col("there"), "removed").otherwise("changed").alias("violation"))
