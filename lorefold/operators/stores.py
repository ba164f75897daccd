"""Dispositions, the review queue, briefs and their windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.functions.dates import discard_expiry


def with_expiry(dispositions: DataFrame) -> DataFrame:
    """Adds ``expires_at`` to discards: thirty days after the decision."""
    return dispositions.withColumn("expires_at", F.when(F.col("disposition") == "discard", discard_expiry(F.col("decided_at"))))


def live_discards(dispositions: DataFrame, as_of: Column) -> DataFrame:
    return dispositions.filter((F.col("disposition") == "discard") & (F.col("expires_at") > as_of))


def without_expired(dispositions: DataFrame, as_of: Column) -> DataFrame:
    """What is left after purging: everything but discards that expired at ``as_of`` or before."""
    return dispositions.filter(~F.coalesce((F.col("disposition") == "discard") & (F.col("expires_at") <= as_of), F.lit(False)))


def append_new(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """The arriving rows that insert-ignore adds: one for each key that isn't stored."""
    return arriving.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")


def review_queue(entries: DataFrame, adjudications: DataFrame, disposition: str | None = None, only_open: bool = True) -> DataFrame:
    """Queue entries with their latest adjudication, newest first; optionally of one disposition, optionally open ones."""
    latest = adjudications.groupBy("proposal_id").agg(F.max("adjudicated_at").alias("adjudicated_at"))
    rows = entries.join(latest, "proposal_id", "left")
    if disposition is not None:
        rows = rows.filter(F.col("disposition") == disposition)
    if only_open:
        rows = rows.filter("adjudicated_at IS NULL")
    return rows.orderBy(F.desc("queued_at"), F.desc("proposal_id"))


def due_windows(existing: DataFrame, kind: str, now: date, zone_date: date | None = None) -> DataFrame:
    """(brief_id, kind, covers_to): windows that should have a brief and have none, oldest first.

    Daily ones of the last two local dates, weekly ones of the Mondays of the last seven.
    """
    today, back = zone_date or now, 2 if kind == "daily" else 7
    days = existing.sparkSession.range(back).select(F.date_sub(F.lit(today), F.col("id").cast("int")).alias("d"))
    if kind == "weekly":
        days = days.filter(F.dayofweek("d") == 2)
    windows = days.select(F.concat(F.lit(f"{kind}-"), F.date_format("d", "yyyy-MM-dd")).alias("brief_id"), F.lit(kind).alias("kind"), F.col("d").alias("covers_to"))
    return windows.join(existing.select("brief_id").distinct(), "brief_id", "left_anti").orderBy("covers_to")


def brief_sections(sections: DataFrame) -> DataFrame:
    """(heading, prose): each section as a heading and a list, ``## heading`` and ``- name`` lines."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: F.concat(F.lit("- "), r["name"])), "\n")
    return sections.groupBy("heading").agg(F.concat(F.lit("## "), F.first("heading"), F.lit("\n"), lines).alias("prose"))
