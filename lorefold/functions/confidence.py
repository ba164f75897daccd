"""Confidences, bands and dispositions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the bands, and the bootstrap and sampling steps.
AUTO_FROM, REVIEW_FROM = 0.9, 0.5
BOOTSTRAP_CORRECTIONS, BOOTSTRAP_CAP = 50, 0.9
SAMPLING = ((500, 0.05), (50, 0.1), (0, 0.2))
#: Dispositions from the least to the most restrictive.
DISPOSITIONS = ("auto_apply", "needs_review", "discard")


def clamp_unit(value: Column) -> Column:
    """Into [0, 1]; null and NaN are 0.5."""
    return F.when(value.isNull() | F.isnan(value), F.lit(0.5)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def combine(extraction: Column, resolution: Column) -> Column:
    return extraction * F.coalesce(resolution, F.lit(1.0))


def band_for(confidence: Column, auto_from: Column | float = AUTO_FROM, review_from: Column | float = REVIEW_FROM) -> Column:
    return F.when(confidence >= auto_from, "auto_apply").when(confidence >= review_from, "needs_review").otherwise("discard")


def _rank(disposition: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DISPOSITIONS)), disposition)


def most_restrictive(a: Column, b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DISPOSITIONS)), F.greatest(_rank(a), _rank(b)).cast("int"))


def no_more_permissive(candidate: Column, original: Column) -> Column:
    return _rank(candidate) >= _rank(original)


def sampling_rate(corrections: Column) -> Column:
    step = F.when(corrections >= SAMPLING[0][0], SAMPLING[0][1])
    for least, rate in SAMPLING[1:]:
        step = step.when(corrections >= least, rate)
    return step.otherwise(SAMPLING[-1][1])


def draw(key: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
