"""Identifiers derived from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(prefix: str, *parts: Column) -> Column:
    joined = F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(joined, 256), 1, 32))


def content_hash(raw_text: Column) -> Column:
    return F.sha2(raw_text, 256)


def iso_instant(ts: Column) -> Column:
    """UTC instant as text with milliseconds and a final Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def capture_id(source: Column, timestamp: Column, hashed: Column) -> Column:
    return _digest("cap", source, timestamp, hashed)


def proposal_id(capture: Column, stage: Column, provider: Column, model: Column, ordinal: Column) -> Column:
    return _digest("prop", capture, stage, provider, model, ordinal)


def correction_id(proposal: Column, kind: Column, target: Column, payload: Column) -> Column:
    return _digest("corr", proposal, kind, target, payload)


def duplicate_id(survivor: Column, merged: Column) -> Column:
    return _digest("dup", survivor, merged)


def event_id(capture: Column, proposal: Column, kind: Column, aggregate: Column, expected: Column, provider: Column, model: Column) -> Column:
    """The payload plays no part: two payloads of one command at one version are one event."""
    return _digest("evt", capture, proposal, kind, aggregate, expected, provider, model)
