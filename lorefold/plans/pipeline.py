"""Queries of the general data-pipeline operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorefold.operators.change_feed import current_fields
from lorefold.operators.history import attribute_history
from lorefold.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_fields(table(spark, sf_dir, "event_log"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_history(table(spark, sf_dir, "event_log")).drop("value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p6_found": p6_found}

_STANDING = """
WITH entity_rows AS (
  SELECT * FROM event_log WHERE aggregate_type = 'Entity' AND event_id IS NOT NULL
    AND aggregate_id IS NOT NULL AND aggregate_version IS NOT NULL
), spoken AS (
  SELECT * FROM entity_rows QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY position) = 1
), standing AS (
  SELECT *, CASE WHEN json_valid(payload) THEN payload::JSON END AS doc FROM spoken
  QUALIFY row_number() OVER (PARTITION BY aggregate_id, aggregate_version ORDER BY position) = 1
), changes AS (
  SELECT aggregate_id, aggregate_version, event_id, epoch_us(recorded_at) AS at_us,
    CASE WHEN type = 'EntityCreated' AND json_extract_string(doc, '$.name') IS NOT NULL THEN 'name'
         WHEN type IN ('FieldSet', 'FieldCleared') THEN json_extract_string(doc, '$.field') END AS field_name,
    type <> 'FieldCleared' AS is_set,
    CASE WHEN type = 'EntityCreated' THEN 's:' || json_extract_string(doc, '$.name')
         WHEN type = 'FieldSet' AND json_extract_string(doc, '$.value.precision') IS NOT NULL
           THEN 'd:' || coalesce(json_extract_string(doc, '$.value.timestamp'), '') || '|' || json_extract_string(doc, '$.value.precision')
         WHEN type = 'FieldSet' THEN 's:' || coalesce(json_extract_string(doc, '$.value'), '') END AS value
  FROM standing WHERE doc IS NOT NULL AND type IN ('EntityCreated', 'FieldSet', 'FieldCleared')
), removed AS (
  SELECT json_extract_string(doc, '$.mergedId') AS aggregate_id, min(epoch_us(recorded_at)) AS removed_us
  FROM standing WHERE type = 'EntitiesMerged' AND doc IS NOT NULL GROUP BY 1
)
"""

ORACLE: dict[str, str] = {
    "p2_found": _STANDING
    + """
SELECT aggregate_id, field_name, event_id FROM (
  SELECT * FROM changes WHERE field_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY aggregate_id, field_name ORDER BY aggregate_version DESC) = 1)
WHERE is_set AND aggregate_id NOT IN (SELECT aggregate_id FROM removed WHERE aggregate_id IS NOT NULL)
""",
    "p6_found": _STANDING
    + """
, instants AS (
  SELECT * FROM changes WHERE field_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY aggregate_id, field_name, at_us ORDER BY aggregate_version DESC) = 1
), turns AS (
  SELECT * FROM (SELECT *, lag(value) OVER w AS previous, row_number() OVER w AS nth FROM instants
                 WINDOW w AS (PARTITION BY aggregate_id, field_name ORDER BY at_us))
  WHERE nth = 1 OR previous IS DISTINCT FROM value
), periods AS (
  SELECT aggregate_id, field_name, value, at_us AS valid_from_us,
    coalesce(lead(at_us) OVER (PARTITION BY aggregate_id, field_name ORDER BY at_us), -1) AS valid_to_us
  FROM turns
)
SELECT p.aggregate_id, field_name, valid_from_us,
  CASE WHEN removed_us IS NOT NULL AND (valid_to_us = -1 OR valid_to_us > removed_us) THEN removed_us ELSE valid_to_us END AS valid_to_us
FROM periods p LEFT JOIN removed r ON p.aggregate_id = r.aggregate_id
WHERE value IS NOT NULL AND (removed_us IS NULL OR valid_from_us < removed_us)
""",
}
