"""Reads over the folded log: entities as the salience scorer sees them, and entity views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.operators.fold import created, field_provenance, fold_fields, fold_relations, lineage
from lorefold.operators.salience import history


def salient_entities(events: DataFrame, now: Column) -> DataFrame:
    """(entity_id, entity_type, name, status, due_at, has_outcome, last_mentioned) and the activity of entities that exist.

    Activity is that of the entity's own events; entities merged away are left out.
    """
    line = lineage(events)
    held = fold_fields(events, line)
    value = F.substring("value", 3, 1 << 20)
    when = F.try_to_timestamp(F.substring_index(value, "|", 1))
    last = lambda fields, what: F.max_by(F.when(F.col("field").isin(*fields), what), F.when(F.col("field").isin(*fields), F.col("position")))
    fields = held.groupBy("entity_id").agg(
        last(["name"], value).alias("name"), last(["status"], value).alias("status"), last(["due", "occurred_at"], when).alias("due_at"),
        F.coalesce(F.bool_or(F.col("field") == "outcome"), F.lit(False)).alias("has_outcome"),
    )
    return (
        created(events, line).select(F.col("aggregate_id").alias("entity_id"), "entity_type").join(fields, "entity_id", "left").join(history(events, now), "entity_id", "left")
        .withColumn("last_mentioned", F.col("last_at"))
    )


def _listed(rows: DataFrame, name: str, text: Column) -> DataFrame:
    return rows.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set(text)), "; ").alias(name))


def entity_views(events: DataFrame) -> DataFrame:
    """(entity_id, entity_type, fields, relations, provenance): what an entity's view shows, each as one sorted text.

    Fields are field=value, relations name:from>to of either end, provenance
    field=event. Entities that exist with nothing of a kind have an empty text.
    """
    line = lineage(events)
    fields = _listed(fold_fields(events, line), "fields", F.concat_ws("=", "field", "value"))
    provenance = _listed(field_provenance(events, line), "provenance", F.concat_ws("=", "field", "event_id"))
    edges = fold_relations(events, line)
    ends = edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("entity_id"), "relation", "from_id", "to_id")
    related = _listed(ends, "relations", F.concat(F.col("relation"), F.lit(":"), F.col("from_id"), F.lit(">"), F.col("to_id")))
    views = created(events, line).select(F.col("aggregate_id").alias("entity_id"), "entity_type")
    for part in (fields, related, provenance):
        views = views.join(part, "entity_id", "left")
    return views.withColumns({c: F.coalesce(c, F.lit("")) for c in ("fields", "relations", "provenance")})


def serialised(events: DataFrame) -> DataFrame:
    """(entity_id, digest): the canonical text of each entity's view, as a digest.

    Two folds of one log agree if and only if these rows do; the order in which
    events came to be folded, or files were read, plays no part.
    """
    views = entity_views(events)
    return views.select("entity_id", F.sha2(F.concat_ws("|", "entity_id", "entity_type", "fields", "relations", "provenance"), 256).alias("digest"))


def fingerprint(events: DataFrame) -> DataFrame:
    """(entities, fields, field_letters, relations): sizes by which two projections are told apart at a glance."""
    line = lineage(events)
    held = fold_fields(events, line).agg(F.count(F.lit(1)).alias("fields"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("field_letters"))
    return created(events, line).agg(F.count(F.lit(1)).alias("entities")).crossJoin(held).crossJoin(fold_relations(events, line).agg(F.count(F.lit(1)).alias("relations")))  # one row each


def without_provenance(events: DataFrame) -> DataFrame:
    """(entity_id, field): fields that are held and that no event explains; there should be none."""
    line = lineage(events)
    explained = field_provenance(events, line).filter("event_id IS NOT NULL").select("entity_id", "field")
    return fold_fields(events, line).select("entity_id", "field").distinct().join(explained, ["entity_id", "field"], "left_anti")


def entity_texts(events: DataFrame) -> DataFrame:
    """(doc_key, text): all string values that an entity holds, in log order, as search sees them."""
    held = fold_fields(events).filter(F.col("value").startswith("s:")).select("entity_id", "position", F.substring("value", 3, 1 << 20).alias("v"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("position", "v"))), lambda r: r["v"])
    return held.groupBy(F.col("entity_id").alias("doc_key")).agg(F.concat_ws(" ", in_order).alias("text"))
