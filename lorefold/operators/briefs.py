"""Briefs: composing, write-once storage, reads, opens and attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.functions.text import proper_name_runs
from lorefold.operators.stores import brief_sections

# Fixed value: what a brief says that selects nothing.
QUIET_PROSE = "Nothing needs your attention."
RECENT = 30


def selected_ids(selection: DataFrame) -> DataFrame:
    """(entity_id): what a selection (brief_id, heading, rank, entity_id, name, salience) names, each once."""
    return selection.select("entity_id").distinct()


def unselected_mentions(prose: DataFrame, selection: DataFrame) -> DataFrame:
    """(brief_id, mentions): names in a brief's prose that its selection doesn't account for.

    prose: (brief_id, prose). Permitted are the selected names whole and their
    single words, in any case; a run of several words has to be a whole name.
    """
    runs = prose.select("brief_id", F.explode(proper_name_runs(F.col("prose"))).alias("run"))
    whole = selection.select("brief_id", F.lower("name").alias("k"))
    permitted = whole.unionAll(whole.select("brief_id", F.explode(F.split("k", r"\s+")).alias("k"))).distinct()
    other = runs.withColumn("k", F.lower("run")).join(permitted, ["brief_id", "k"], "left_anti").groupBy("brief_id").agg(F.sort_array(F.collect_set("run")).alias("mentions"))
    return prose.select("brief_id").join(other, "brief_id", "left").withColumn("mentions", F.coalesce("mentions", F.array().cast("array<string>")))


def compose(briefs: DataFrame, selection: DataFrame, generated: DataFrame) -> DataFrame:
    """(brief_id, prose, provider, model_version, mentions): what each brief says.

    briefs: (brief_id); generated: (brief_id, prose, provider, model_version),
    the outcome of a port that writes prose. A brief that selects nothing gets
    the fixed quiet line; prose that names others than were selected, and none
    at all, is replaced by the plain list of the selection.
    """
    full = selection.select("brief_id").distinct().withColumn("is_full", F.lit(True))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda r: F.concat(F.lit("- "), r["name"])), "\n")
    sections = selection.groupBy("brief_id", "heading").agg(F.concat(F.lit("## "), F.first("heading"), F.lit("\n"), lines).alias("part"), F.min("section").alias("section"))
    plain = sections.groupBy("brief_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "part"))), lambda r: r["part"]), "\n\n").alias("plain"))
    said = generated.join(unselected_mentions(generated.select("brief_id", "prose"), selection), "brief_id")
    rows = briefs.join(full, "brief_id", "left").join(plain, "brief_id", "left").join(said, "brief_id", "left")
    quiet = F.col("is_full").isNull()
    refused = F.col("prose").isNull() | (F.size("mentions") > 0)
    none = F.array().cast("array<string>")
    return rows.select(
        "brief_id", F.when(quiet, QUIET_PROSE).when(refused, F.col("plain")).otherwise(F.col("prose")).alias("prose"),
        *[F.when(quiet, "none").otherwise(F.coalesce(c, F.lit("none"))).alias(c) for c in ("provider", "model_version")], F.when(quiet, none).otherwise(F.coalesce("mentions", none)).alias("mentions"),
    )


def put(stored: DataFrame, stored_entities: DataFrame, arriving: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new briefs, new brief entities, (brief_id, was_stored)): a brief is written once; what is there stays as it is."""
    fresh = arriving.dropDuplicates(["brief_id"]).join(stored.select("brief_id").distinct(), "brief_id", "left_anti")
    entities = selection.join(fresh.select("brief_id"), "brief_id", "left_semi").select("brief_id", "entity_id", "heading", "salience").dropDuplicates(["brief_id", "entity_id", "heading"])
    entities = entities.join(stored_entities.select("brief_id", "entity_id", "heading"), ["brief_id", "entity_id", "heading"], "left_anti")
    written = arriving.select("brief_id").distinct().join(fresh.select("brief_id", F.lit(True).alias("was_stored")), "brief_id", "left").withColumn("was_stored", F.coalesce("was_stored", F.lit(False)))
    return fresh, entities, written


def recent(briefs: DataFrame, kind: str, limit: int = RECENT) -> DataFrame:
    """The latest briefs of a kind, newest first."""
    return briefs.filter(F.col("kind") == kind).orderBy(F.desc("covers_to"), F.desc("brief_id")).limit(limit)


def unread_count(briefs: DataFrame) -> DataFrame:
    """(unread): how many briefs nobody has read."""
    return briefs.agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def mark_read(briefs: DataFrame, reads: DataFrame) -> DataFrame:
    """Briefs with the first reading (brief_id, read_at) of each that had none."""
    first = reads.groupBy("brief_id").agg(F.min("read_at").alias("first_read"))
    return briefs.join(first, "brief_id", "left").withColumn("read_at", F.coalesce("read_at", "first_read")).drop("first_read")


def record_opens(stored: DataFrame, opens: DataFrame, brief_entities: DataFrame) -> DataFrame:
    """The opens (entity_id, opened_at, brief_id, salience) that are new; a brief stays named only if it selected the entity.

    Of several at one instant for an entity one counts, one that names a brief first.
    """
    selected = brief_entities.select("brief_id", "entity_id").distinct().withColumn("is_selected", F.lit(True))
    checked = opens.join(selected, ["brief_id", "entity_id"], "left").withColumn("brief_id", F.when(F.col("is_selected"), F.col("brief_id"))).drop("is_selected")
    first = checked.groupBy("entity_id", "opened_at").agg(F.min(F.struct(F.col("brief_id").isNull().alias("unnamed"), "brief_id", "salience")).alias("o")).select("entity_id", "opened_at", "o.brief_id", "o.salience")
    return first.join(stored.select("entity_id", "opened_at").distinct(), ["entity_id", "opened_at"], "left_anti")


def facts(held: DataFrame) -> DataFrame:
    """(entity_id, facts): map of what a brief may say of an entity: its fields but name and salience, values joined by ``; ``.

    held: (entity_id, field, value, position) with values s:text or
    d:timestamp|precision; a date without a timestamp, and an empty text, say nothing.
    """
    text: Column = F.substring("value", 3, 1 << 20)
    said = F.when(F.col("value").startswith("d:"), F.substring_index(text, "|", 1)).otherwise(text)
    rows = held.filter(~F.col("field").isin("name", "salience")).withColumn("said", said).filter(F.length("said") > 0)
    listed = rows.groupBy("entity_id", "field").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "said"))), lambda r: r["said"]), "; ").alias("said"))
    return listed.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "said")))).alias("facts"))


__all__ = ["brief_sections", "compose", "facts", "mark_read", "put", "recent", "record_opens", "selected_ids", "unread_count", "unselected_mentions"]
