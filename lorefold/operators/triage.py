"""Diffing claims against state, and triage of proposed changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.functions import confidence as C

# Fixed values: (field, type, cardinality) that every entity has, and those of each type.
SHARED_FIELDS = (
    ("name", "text", "single"),
    ("aliases", "text", "set"),
    ("summary", "text", "single"),
    ("notes", "text", "set"),
    ("salience", "number", "single"),
)
OWN_FIELDS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "Person": (
        ("employer", "text", "single"),
        ("role", "text", "single"),
        ("location", "text", "single"),
        ("relationship", "enum", "single"),
        ("contact", "text", "set"),
        ("last_contact_at", "date", "single"),
    ),
    "Project": (
        ("status", "enum", "single"),
        ("blocker", "text", "single"),
        ("next_action", "text", "single"),
        ("outcome", "text", "single"),
        ("due", "date", "single"),
        ("started_at", "date", "single"),
    ),
    "Idea": (
        ("body", "text", "single"),
        ("status", "enum", "single"),
    ),
    "Event": (
        ("occurred_at", "date", "single"),
        ("ends_at", "date", "single"),
        ("location", "text", "single"),
        ("kind", "enum", "single"),
        ("outcome", "text", "single"),
    ),
    "Task": (
        ("status", "enum", "single"),
        ("due", "date", "single"),
        ("done_at", "date", "single"),
    ),
}
DERIVED = ("salience", "last_contact_at")
REVIEW_FLOOR = ("name",)
# The members of each enum field by type.
ENUM_MEMBERS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Person", "relationship", ("colleague", "friend", "family", "client", "acquaintance", "other")),
    ("Project", "status", ("active", "blocked", "paused", "done", "abandoned")),
    ("Idea", "status", ("open", "promoted", "dropped")),
    ("Event", "kind", ("meeting", "call", "deadline", "milestone", "social", "other")),
    ("Task", "status", ("open", "done", "dropped")),
)
# Declared pairs of each relation, the one of which an entity has one only, and the one that is always reviewed.
RELATION_PAIRS = (
    ("involves", "Project", "Person"),
    ("concerns", "Task", "Person"),
    ("concerns", "Task", "Project"),
    ("concerns", "Task", "Idea"),
    ("concerns", "Task", "Event"),
    ("attended", "Event", "Person"),
    ("relates_to", "Project", "Project"),
    ("relates_to", "Idea", "Idea"),
    ("relates_to", "Idea", "Project"),
    ("became", "Idea", "Project"),
    ("became", "Idea", "Task"),
    ("blocks", "Task", "Task"),
    ("blocks", "Project", "Project"),
    ("blocks", "Task", "Project"),
    ("knows", "Person", "Person"),
)
SINGLE_RELATIONS = ("became",)
REVIEWED_RELATIONS = ("became",)
# Fixed values: (type, field, field it depends on, values of that one under which it keeps its meaning).
DEPENDENCIES = (("Project", "blocker", "status", ("blocked",)),)


def field_schema(spark) -> DataFrame:
    """(entity_type, field, field_type, cardinality, is_derived, floor)."""
    rows = [(t, *field) for t, own in OWN_FIELDS.items() for field in (*SHARED_FIELDS, *own)]
    base = spark.createDataFrame(rows, "entity_type string, field string, field_type string, cardinality string")
    return base.withColumn("is_derived", F.col("field").isin(*DERIVED)).withColumn("floor", F.when(F.col("field").isin(*REVIEW_FLOOR), "review").otherwise("auto"))


def diff_entities(claims: DataFrame, held: DataFrame, schema: DataFrame) -> DataFrame:
    """Changes that claims ask for: (entity_id, field, value, change).

    claims: (entity_id, entity_type, field, value); held: (entity_id, field,
    value), several rows for set fields. Unknown and derived fields are refused,
    what is held already is dropped; set fields grow, single ones are set.
    """
    known = claims.distinct().join(F.broadcast(schema), ["entity_type", "field"], "left")  # a row for each declared field
    same = held.select("entity_id", "field", "value", F.lit(True).alias("is_held")).distinct()
    change = (
        F.when(F.col("cardinality").isNull(), "refused_unknown").when(F.col("is_derived"), "refused_derived").when(F.col("is_held"), "already_held")
        .when(F.col("cardinality") == "set", "add_to_set").otherwise("set_field")
    )
    return known.join(same, ["entity_id", "field", "value"], "left").select("entity_id", "entity_type", "field", "value", change.alias("change"))


def diff_dependents(changes: DataFrame, held: DataFrame) -> DataFrame:
    """(entity_id, field, change): held fields to be cleared, as what they depend on is set to a value under which they mean nothing.

    A project's blocker depends on its status being blocked. Values are texts
    that carry their kind, such as ``s:blocked``; dates never keep a field.
    """
    out = None
    for kind, field, on, values in DEPENDENCIES:
        leaves = changes.filter((F.col("entity_type") == kind) & (F.col("field") == on) & (F.col("change") == "set_field") & ~F.coalesce(F.col("value").isin(*(f"s:{v}" for v in values)), F.lit(False)))
        part = held.filter(F.col("field") == field).select("entity_id").distinct().join(leaves.select("entity_id").distinct(), "entity_id").select("entity_id", F.lit(field).alias("field"), F.lit("clear_field").alias("change"))
        out = part if out is None else out.unionByName(part)
    return out


def relation_violations(relations: DataFrame) -> DataFrame:
    """Relations with ``violation``: unknown relation, self relation, undeclared pair, or null for a good one."""
    spark = relations.sparkSession
    pairs = spark.createDataFrame(list(RELATION_PAIRS), "relation string, from_type string, to_type string").withColumn("declared", F.lit(True))
    names = sorted({p[0] for p in RELATION_PAIRS})
    violation = (
        F.when(~F.col("relation").isin(*names), "unknown_relation").when(F.col("from_id") == F.col("to_id"), "self_relation").when(F.col("declared").isNull(), "undeclared_pair")
    )
    return relations.join(F.broadcast(pairs), ["relation", "from_type", "to_type"], "left").withColumn("violation", violation).drop("declared")  # a fixed list


def diff_relations(claims: DataFrame, held: DataFrame) -> DataFrame:
    """Claimed relations with ``change`` (refused, already_held, replace or relate) and ``floor``.

    A relation of which an entity has one only replaces another that it holds.
    """
    checked = relation_violations(claims.distinct())
    same = held.select("relation", "from_id", "to_id", F.lit(True).alias("is_held")).distinct()
    other = held.filter(F.col("relation").isin(*SINGLE_RELATIONS)).select("relation", "from_id", F.lit(True).alias("has_other")).distinct()
    change = F.when(F.col("violation").isNotNull(), "refused").when(F.col("is_held"), "already_held").when(F.col("has_other"), "replace").otherwise("relate")
    floor = F.when(F.col("relation").isin(*REVIEWED_RELATIONS), "review").otherwise("auto")
    return checked.join(same, ["relation", "from_id", "to_id"], "left").join(other, ["relation", "from_id"], "left").withColumn("change", change).withColumn("floor", floor).drop("is_held", "has_other")


def enum_fallback(values: DataFrame) -> DataFrame:
    """Values of enum fields with ``parsed`` and ``note``: the member in lower case, or ``other`` and a note of what was said.

    values: (entity_type, field, value, ..). A field that is no enum of its
    type gives null for both.
    """
    spark = values.sparkSession
    members = spark.createDataFrame([(t, f, list(m)) for t, f, m in ENUM_MEMBERS], "entity_type string, field string, members array<string>")
    cleaned = F.lower(F.trim("value"))
    known = F.coalesce(F.array_contains("members", cleaned), F.lit(False))
    is_enum = F.col("members").isNotNull()
    joined = values.join(F.broadcast(members), ["entity_type", "field"], "left")  # a fixed list
    return joined.withColumn("parsed", F.when(is_enum, F.when(known, cleaned).otherwise("other"))).withColumn("note", F.when(is_enum & ~known, F.concat("field", F.lit(": "), "value"))).drop("members")


def triage(proposals: DataFrame, corrections: DataFrame, draw: str | None = None) -> DataFrame:
    """Proposals with combined confidence, band, ceiling and disposition.

    proposals: (proposal_id, provider, model_version, extraction, resolution,
    change_kind, floor); corrections: (provider, model_version, corrections).
    While a model has few corrections its extraction is capped and what rests
    on a resolution is withheld; the policy bounds each kind of change; of what
    would be applied a sample, by ``draw`` or a digest of the id, is reviewed.
    """
    counted = proposals.join(corrections, ["provider", "model_version"], "left").withColumn("corrections", F.coalesce("corrections", F.lit(0)))
    boot = F.col("corrections") < C.BOOTSTRAP_CORRECTIONS
    extraction = C.clamp_unit(F.col("extraction"))
    capped = F.when(boot, F.least(extraction, F.lit(C.BOOTSTRAP_CAP))).otherwise(extraction)
    ceiling = (
        F.when(F.col("change_kind").isin("create_with_rejected", "merge", "remove", "split"), "needs_review")
        .when(F.col("change_kind") == "add_relation", "auto_apply").when(F.coalesce("floor", F.lit("review")) == "review", "needs_review").otherwise("auto_apply")
    )
    drawn = F.col(draw) if draw else C.draw(F.col("proposal_id"))
    staged = (
        counted.withColumn("is_bootstrapping", boot).withColumn("confidence", C.combine(capped, F.col("resolution"))).withColumn("band", C.band_for(F.col("confidence")))
        .withColumn("ceiling", ceiling)
    )
    withheld = F.when(F.col("is_bootstrapping") & F.col("resolution").isNotNull(), C.most_restrictive(F.col("band"), F.lit("needs_review"))).otherwise(F.col("band"))
    bounded = staged.withColumn("bounded", C.most_restrictive(withheld, F.col("ceiling")))
    sampled = (F.col("bounded") == "auto_apply") & (drawn < C.sampling_rate(F.col("corrections")))
    return bounded.withColumn("is_sampled", sampled).withColumn("disposition", F.when(sampled, "needs_review").otherwise(F.col("bounded"))).drop("bounded")
