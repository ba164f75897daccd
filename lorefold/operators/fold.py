"""Folding the event log into entities, provenance, relations and redirects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorefold.operators.entity_changes import value_key
from lorefold.operators.event_store import first_deliveries
from lorefold.session import cut

_KEY = ("aggregate_id", "life")

KNOWLEDGE = ("EntityCreated", "FieldSet", "SetMemberAdded", "FieldCleared", "EntitiesRelated", "EntitiesMerged")
WRITES = ("EntityCreated", "FieldSet", "SetMemberAdded", "FieldCleared")
# Fields that accumulate, and the one type whose entities alone have contacts; all others are superseded.
SET_FIELDS = ("aliases", "notes", "contact")
CONTACT_TYPE = "Person"
NOTES = "notes"


def read_log(log: DataFrame) -> DataFrame:
    """Knowledge events in log order with parsed payloads, each event once.

    Columns: position, event_id, type, aggregate_id, capture_id, recorded_at,
    field, value, entity_type, merged_id, relation, from_id, from_type, to_id,
    to_type. Unreadable payloads and rows without id or position are left out.
    """
    doc = F.col("doc")
    text = lambda p: F.variant_get(doc, p, "string")
    rows = first_deliveries(log.filter(F.col("type").isin(*KNOWLEDGE) & F.col("position").isNotNull() & F.col("aggregate_id").isNotNull()).select("position", "event_id", "type", "aggregate_id", "capture_id", "recorded_at", "payload"))
    rows = rows.withColumn("doc", F.try_parse_json("payload")).filter("doc IS NOT NULL")
    kind = F.col("type")
    return rows.select(
        "position", "event_id", "type", "aggregate_id", "capture_id", "recorded_at",
        F.when(kind == "EntityCreated", F.when(text("$.name").isNotNull(), F.lit("name"))).when(kind.isin("FieldSet", "SetMemberAdded", "FieldCleared"), text("$.field")).alias("field"),
        F.when(kind == "EntityCreated", F.concat(F.lit("s:"), text("$.name"))).when(kind.isin("FieldSet", "SetMemberAdded"), value_key(doc)).alias("value"),
        F.when(kind == "EntityCreated", text("$.entityType")).alias("entity_type"),
        F.when(kind == "EntitiesMerged", text("$.mergedId")).alias("merged_id"),
        *[F.when(kind == "EntitiesRelated", text(f"$.{name}")).alias(alias) for name, alias in (("relation", "relation"), ("fromId", "from_id"), ("fromType", "from_type"), ("toId", "to_id"), ("toType", "to_type"))],
    )


@dataclass
class Lineage:
    """Which entities there are and were.

    merges: (position, event_id, survivor, loser) of the valid merges; births:
    (aggregate_id, life, entity_type, created_position), the creation that
    counts of every life; it reads the checkpointed creations.
    """

    merges: DataFrame
    births: DataFrame


def lineage(events: DataFrame) -> Lineage:
    """Merges whose two sides were live and different at the time, and the lives of entities between them.

    Existence depends on creations and merges alone. An entity is live from a
    creation until a valid merge takes it; a merge is valid if both are. The
    rounds settle all merges whose earlier ones are settled; there are as many
    as the longest chain of merges that depend on each other, and none if no
    merge takes an entity that an earlier one has taken. The log is read once.
    """
    kept = cut(
        events.filter("(type = 'EntitiesMerged' AND merged_id IS NOT NULL AND merged_id <> aggregate_id) OR (type = 'EntityCreated' AND field IS NOT NULL)")
        .select("type", "position", "event_id", "aggregate_id", "merged_id", "entity_type")
    )
    creations = kept.filter("type = 'EntityCreated'").select("aggregate_id", "position", "entity_type")
    merges = kept.filter("type = 'EntitiesMerged'").select("position", "event_id", F.col("aggregate_id").alias("survivor"), F.col("merged_id").alias("loser"))
    sides = merges.select("event_id", "position", F.explode(F.array("survivor", "loser")).alias("id"))
    # of each side the last creation before the merge; a merge without two has a side that never was
    last = creations.select(F.col("aggregate_id").alias("id"), F.col("position").alias("p")).join(sides, "id").filter("p < position").groupBy("event_id", "position", "id").agg(F.max("p").alias("born"))
    born = cut(last.withColumn("sides", F.count(F.lit(1)).over(Window.partitionBy("event_id"))).filter("sides = 2").drop("sides"))
    base = merges.join(born.select("event_id").distinct(), "event_id", "left_semi")
    valid, seen = base, None
    while True:
        taken = valid.groupBy(F.col("loser").alias("id")).agg(F.collect_list("position").alias("deaths"))  # one each time the id was merged away
        before = F.array_max(F.filter("deaths", lambda d: d < F.col("position")))
        dead = cut(born.join(taken, "id").filter(F.coalesce(before > F.col("born"), F.lit(False))).select("event_id").distinct())
        state = dead.agg(F.count(F.lit(1)), F.sum(F.xxhash64("event_id").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        valid = base.join(dead, "event_id", "left_anti")
        if not state[0]:
            break
        seen = state
    merges = cut(valid.select("position", "event_id", "survivor", "loser"))
    births = _lives(creations, merges).groupBy(*_KEY).agg(F.min_by("entity_type", "position").alias("entity_type"), F.min("position").alias("created_position"))
    return Lineage(merges, births)


def valid_merges(events: DataFrame) -> DataFrame:
    """(position, event_id, survivor, loser) of the valid merges."""
    return lineage(events).merges


def fates(merges: DataFrame) -> DataFrame:
    """(id, fates): for each id that was merged away, array<struct<position, final_id>>, earliest first.

    ``final_id`` is where what the id was leads to in the end: to the survivor,
    and on along the merges that take that one later. Walked by doubling.
    """
    later = merges.select(F.col("event_id").alias("next"), F.col("loser").alias("survivor"), F.col("position").alias("p"))
    walk = cut(
        merges.join(later, "survivor", "left").withColumn("hit", F.when(F.col("p") > F.col("position"), F.struct("p", "next")))
        .groupBy("event_id", "loser", "position", "survivor").agg(F.min("hit").alias("hit"))
        .select("event_id", "loser", "position", F.col("survivor").alias("final_id"), F.col("hit.next").alias("next"))
    )
    while not walk.filter("next IS NOT NULL").isEmpty():
        on = walk.select(F.col("event_id").alias("next"), F.col("final_id").alias("further"), F.col("next").alias("beyond"))
        walk = cut(walk.join(on, "next", "left").select("event_id", "loser", "position", F.coalesce("further", "final_id").alias("final_id"), F.col("beyond").alias("next")))
    return walk.groupBy(F.col("loser").alias("id")).agg(F.sort_array(F.collect_list(F.struct("position", "final_id"))).alias("fates"))


def _lives(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """``rows`` (aggregate_id, position) with ``life``: how often the id had been merged away before."""
    deaths = merges.groupBy(F.col("loser").alias("aggregate_id")).agg(F.collect_list("position").alias("deaths"))  # one each time the id was merged away
    return rows.join(deaths, "aggregate_id", "left").withColumn("life", F.coalesce(F.size(F.filter("deaths", lambda d: d < F.col("position"))), F.lit(0))).drop("deaths")


def survivors(lives: DataFrame, merges: DataFrame) -> DataFrame:
    """The ``lives`` that no merge has ended."""
    ended = merges.groupBy(F.col("loser").alias("aggregate_id")).agg(F.count(F.lit(1)).alias("ended"))
    return lives.join(ended, "aggregate_id", "left").filter(F.col("life") == F.coalesce("ended", F.lit(0))).drop("ended")


def created(events: DataFrame, line: Lineage | None = None) -> DataFrame:
    """(aggregate_id, entity_type, created_position): entities that exist, by their first creation since they last didn't."""
    line = lineage(events) if line is None else line
    merges = line.merges
    return survivors(line.births, merges).select("aggregate_id", "entity_type", "created_position")


def effective_rows(events: DataFrame, line: Lineage | None = None) -> DataFrame:
    """Field events that touch a live entity: the creation (as a write of ``name``) and what follows it, with the ``life`` they fall in."""
    line = lineage(events) if line is None else line
    merges = line.merges
    writes = _lives(events.filter(F.col("type").isin(*WRITES) & F.col("field").isNotNull()), merges)
    return writes.join(line.births, [*_KEY]).filter(
        (F.col("position") > F.col("created_position")) & (F.col("type") != "EntityCreated") | (F.col("position") == F.col("created_position"))
    ).select("aggregate_id", "life", "field", "value", "type", "position", "event_id", "recorded_at")


def _final_epochs(rows: DataFrame) -> DataFrame:
    """Rows since the last reset of their field in their life, less clears."""
    resets = rows.filter("type <> 'SetMemberAdded'").groupBy(*_KEY, "field").agg(F.max("position").alias("reset"))
    return rows.join(resets, [*_KEY, "field"], "left").filter((F.col("reset").isNull() | (F.col("position") >= F.col("reset"))) & (F.col("type") != "FieldCleared"))


def _held(rows: DataFrame) -> DataFrame:
    """(aggregate_id, life, field, value, position, event_id, pointer): values held at the end of a life, in log order by position."""
    kept = _final_epochs(rows).groupBy(*_KEY, "field", "value").agg(F.min("position").alias("position"), F.min_by("event_id", "position").alias("event_id"), F.min_by("pointer", "position").alias("pointer"))
    return kept


def _settle(rows: DataFrame, births: DataFrame) -> DataFrame:
    """Absorbed values turned into writes, members and notes of the survivor.

    A field the survivor lacks is taken over whole; set fields are joined; a
    single value stays, and a different one of the loser's becomes a note. Only
    fields that a merge touches pass through the windows here.
    """
    touched = rows.filter("type = 'Absorbed'").select(*_KEY, "field").distinct()
    plain = rows.join(touched, [*_KEY, "field"], "left_anti")
    along = Window.partitionBy(*_KEY, "field").orderBy("position")
    before = F.last("type").over(along.rangeBetween(Window.unboundedPreceding, -1))
    mixed = rows.join(touched, [*_KEY, "field"]).join(births.select(*_KEY, "entity_type"), [*_KEY], "left")
    mixed = mixed.withColumn("lacks", before.isNull() | (before == "FieldCleared")).withColumn("taken", (F.col("type") == "Absorbed") & F.col("lacks"))
    resets = ~F.col("type").isin("SetMemberAdded", "Absorbed") | F.col("taken")
    mixed = mixed.withColumn("epoch", F.sum(F.when(resets, F.col("position"))).over(along.rangeBetween(Window.unboundedPreceding, 0)))
    # two resets never share a position but in one merge, so a sum of positions tells the epochs apart
    held = F.min("position").over(Window.partitionBy(*_KEY, "field", "epoch", "value")) < F.col("position")
    grows = F.col("field").isin("aliases", NOTES) | (F.col("field") == "contact") & (F.col("entity_type") == CONTACT_TYPE)
    mixed = mixed.withColumn("held", held)
    kind = F.when(F.col("type") != "Absorbed", F.col("type")).when(F.col("taken"), "FieldSet").otherwise("SetMemberAdded")
    stays = (F.col("type") != "Absorbed") | F.col("taken") | grows
    pointer = F.when(F.col("type") != "Absorbed", F.col("pointer")).when(F.col("field") == NOTES, F.col("merge_id")).when(F.col("taken"), F.col("pointer"))
    columns = [*_KEY, "field", "value", "type", "position", "event_id", "pointer", "merge_id"]
    kept = mixed.filter(stays).withColumn("pointer", pointer).withColumn("type", kind).select(*columns)
    notes = mixed.filter(~stays & ~F.col("held")).select(
        *_KEY, F.lit(NOTES).alias("field"), F.concat(F.lit("s:"), F.col("field"), F.lit(": "), F.when(F.col("value").startswith("d:"), F.substring_index(F.substring("value", 3, 1 << 20), "|", 1)).otherwise(F.substring("value", 3, 1 << 20))).alias("value"),
        F.lit("SetMemberAdded").alias("type"), "position", F.col("merge_id").alias("event_id"), F.col("merge_id").alias("pointer"), "merge_id",
    )
    return plain.select(*columns).unionByName(kept).unionByName(notes)


def folded_rows(events: DataFrame, line: Lineage | None = None) -> DataFrame:
    """Effective rows of every life with what survivors absorbed: (aggregate_id, life, field, value, type, position, event_id, pointer, merge_id).

    ``pointer`` is the event that explains the value, ``merge_id`` the merge a
    row comes from. Losers are settled before their survivors, in as many
    rounds as merges build on merges; each round folds the losers of that
    round only. Notes that a merge adds are members of the survivor's notes.
    """
    line = lineage(events) if line is None else line
    merges = line.merges
    own = effective_rows(events, line).drop("recorded_at").withColumn("pointer", F.col("event_id")).withColumn("merge_id", F.lit(None).cast("string"))
    sides = _lives(merges.withColumnRenamed("loser", "aggregate_id"), merges).withColumnRenamed("life", "loser_life").withColumnRenamed("aggregate_id", "loser").withColumnRenamed("survivor", "aggregate_id")
    pending = cut(_lives(sides, merges))
    left = pending.count()
    if not left:
        return own
    ids = pending.select(F.explode(F.array(F.struct(F.col("loser").alias("id"), F.col("loser_life").alias("life")), F.struct(F.col("aggregate_id").alias("id"), "life"))).alias("k")).select(F.col("k.id").alias("aggregate_id"), F.col("k.life").alias("life")).distinct()
    merged = cut(own.join(ids, [*_KEY], "left_semi"))
    while left:
        into = pending.select(F.col("aggregate_id").alias("loser"), F.col("life").alias("loser_life")).distinct()  # merges into a loser come before its own
        waiting = cut(pending.join(into, ["loser", "loser_life"], "left_semi"))
        ready = pending.join(waiting.select("event_id"), "event_id", "left_anti")
        lost = ready.select(F.col("loser").alias("aggregate_id"), F.col("loser_life").alias("life"))
        brought = _held(_settle(merged.join(lost, [*_KEY], "left_semi"), line.births))
        # a field that is taken over keeps the pointer it had, whatever explains its single values
        explained = brought.groupBy(*_KEY, "field").agg(F.max_by("pointer", F.when(F.col("pointer").isNotNull(), F.col("position"))).alias("pointer"))
        brought = brought.drop("pointer").join(explained, [*_KEY, "field"])
        moved = ready.select(F.col("event_id").alias("merge_id"), "position", "aggregate_id", "life", "loser", "loser_life").join(
            brought.select(F.col("aggregate_id").alias("loser"), F.col("life").alias("loser_life"), "field", "value", "event_id", "pointer"), ["loser", "loser_life"]
        )
        merged = cut(merged.unionByName(moved.select("aggregate_id", "life", "field", "value", F.lit("Absorbed").alias("type"), "position", "event_id", "pointer", "merge_id")))
        pending, left = waiting, waiting.count()
    return own.join(ids, [*_KEY], "left_anti").unionByName(_settle(merged, line.births))


def fold_fields(events: DataFrame, line: Lineage | None = None) -> DataFrame:
    """(entity_id, field, value, event_id, position): every value held at the end, in log order by position.

    The last reset (creation, set or clear) of a field starts its final epoch;
    what a set then gained counts once. Entities merged away have none; what
    survivors took over stands at the merge. Only aggregates with map-side
    combine, but for the fields that a merge touched.
    """
    line = lineage(events) if line is None else line
    merges = line.merges
    held = survivors(_held(folded_rows(events, line)), merges)
    return held.select(F.col("aggregate_id").alias("entity_id"), "field", "value", "position", "event_id")


def field_provenance(events: DataFrame, line: Lineage | None = None) -> DataFrame:
    """(entity_id, field, event_id): the event that explains a field that is held.

    It is the last that effectively wrote it; a field taken over in a merge
    keeps the loser's, one that grew by a merge its own, but notes that a merge
    added to point to the merge.
    """
    line = lineage(events) if line is None else line
    merges = line.merges
    held = survivors(_held(folded_rows(events, line)), merges)
    return held.groupBy(F.col("aggregate_id").alias("entity_id"), "field").agg(F.max_by("pointer", F.when(F.col("pointer").isNotNull(), F.col("position"))).alias("event_id"))


def entity_versions(events: DataFrame, line: Lineage | None = None) -> DataFrame:
    """(entity_id, version): effective writes, clears whether they cleared anything or not, and one for each merge survived."""
    line = lineage(events) if line is None else line
    merges = line.merges
    rows = survivors(folded_rows(events, line), merges)
    own = rows.filter("merge_id IS NULL")
    resets = own.filter("type <> 'SetMemberAdded'").groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("n"))
    # a member counts once an epoch: only fields that gain members need their epochs, numbered by the last reset before
    gaining = own.filter("type = 'SetMemberAdded'").select("aggregate_id", "field").distinct()
    along = Window.partitionBy("aggregate_id", "field").orderBy("position").rangeBetween(Window.unboundedPreceding, 0)
    epochs = rows.join(gaining, ["aggregate_id", "field"]).withColumn("epoch", F.max(F.when(F.col("type") != "SetMemberAdded", F.col("position"))).over(along))
    members = epochs.groupBy("aggregate_id", "field", "epoch", "value").agg(F.min_by(F.struct("type", "merge_id"), "position").alias("r")).filter("r.type = 'SetMemberAdded' AND r.merge_id IS NULL").groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("n"))
    last = survivors(_lives(merges.withColumnRenamed("survivor", "aggregate_id"), merges), merges)
    survived = last.groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("n"))
    return resets.unionAll(members).unionAll(survived).groupBy(F.col("aggregate_id").alias("entity_id")).agg(F.sum("n").alias("version"))


def written_relations(events: DataFrame) -> DataFrame:
    """Relations as they were written, merges left aside: one row per name and ends; the last writer's types."""
    rows = events.filter("relation IS NOT NULL AND from_id IS NOT NULL AND to_id IS NOT NULL")
    return rows.groupBy("relation", "from_id", "to_id").agg(F.max_by("from_type", "position").alias("from_type"), F.max_by("to_type", "position").alias("to_type"))


def fold_relations(events: DataFrame, line: Lineage | None = None, types_of: str = "last") -> DataFrame:
    """(relation, from_id, from_type, to_id, to_type): relations with ends moved along the merges that came after they were written.

    Self-loops that arise are kept, and what is written after a merge isn't
    moved. Relations that fall together are one, with the types of the last
    writer, or of the first as relation tables have it (``types_of="first"``).
    """
    line = lineage(events) if line is None else line
    merges = line.merges
    rows = events.filter("relation IS NOT NULL AND from_id IS NOT NULL AND to_id IS NOT NULL").select("relation", "from_id", "from_type", "to_id", "to_type", "position")
    ends = fates(merges)
    for end in ("from_id", "to_id"):
        after = F.filter("fates", lambda f: f.position > F.col("position"))
        rows = rows.join(ends.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce(F.get(after, F.lit(0)).final_id, F.col(end))).drop("fates")
    pick = F.max_by if types_of == "last" else F.min_by
    return rows.groupBy("relation", "from_id", "to_id").agg(pick("from_type", "position").alias("from_type"), pick("to_type", "position").alias("to_type"))


def resolve_redirects(redirects: DataFrame, most: int = 64) -> DataFrame:
    """(from_id, final_id, hops): where each chain ends, walked by doubling; a ring ends after all its links.

    redirects: (from_id, to_id), one target for each id.
    """
    walk = cut(redirects.filter("from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id").groupBy("from_id").agg(F.max("to_id").alias("to_id")).withColumn("hops", F.lit(1).cast("long")))
    for _ in range(most):
        on = walk.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("next"), F.col("hops").alias("more"))
        walk = cut(walk.join(on, "to_id", "left").select("from_id", F.coalesce("next", "to_id").alias("to_id"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved")))
        bound = walk.count() + 1
        if walk.filter(F.col("moved") & (F.col("hops") < bound)).isEmpty():
            break
        walk = walk.drop("moved")
    return walk.select("from_id", F.col("to_id").alias("final_id"), "hops")
