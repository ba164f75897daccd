"""Entity resolution: candidates, scores, outcomes; duplicate detection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefold.functions.edits import close_pairs
from lorefold.functions.ids import duplicate_id
from lorefold.functions.text import normalise_name, text_similarity
from lorefold.session import cut

#: Queries that every task holds while all vectors stream by.
QUERIES_AT_ONCE = 4096
#: Spellings of a block of one type: as many at most, and fewer, down to the least, while there are up to SPREAD blocks.
#: Small blocks cost more than they share out. Tasks that pairs of blocks are shared out to.
MOST_TEXTS, LEAST_TEXTS, SPREAD, MOST_TASKS = 16_384, 4096, 16, 1024
# Thresholds and weights of the resolution.
FUZZY_LEAST, DUPLICATE_LEAST, NEAREST, SHORTLIST = 0.7, 0.85, 20, 4
WEIGHTS = {"name": 0.75, "sources": 0.1, "together": 0.1, "recency": 0.05}
RECENCY_DAYS = 90
UNAMBIGUOUS_BELOW, MATCHED_FROM, CLEAR_MARGIN = 0.35, 0.55, 0.15


def all_names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, entity_type, spelling, is_primary): names and aliases that aren't blank, each once."""
    own = entities.select("entity_id", "entity_type", F.col("name").alias("spelling"), F.lit(True).alias("is_primary"))
    also = aliases.join(entities.select("entity_id", "entity_type").distinct(), "entity_id").select("entity_id", "entity_type", F.col("alias").alias("spelling"), F.lit(False).alias("is_primary"))
    return own.unionAll(also).filter(F.length(normalise_name(F.col("spelling"))) > 0).groupBy("entity_id", "entity_type", "spelling").agg(F.max("is_primary").alias("is_primary"))


def exact_candidates(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """(mention_id, entity_id): entities of the type with that name or alias, whatever its case.

    mentions: (mention_id, mention_text, entity_type).
    """
    keyed = names.withColumn("key", normalise_name(F.col("spelling"))).select("entity_type", "key", "entity_id").distinct()
    return mentions.withColumn("key", normalise_name(F.col("mention_text"))).join(keyed, ["entity_type", "key"]).select("mention_id", "entity_id").distinct()


def blocks_of(texts: DataFrame) -> dict[str, int]:
    """Blocks that the texts of a type are split into, of the types that have more than one."""
    rows = texts.groupBy("entity_type").count().filter(F.col("count") > LEAST_TEXTS).collect()  # a row for LEAST_TEXTS texts at most
    return {r["entity_type"]: max(-(-r["count"] // MOST_TEXTS), min(SPREAD, -(-r["count"] // LEAST_TEXTS))) for r in rows}


def similar_spellings(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """(entity_type, x, y, similarity) of distinct normalised spellings at ``least`` or above.

    left: (entity_type, x), right: (entity_type, y); without a right side the
    pairs of the left one, each once with ``x <= y``. Every block of the left
    texts meets every block of the right ones, and ``edits.close_pairs`` finds
    the pairs of two blocks; no pair is lost.
    """
    among = right is None
    texts_l = cut(left.filter((F.length("x") > 0) & F.col("entity_type").isNotNull()).distinct())
    texts_r = texts_l.withColumnRenamed("x", "y") if among else cut(right.filter((F.length("y") > 0) & F.col("entity_type").isNotNull()).distinct())
    blocks_l = blocks_of(texts_l)
    blocks_r = blocks_l if among else blocks_of(texts_r)
    blocks = lambda of: F.coalesce(F.create_map(*(F.lit(v) for kv in of.items() for v in kv))[F.col("entity_type")], F.lit(1)) if of else F.lit(1)
    block = lambda text, of: F.pmod(F.xxhash64(text), blocks(of)).cast("int")
    each = lambda start, end: F.explode(F.sequence(start, end))
    sides = texts_l.withColumn("a", block("x", blocks_l)).select("entity_type", "a", each(F.col("a") if among else F.lit(0), blocks(blocks_r) - 1).alias("b"), "x", F.lit(None).cast("string").alias("y"))
    sides = sides.unionAll(texts_r.withColumn("b", block("y", blocks_r)).select("entity_type", each(F.lit(0), F.col("b") if among else blocks(blocks_l) - 1).alias("a"), "b", F.lit(None).cast("string").alias("x"), "y"))
    tasks = sum(blocks_l.get(t, 1) * blocks_r.get(t, 1) for t in {*blocks_l, *blocks_r}) + SPREAD  # the types of one block share SPREAD tasks
    keys = ["entity_type", "a", "b"]

    def close(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        x, y = (texts.column(c).drop_null() for c in ("x", "y"))
        found = list(close_pairs(x.to_pylist(), y.to_pylist(), least))
        i, j = (np.concatenate([np.zeros(0, np.int64), *(f[side] for f in found)]) for side in (0, 1))
        return pa.table([pa.array([key[0].as_py()] * len(i), pa.string()), x.take(pa.array(i)), y.take(pa.array(j))], names=["entity_type", "x", "y"])

    met = sides.repartition(min(tasks, MOST_TASKS), *keys).groupBy(*keys).applyInArrow(close, "entity_type string, x string, y string")
    if among:  # a pair within a block is found from both sides, one of two blocks from either
        inside = block("x", blocks_l) == block("y", blocks_l)
        met = met.filter(~inside | (F.col("x") <= F.col("y"))).select("entity_type", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    longer = F.greatest(F.length("x"), F.length("y"))
    return met.withColumn("similarity", F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(1 - F.levenshtein("x", "y") / longer)).filter(F.col("similarity") >= least)


def fuzzy_candidates(mentions: DataFrame, entities: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """(mention_id, entity_id, similarity): entities of the type whose primary name is similar."""
    asked = mentions.withColumn("x", normalise_name(F.col("mention_text")))
    named = entities.select("entity_id", "entity_type", normalise_name(F.col("name")).alias("y")).distinct()
    close = similar_spellings(asked.select("entity_type", "x"), named.select("entity_type", "y"), least)
    return asked.join(close, ["entity_type", "x"]).join(named, ["entity_type", "y"]).groupBy("mention_id", "entity_id").agg(F.max("similarity").alias("similarity"))


def nearest_candidates(queries: DataFrame, embeddings: DataFrame, k: int = NEAREST) -> DataFrame:
    """(mention_id, entity_id, distance): the k nearest entities of the type by exact cosine distance.

    A stated query set against all vectors. queries: (mention_id, entity_type,
    vector); embeddings: (entity_id, entity_type, embedding). At most
    QUERIES_AT_ONCE queries are held by every task while the vectors stream
    by; a block of vectors is multiplied with them at once and keeps its k best
    for each, ties included. Distances equal in nine digits rank by id. A zero
    vector is at distance 2 from all; vectors of another length than the query,
    and nulls, don't take part.
    """
    spark = queries.sparkSession
    asked = cut(queries.filter("mention_id IS NOT NULL AND entity_type IS NOT NULL AND vector IS NOT NULL").select("mention_id", "entity_type", F.col("vector").cast("array<double>").alias("vector")))
    rows = embeddings.filter("entity_id IS NOT NULL AND embedding IS NOT NULL").select("entity_id", "entity_type", F.col("embedding").cast("array<double>").alias("embedding"))
    chunks = -(-asked.count() // QUERIES_AT_ONCE)
    order = Window.partitionBy("mention_id").orderBy("distance", "entity_id")
    found = None
    for chunk in range(chunks):
        part = asked if chunks == 1 else asked.filter(F.pmod(F.xxhash64("mention_id"), F.lit(chunks)) == chunk)
        names, types, vectors = (c.combine_chunks() for c in part.select("mention_id", "entity_type", "vector").toArrow().columns)  # about QUERIES_AT_ONCE
        held: dict[tuple[str, int], list[int]] = {}
        for i, key in enumerate(zip(types.to_pylist(), pc.list_value_length(vectors).to_pylist(), strict=True)):
            held.setdefault(key, []).append(i)
        blocks = spark.sparkContext.broadcast(
            {key: (names.take(pa.array(at)).to_pylist(), vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), key[1])) for key, at in held.items()}
        )
        near = rows.mapInArrow(partial(_nearest_of_block, blocks, k), "mention_id string, entity_id string, distance double")
        near = cut(near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth"))
        blocks.destroy()  # one at a time is held
        found = near if found is None else found.unionAll(near)
    if found is None:
        return spark.createDataFrame([], "mention_id string, entity_id string, distance double")
    return found


def _nearest_of_block(blocks, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k nearest vectors of every batch for each query of their type and length."""
    for batch in batches:
        ids, types, vectors = (batch.column(n) for n in ("entity_id", "entity_type", "embedding"))
        keys: dict[tuple[str, int], list[int]] = {}
        for i, key in enumerate(zip(types.to_pylist(), pc.list_value_length(vectors).to_pylist(), strict=True)):
            if key in blocks.value:
                keys.setdefault(key, []).append(i)
        out: list[tuple[list, list, list]] = []
        for key, places in keys.items():
            names, asked = blocks.value[key]
            own = vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).reshape(len(places), key[1])
            lengths = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(own, axis=1)[None]
            far = asked @ own.T
            with np.errstate(divide="ignore", invalid="ignore"):
                far /= lengths
            np.subtract(1, far, out=far)
            far[~(lengths > 0)] = 2.0
            bound = np.partition(far, min(k, len(places)) - 1, axis=1)[:, min(k, len(places)) - 1]
            at, to = np.nonzero(far <= bound[:, None] + 2e-9)  # what may round to the bound; only that is rounded
            near = np.round(far[at, to], 9)
            ties = near <= np.round(bound, 9)[at]
            at, to, near = at[ties], to[ties], near[ties]
            own_ids = ids.take(pa.array(places)).to_pylist()
            out.append(([names[i] for i in at], [own_ids[j] for j in to], near.tolist()))
        columns = [[x for part in out for x in part[c]] for c in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], names=["mention_id", "entity_id", "distance"])


def candidate_union(exact: DataFrame, fuzzy: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
    """(mention_id, entity_id, sources, source_rank): candidates of all sources once, with how they were found."""
    parts = exact.select("mention_id", "entity_id", F.lit(0).alias("s")).unionAll(fuzzy.select("mention_id", "entity_id", F.lit(1)))
    if nearest is not None:
        parts = parts.unionAll(nearest.select("mention_id", "entity_id", F.lit(2)))
    return parts.groupBy("mention_id", "entity_id").agg(F.countDistinct("s").alias("sources"), F.min("s").alias("source_rank"))


def co_occurrence(candidates: DataFrame, occurrences: DataFrame, resolved: DataFrame, relations: DataFrame) -> DataFrame:
    """(mention_id, entity_id, together): the part of what a note's other mentions mean that a candidate is related to.

    occurrences: (mention_id, capture_id); resolved: (mention_id, entity_id),
    one for a mention; relations: (from_id, to_id). Of several notes the best
    counts. A candidate meets the note's entities along its relations, so
    mentions of one note aren't paired with each other.
    """
    places = occurrences.filter("capture_id IS NOT NULL").select("mention_id", "capture_id").distinct()
    meant = places.join(resolved.select("mention_id", F.col("entity_id").alias("other")), "mention_id")
    in_note = meant.groupBy("capture_id", "other").agg(F.count(F.lit(1)).alias("times"))
    sizes = in_note.groupBy("capture_id").agg(F.count(F.lit(1)).alias("entities"))
    own = meant.join(in_note, ["capture_id", "other"]).filter("times = 1").select("mention_id", "capture_id", F.col("other").alias("only_own"))
    around = places.join(sizes, "capture_id").join(own, ["mention_id", "capture_id"], "left").withColumn("n", F.col("entities") - F.col("only_own").isNotNull().cast("int"))
    edges = relations.select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("other")).unionAll(relations.select("to_id", "from_id")).distinct()
    met = candidates.select("mention_id", "entity_id").join(edges, "entity_id").join(around, "mention_id").filter(F.col("only_own").isNull() | (F.col("other") != F.col("only_own")))
    hits = met.join(in_note.select("capture_id", "other"), ["capture_id", "other"]).groupBy("mention_id", "entity_id", "capture_id").agg((F.count(F.lit(1)) / F.first("n")).alias("part"))
    return hits.groupBy("mention_id", "entity_id").agg(F.max("part").alias("together"))


def score_candidates(candidates: DataFrame, mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates with the best name similarity and the weighted score in [0, 1].

    ``together`` (see ``co_occurrence``) and ``days_since_contact`` (from the
    last contact to the note; negative ones say nothing) are used if the
    candidates have them.
    """
    texts = mentions.select("mention_id", normalise_name(F.col("mention_text")).alias("x")).distinct()
    spelt = names.select("entity_id", normalise_name(F.col("spelling")).alias("y")).distinct()
    best = candidates.select("mention_id", "entity_id").join(texts, "mention_id").join(spelt, "entity_id").groupBy("mention_id", "entity_id").agg(F.max(text_similarity(F.col("x"), F.col("y"))).alias("name_similarity"))
    has = set(candidates.columns)
    unit = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    together = unit(F.col("together")) if "together" in has else F.lit(0.0)
    recency = unit(F.when(F.col("days_since_contact") >= 0, 1 - F.col("days_since_contact") / RECENCY_DAYS)) if "days_since_contact" in has else F.lit(0.0)
    score = WEIGHTS["name"] * F.coalesce("name_similarity", F.lit(0.0)) + WEIGHTS["sources"] * F.col("sources") / 3 + WEIGHTS["together"] * together + WEIGHTS["recency"] * recency
    return candidates.join(best, ["mention_id", "entity_id"], "left").withColumn("score", unit(score))


def chosen_index(choice: Column, candidates: Column) -> Column:
    """The place, from 0, of an answer given from 1; null for none and for one that isn't among the candidates."""
    return F.when((choice >= 1) & (choice <= candidates) & (choice == F.floor(choice)), (choice - 1).cast("int"))


def adjudicate(resolved: DataFrame, listed: DataFrame, answers: DataFrame) -> DataFrame:
    """Outcomes with ambiguous mentions decided by answers: the candidate chosen, or rejected_candidates.

    resolved: as ``resolve`` gives it; listed: as ``shortlist`` gives it;
    answers: (mention_id, choice), from 1, of whoever is asked. The score, as
    the confidence of the match, stays what it was.
    """
    options = listed.groupBy("mention_id").agg(F.count(F.lit(1)).alias("options"))
    given = answers.join(options, "mention_id").withColumn("at", chosen_index(F.col("choice"), F.col("options"))).select("mention_id", "at")
    picked = given.join(listed.select("mention_id", (F.col("choice") - 1).cast("int").alias("at"), F.col("entity_id").alias("picked")), ["mention_id", "at"], "left").select("mention_id", "picked", F.lit(True).alias("answered"))
    decides = F.col("is_ambiguous") & F.coalesce("answered", F.lit(False))
    outcome = F.when(decides & F.col("picked").isNull(), "rejected_candidates").otherwise(F.col("outcome"))
    return resolved.join(picked, "mention_id", "left").select("mention_id", outcome.alias("outcome"), F.when(decides, F.col("picked")).otherwise(F.col("entity_id")).alias("entity_id"), "score", "margin", F.coalesce(F.col("is_ambiguous"), F.lit(False)).alias("was_adjudicated"))


def resolve(scored: DataFrame, mentions: DataFrame) -> DataFrame:
    """(mention_id, outcome, entity_id, score, margin, is_ambiguous) of every mention."""
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "source_rank", "entity_id")
    ranked = scored.withColumn("nth", F.row_number().over(order)).withColumn("runner_up", F.lead("score").over(order)).filter("nth = 1")
    all_of = mentions.select("mention_id").distinct().join(ranked, "mention_id", "left")
    outcome = F.when(F.coalesce("score", F.lit(0.0)) < UNAMBIGUOUS_BELOW, "unambiguous").when(F.col("score") < MATCHED_FROM, "rejected_candidates").otherwise("matched")
    margin = F.coalesce(F.col("score") - F.col("runner_up"), (F.col("score") - MATCHED_FROM) / (1 - MATCHED_FROM))
    matched = F.col("outcome") == "matched"
    return all_of.withColumn("outcome", outcome).select(
        "mention_id", "outcome", F.when(matched, F.col("entity_id")).alias("entity_id"), "score", F.when(matched, margin).alias("margin"),
        (matched & (margin < CLEAR_MARGIN)).alias("is_ambiguous"),
    )


def shortlist(scored: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """(mention_id, choice, entity_id, score): the candidates put before an adjudicator, in order from 1."""
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), "source_rank", "entity_id")
    return scored.withColumn("choice", F.row_number().over(order)).filter(F.col("choice") <= k).select("mention_id", "choice", "entity_id", "score")


def duplicate_pairs(entities: DataFrame, aliases: DataFrame, least: float = DUPLICATE_LEAST) -> DataFrame:
    """(duplicate_id, survivor_id, merged_id, similarity): entities of a type with similar names; the smaller id survives.

    Similarity is worked out once for each pair of distinct spellings.
    """
    names = cut(all_names(entities, aliases).select("entity_id", "entity_type", normalise_name(F.col("spelling")).alias("x")).distinct())
    close = similar_spellings(names.select("entity_type", "x"), None, least)
    pairs = names.join(close, ["entity_type", "x"]).join(names.select(F.col("entity_id").alias("other_id"), "entity_type", F.col("x").alias("y")), ["entity_type", "y"])
    once = (F.col("entity_id") < F.col("other_id")) | (F.col("x") < F.col("y")) & (F.col("entity_id") > F.col("other_id"))
    best = pairs.filter(once).groupBy(F.least("entity_id", "other_id").alias("survivor_id"), F.greatest("entity_id", "other_id").alias("merged_id")).agg(F.max("similarity").alias("similarity"))
    return best.select(duplicate_id(F.col("survivor_id"), F.col("merged_id")).alias("duplicate_id"), "survivor_id", "merged_id", "similarity")
