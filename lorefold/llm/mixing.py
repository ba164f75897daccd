"""Mixing sources to target shares of all tokens."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.llm.tokens import TOKENIZER_DIR, token_counts
from lorefold.session import cut

#: Labelled rows on which the classifier is fitted, at most, and the features it hashes words into.
FIT_ROWS = 20_000
FEATURES = 1 << 14
#: The mixture holds at least this part of the corpus' tokens, even where small sources then fall short.
LEAST_SIZE = 0.25
#: Gradient steps at most, and the error of a share at which they end.
ROUNDS = 30
TOLERANCE = 1e-4
#: Rows of a source that are rounded in one task.
SHARD_ROWS = 20_000
_WORD = re.compile(r"[^\W_]+")


def _features(text: str | None) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) % FEATURES for w in _WORD.findall((text or "").lower())], np.int64)


def fit_sources(texts: list[str], labels: list[int], classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Multinomial naive Bayes (log priors, log likelihoods) and a temperature fitted on held-out rows."""
    rows = [_features(t) for t in texts]
    held = [i for i in range(len(rows)) if i % 5 == 0 and len(rows) > 10]
    counts, prior = np.full((classes, FEATURES), 0.1), np.full(classes, 1e-3)
    for i, (row, label) in enumerate(zip(rows, labels, strict=True)):
        if not held or i % 5:
            np.add.at(counts[label], row, 1)
            prior[label] += 1
    like, base = np.log(counts / counts.sum(1, keepdims=True)), np.log(prior / prior.sum())
    best, temperature = -np.inf, 1.0
    for t in (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.0):
        fit = sum(np.log(posterior(rows[i], base, like, t)[labels[i]] + 1e-12) for i in held)
        if fit > best:
            best, temperature = fit, t
    return base, like, temperature


def posterior(row: np.ndarray, base: np.ndarray, like: np.ndarray, temperature: float) -> np.ndarray:
    score = base + temperature * like[:, row].sum(1)
    odds = np.exp(score - score.max())
    return odds / odds.sum()


def mix_documents(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer_dir: str = TOKENIZER_DIR, least_size: float = LEAST_SIZE) -> DataFrame:
    """(doc_id, source, target_source, tokens, rate, copies): how often every document is used.

    Documents belong to their source; those without a source (or with one that
    has no target) belong softly to all, by the posterior of a classifier
    fitted on labelled rows of the table. Nonnegative rates, up to the
    ``max_repeats`` of the (likeliest) source, are fitted by projected gradient
    steps of least squares, scaled by the tokens each source has: every step is
    one distributed sum of expected tokens by source, and the driver holds one
    number for each source and step. Rates become whole copies from the largest
    document down, each rounding error being carried on to the next.

    The total is ``total_tokens`` or else the largest at which every source
    that has documents reaches its share, but at least ``least_size`` of the
    corpus; with 0 every such source reaches its share. Sources without documents stay at nothing. Null shares count as 0,
    null ``max_repeats`` as 1; a source that is named twice has its largest
    share. Null and empty texts have no tokens and are used as often as their
    rate says. Without targets or documents there are no rows.
    """
    spark = documents.sparkSession
    schema = "doc_id long, source string, target_source string, tokens long, rate double, copies long"
    goal = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).orderBy("source").collect()  # a short parameter table
    if not goal:
        return spark.createDataFrame([], schema)
    names = [r.source for r in goal]
    share = np.array([max(0.0, r.s or 0.0) for r in goal])
    most = np.array([1.0 if r.m is None else max(0, r.m) for r in goal])
    place = F.coalesce(*[F.when(F.col("source") == n, F.lit(i)) for i, n in enumerate(names)], F.lit(-1))
    rows = documents.select("doc_id", "source", "text", place.alias("c"))

    labelled = rows.filter("c >= 0 AND text IS NOT NULL")
    found = labelled.count()
    part = labelled if found <= FIT_ROWS else labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * FIT_ROWS / found) + 1)
    # in the order of a hash, so that the bound takes no part of the table before another
    sample = part.select("text", "c", F.xxhash64("doc_id", F.lit(1)).alias("o")).orderBy("o", "text").limit(FIT_ROWS).drop("o").toArrow()
    model = spark.sparkContext.broadcast(fit_sources(sample.column("text").to_pylist(), sample.column("c").to_pylist(), len(names)))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, like, temperature = model.value
        for b in batches:
            shares = [posterior(_features(t), base, like, temperature).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("text"), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "source", "text", "p"])

    one_hot = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: (i == F.col("c")).cast("double"))
    member = rows.filter("c >= 0").select("doc_id", "source", "text", one_hot.alias("p")).unionByName(
        rows.filter("c < 0").drop("c").mapInArrow(classify, "doc_id long, source string, text string, p array<double>")
    )
    sized = token_counts(member, ["doc_id", "source", "p"], tokenizer_dir)
    likeliest = F.array_position("p", F.array_max("p")).cast("int")
    table = cut(
        sized.withColumn("target_source", F.element_at(F.array(*map(F.lit, names)), likeliest))
        .withColumn("most", F.element_at(F.array(*[F.lit(float(m)) for m in most]), likeliest))
    )

    def totals(rate) -> np.ndarray:
        got = table.agg(*[F.sum(rate * F.col("tokens") * F.col("p")[i]).alias(f"t{i}") for i in range(len(names))]).first()
        return np.array([got[i] or 0.0 for i in range(len(names))])

    have = totals(F.lit(1.0))
    room = totals(F.col("most"))
    if not have.sum():
        return table.select("doc_id", "source", "target_source", "tokens", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
    reachable = (room > 0) & (share > 0)
    if total_tokens is None:
        full = min((room[i] / share[i] for i in np.flatnonzero(reachable)), default=have.sum())
        total_tokens = max(full, least_size * have.sum())
    wanted = share * total_tokens
    start = np.where(have > 0, wanted / np.maximum(have, 1), 0.0)
    steps = [start]

    def rate_after(moves: list[np.ndarray]):
        """The rate of a document: its moves in order, each followed by the projection onto [0, most]."""
        held = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves])
        return F.aggregate(held, F.lit(0.0), lambda r, m: F.least(F.greatest(r + F.aggregate(F.zip_with("p", m, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), F.lit(0.0)), F.col("most")))

    while len(steps) < ROUNDS:
        error = wanted - totals(rate_after(steps))
        capped = (np.sum(steps, axis=0) >= most) & (error > 0)
        if (np.abs(error) < TOLERANCE * total_tokens)[reachable & ~capped].all():
            break
        steps.append(np.where((have > 0) & ~capped, error / np.maximum(have, 1), 0.0))

    counted = {r.target_source: r.n for r in table.groupBy("target_source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each target
    shards = F.element_at(F.create_map(*[x for k, n in counted.items() for x in (F.lit(k), F.lit(-(-n // SHARD_ROWS)))]), F.col("target_source"))
    rated = table.select(
        "doc_id", "source", "target_source", "tokens", "most", rate_after(steps).alias("rate"), F.pmod(F.xxhash64("doc_id"), shards).alias("shard")
    )

    def to_copies(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id"], ascending=False)
        owed, copies = 0.0, []
        for rate, size, limit in zip(pdf["rate"], pdf["tokens"], pdf["most"], strict=True):
            whole = np.floor(rate)
            owed += (rate - whole) * size
            more = rate > whole and whole < limit and 2 * owed >= size
            owed -= size * more
            copies.append(int(whole + more))
        return pdf.assign(copies=copies)[["doc_id", "source", "target_source", "tokens", "rate", "copies"]]

    return rated.groupBy("target_source", "shard").applyInPandas(to_copies, schema)


def mixture_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, share_as_target, documents, used_documents, used_tokens, most_copies): the shares really reached.

    ``reached_share`` goes by the source that documents state; those without
    one are the row with a null source. ``share_as_target`` goes by the source
    that each document most likely belongs to, stated or not, which is what the
    targets are about.
    """
    used = mixture.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("copies") > 0).alias("used_documents"),
        F.sum(F.col("copies") * F.col("tokens")).alias("used_tokens"), F.max("copies").alias("most_copies"),
    )
    as_target = mixture.groupBy(F.col("target_source").alias("k")).agg(F.sum(F.col("copies") * F.col("tokens")).alias("as_target"))
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    joined = wanted.join(used, wanted["source"].eqNullSafe(used["source"]), "full").select(
        F.coalesce(wanted["source"], used["source"]).alias("source"), "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "used_documents", "used_tokens", "most_copies")]
    ).join(F.broadcast(as_target), F.col("source") == F.col("k"), "left")  # a row for each target
    total = joined.agg(F.sum("used_tokens").alias("all_tokens"))
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.greatest("all_tokens", F.lit(1))
    return joined.join(F.broadcast(total)).select(  # one row
        "source", "target_share", part("used_tokens").alias("reached_share"), part("as_target").alias("share_as_target"), "documents", "used_documents", "used_tokens", "most_copies"
    )
