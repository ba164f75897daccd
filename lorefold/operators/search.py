"""Full-text search: an inverted index with positions, conjunctions of phrases, BM25."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.functions.text import fold_letters, tokens

# Parameters of BM25.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def _tokenised(texts: DataFrame) -> DataFrame:
    """(doc_key, t). Tokens come out of a generator, so that they are cut once and not again wherever ``t`` is used."""
    return texts.filter("doc_key IS NOT NULL").select("doc_key", F.explode(F.array(tokens(F.coalesce("text", F.lit(""))))).alias("t"))


def build_index(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings (doc_key, token, positions), lengths (doc_key, length)) of (doc_key, text)."""
    cut = _tokenised(texts)
    spread = cut.select("doc_key", F.posexplode("t").alias("at", "token"))
    return spread.groupBy("doc_key", "token").agg(F.sort_array(F.collect_list("at")).alias("positions")), cut.select("doc_key", F.size("t").alias("length"))


def match_query(text: str) -> list[list[str]]:
    """The phrases of a query: each word between blanks is one, made of its tokens; words without tokens are dropped."""
    return [p for w in fold_letters(text).split() if (p := re.findall(r"[^\W_]+", w))]


def _ranked(hits: DataFrame, stats: DataFrame, phrases: int, limit: int | None) -> DataFrame:
    """(doc_key, score) of (doc_key, length, f0, f1, ..): BM25 over texts that hold every phrase."""
    found = hits.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(phrases)])
    scored = hits.filter(" AND ".join(f"f{i} > 0" for i in range(phrases))).join(F.broadcast(stats)).join(F.broadcast(found))  # one row each
    total = F.lit(0.0)
    for i in range(phrases):
        idf = F.greatest(F.log((F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(IDF_FLOOR))
        total = total + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    ranked = scored.select("doc_key", (-total).alias("score"))
    return ranked if limit is None else ranked.orderBy("score", "doc_key").limit(limit)


def _places(phrase: list[str]) -> Column:
    """How often a phrase stands in the token array ``t``."""
    if len(phrase) == 1:
        return F.size(F.filter("t", lambda t: t == phrase[0]))
    begins = F.filter(F.transform("t", lambda t, i: F.when(t == phrase[0], i)), lambda i: i.isNotNull())
    return F.size(F.filter(begins, lambda i: F.slice("t", i + 1, len(phrase)) == F.array(*map(F.lit, phrase))))


def search(texts: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """(doc_key, score): texts (doc_key, text) that hold every phrase, the best first; a lower score is better.

    One scan for a query over texts without an index. Accents and case count
    neither in texts nor in queries. Null keys are left out, null texts hold
    nothing; a query without tokens finds nothing.
    """
    phrases = match_query(query)
    cut = _tokenised(texts)
    if not phrases:
        return cut.select("doc_key", F.lit(0.0).alias("score")).limit(0)
    hits = cut.select("doc_key", F.size("t").cast("double").alias("length"), *[_places(p).alias(f"f{i}") for i, p in enumerate(phrases)])
    stats = cut.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t")).alias("mean_length"))
    return _ranked(hits, stats, len(phrases), limit)


def _followed(column: str, step: int) -> Callable[[Column], Column]:
    return lambda start: F.array_contains(F.col(column), start + step)


def search_index(postings: DataFrame, lengths: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """``search`` over the postings and lengths of ``build_index``: only postings of the query's tokens are read.

    A phrase stands where a position of its first token is followed by those of
    the others, each in its place.
    """
    phrases = match_query(query)
    if not phrases:
        return lengths.select("doc_key", F.lit(0.0).alias("score")).limit(0)
    wanted = sorted({t for p in phrases for t in p})
    own = postings.filter(F.col("token").isin(wanted)).groupBy("doc_key").agg(
        *[F.coalesce(F.first(F.when(F.col("token") == t, F.col("positions")), ignorenulls=True), F.array().cast("array<int>")).alias(f"p{i}") for i, t in enumerate(wanted)]
    )
    counts = []
    for i, phrase in enumerate(phrases):
        begins, *others = [f"p{wanted.index(t)}" for t in phrase]
        for step, column in enumerate(others, 1):  # the places at which the next token follows too
            begins = F.filter(begins, _followed(column, step))
        counts.append(F.size(begins).alias(f"f{i}"))
    hits = own.select("doc_key", *counts).join(lengths.select("doc_key", F.col("length").cast("double").alias("length")), "doc_key")
    stats = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length"))
    return _ranked(hits, stats, len(phrases), limit)
