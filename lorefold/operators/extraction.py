"""Reading what an extractor said, and the ports by which models are asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.functions import confidence as C
from lorefold.operators.triage import OWN_FIELDS, field_schema

_ANSWER = "mentions array<struct<text: string, entity_type: string, confidence: double, fields: array<struct<field: string, value: string>>>>"


def parse_extraction(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, fields, violations) of (capture_id, answer), the JSON that an extractor gave.

    mentions: (capture_id, at, entity_type, text, confidence), ``at`` counting
    from 0 in the answer; a mention of no known type is dropped and recorded,
    one without text is dropped. An unstated confidence is 0.5, others lie in
    [0, 1]. fields: (capture_id, at, field, value) as declared for the type;
    unknown and derived ones are dropped and recorded. violations:
    (capture_id, at, violation, detail). An unreadable answer says nothing.
    """
    spark = answers.sparkSession
    read = answers.filter("capture_id IS NOT NULL").select("capture_id", F.posexplode(F.from_json("answer", _ANSWER)["mentions"]).alias("at", "m"))
    rows = read.select("capture_id", "at", F.col("m.entity_type").alias("entity_type"), F.trim("m.text").alias("text"), C.clamp_unit(F.col("m.confidence")).alias("confidence"), F.col("m.fields").alias("fields"))
    is_known = F.coalesce(F.col("entity_type").isin(*OWN_FIELDS), F.lit(False))
    kept = rows.filter(is_known & (F.length("text") > 0))
    stated = kept.select("capture_id", "at", "entity_type", F.explode("fields").alias("f")).select("capture_id", "at", "entity_type", F.coalesce("f.field", F.lit("")).alias("field"), F.col("f.value").alias("value"))
    checked = stated.join(F.broadcast(field_schema(spark).select("entity_type", "field", "is_derived")), ["entity_type", "field"], "left")  # a fixed list
    unknown_type = rows.filter(~is_known).select("capture_id", "at", F.lit("unknown_entity_type").alias("violation"), F.coalesce("entity_type", F.lit("")).alias("detail"))
    dropped = checked.filter("is_derived IS NULL OR is_derived").select("capture_id", "at", F.when(F.col("is_derived").isNull(), "unknown_field").otherwise("derived_field").alias("violation"), F.col("field").alias("detail"))
    return kept.select("capture_id", "at", "entity_type", "text", "confidence"), checked.filter("NOT is_derived AND value IS NOT NULL").select("capture_id", "at", "field", "value"), unknown_type.unionAll(dropped)


def to_extract(captures: DataFrame, recorded: DataFrame, again: bool = False) -> DataFrame:
    """Captures that an extractor is to be asked about: those without recorded proposals, or all if they are asked again."""
    return captures if again else captures.join(recorded.select("capture_id").distinct(), "capture_id", "left_anti")


def ask(texts: DataFrame, port: Callable[[list[str]], list[str]]) -> DataFrame:
    """(capture_id, answer): what a model says to (capture_id, text), asked in batches; it has to answer each text."""
    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = port(batch["text"].tolist())
            if len(said) != len(batch):
                raise ValueError(f"{len(batch)} texts asked, {len(said)} answered")
            yield pd.DataFrame({"capture_id": batch["capture_id"], "answer": said})

    return texts.select("capture_id", "text").mapInPandas(answer, "capture_id string, answer string")


def embed(texts: DataFrame, port: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(key, embedding) of (key, text) by a model, asked in batches; it has to give a vector for each text, in order."""
    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = port(batch["text"].tolist())
            if len(said) != len(batch):
                raise ValueError(f"{len(batch)} texts given, {len(said)} vectors returned")
            yield pd.DataFrame({"key": batch["key"], "embedding": said})

    return texts.select("key", "text").mapInPandas(vectors, "key string, embedding array<double>")


def canned(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """(capture_id, answer): answers known beforehand by trimmed text, as a port for tests; null for others."""
    known = answers.select(F.trim("text").alias("k"), "answer").dropDuplicates(["k"])
    return texts.withColumn("k", F.trim("text")).join(known, "k", "left").select("capture_id", "answer")
