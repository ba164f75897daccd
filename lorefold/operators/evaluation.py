"""Metrics of extraction, resolution and attention, and percentiles by rank."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefold.session import cut

#: Ranges that the values of a group are counted by.
RANGES = 64


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def extraction_metrics(cases: DataFrame) -> DataFrame:
    """One row of recall, precision, field accuracy, violation rate and mean confidence; nothing of nothing is 1, or 0 for errors.

    cases: (expected, found, correct, fields, fields_right, emitted, violations, confidence).
    """
    total = cases.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "found", "correct", "fields", "fields_right", "emitted", "violations")], F.avg("confidence").alias("mean_confidence"))
    return total.select(
        ratio(F.col("correct"), F.col("expected"), 1.0).alias("recall"), ratio(F.col("correct"), F.col("found"), 1.0).alias("precision"),
        ratio(F.col("fields_right"), F.col("fields"), 1.0).alias("field_accuracy"), ratio(F.col("violations"), F.col("emitted"), 0.0).alias("violation_rate"),
        F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"),
    )


def resolution_metrics(rows: DataFrame) -> DataFrame:
    """One row for (expected_id, actual_id, was_adjudicated): counts of verdicts and their rates."""
    expects, got = F.col("expected_id").isNotNull(), F.col("actual_id").isNotNull()
    verdict = (
        F.when(expects & got & (F.col("expected_id") == F.col("actual_id")), "right_match").when(expects & got, "wrong_match")
        .when(expects, "missed").when(got, "false_match").otherwise("right_none")
    )
    count = lambda v: F.count_if(F.col("verdict") == v)
    total = rows.withColumn("verdict", verdict).agg(
        *[count(v).alias(v) for v in ("right_match", "wrong_match", "missed", "false_match", "right_none")], F.count_if("was_adjudicated").alias("adjudicated"), F.count(F.lit(1)).alias("cases")
    )
    wrong = F.col("wrong_match") + F.col("missed") + F.col("false_match")
    return total.select(
        "*", ratio(F.col("right_match"), F.col("right_match") + F.col("wrong_match") + F.col("missed"), 1.0).alias("match_accuracy"),
        ratio(F.col("right_none"), F.col("right_none") + F.col("false_match"), 1.0).alias("none_accuracy"),
        F.when(wrong > 0, F.col("wrong_match") / wrong).alias("wrong_match_share"), ratio(F.col("adjudicated"), F.col("cases"), 0.0).alias("adjudication_rate"),
    )


def percentile_by_rank(rows: DataFrame, group: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """The values at index floor(n * fraction) of each group's sorted values.

    Counts of distinct values are summed up by ranges first, then within the
    one range of each group that holds the place, so no group passes through
    one task as a whole.
    """
    counted = cut(rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n")))
    parts = [i / RANGES for i in range(1, RANGES)]
    bounds = counted.groupBy(F.col(group).alias("of")).agg(F.percentile_approx(value, parts, 10_000).alias("bounds"), F.sum("n").alias("all"))
    ranged = cut(counted.join(bounds, F.col(group).eqNullSafe(F.col("of"))).select(group, value, "n", "all", F.size(F.filter("bounds", lambda b: b < F.col(value))).alias("range")))
    sizes = ranged.groupBy(group, "range").agg(F.sum("n").alias("in_range"), F.first("all").alias("all"))  # RANGES rows of a group at most
    before = sizes.withColumn("before", F.sum("in_range").over(Window.partitionBy(group).orderBy("range")) - F.col("in_range"))
    places = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.floor(F.col("all") * f).alias("place")) for name, f in fractions.items()]))
    wanted = before.select(F.col(group).alias("of_group"), F.col("range").alias("of_range"), "before", "in_range", places.alias("p")).filter((F.col("p.place") >= F.col("before")) & (F.col("p.place") < F.col("before") + F.col("in_range")))
    inside = ranged.withColumn("upto", F.sum("n").over(Window.partitionBy(group, "range").orderBy(value)))
    found = inside.join(wanted, F.col(group).eqNullSafe(F.col("of_group")) & (F.col("range") == F.col("of_range"))).filter(F.col("before") + F.col("upto") > F.col("p.place"))
    picked = found.groupBy(group, F.col("p.name").alias("name")).agg(F.min(value).alias("v"))
    return picked.groupBy(group).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in fractions])


def attention_signal(surfaced: DataFrame, opens: DataFrame) -> DataFrame:
    """One row: entities surfaced, of these opened, opens of others and their mean salience (0 of none).

    surfaced: (entity_id); opens: (entity_id, salience).
    """
    shown = surfaced.select("entity_id").distinct()
    hit = opens.join(shown, "entity_id", "left_semi").agg(F.countDistinct("entity_id").alias("surfaced_and_opened"))
    other = opens.join(shown, "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("opened_unsurfaced"), F.coalesce(F.avg("salience"), F.lit(0.0)).alias("mean_unsurfaced_salience"))
    return shown.agg(F.count(F.lit(1)).alias("surfaced")).join(F.broadcast(hit)).join(F.broadcast(other))  # one row each


def relation_mix(relations: DataFrame, vocabulary: list[str], catch_all: str) -> DataFrame:
    """(relation, n, catch_all_share): counts of every name of the vocabulary, zeros too."""
    names = relations.sparkSession.createDataFrame([(v,) for v in vocabulary], "relation string")
    counted = relations.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    share = counted.agg(F.sum(F.when(F.col("relation") == catch_all, F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("all"))
    return names.join(counted, "relation", "left").join(F.broadcast(share)).select("relation", F.coalesce("n", F.lit(0)).alias("n"), ratio(F.coalesce("c", F.lit(0)), F.coalesce("all", F.lit(0)), 0.0).alias("catch_all_share"))


def greedy_matches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, expected_at, actual_at): one-to-one matches of mentions in order, by type and equal or contained text.

    expected, actual: (case_id, at, entity_type, text). Cases are single notes.
    """
    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free, out = right.sort_values("at").to_dict("records"), []
        for want in left.sort_values("at").itertuples():
            x = want.text.strip().lower()
            for i, got in enumerate(free):
                y = got["text"].strip().lower()
                if got["entity_type"] == want.entity_type and (x == y or x in y or y in x):
                    out.append((want.case_id, want.at, free.pop(i)["at"]))
                    break
        return pd.DataFrame(out, columns=["case_id", "expected_at", "actual_at"])

    return expected.groupBy("case_id").cogroup(actual.groupBy("case_id")).applyInPandas(match, "case_id string, expected_at long, actual_at long")


def contains_noun(text: Column, noun: Column) -> Column:
    """Whether ``noun`` stands in the text as a word of its own, in any case; word characters are the ASCII ones."""
    word = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    escaped = F.regexp_replace(noun, r"([\\\^$.|?*+()\[\]{}\-])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit("(?iu)" + word), escaped, F.lit(word)))


def noun_recall(rows: DataFrame) -> DataFrame:
    """(expected, heard, recall) of (text, noun): the part of proper nouns that a transcript kept; 0 of none."""
    total = rows.agg(F.count(F.lit(1)).alias("expected"), F.count_if(contains_noun(F.col("text"), F.col("noun"))).alias("heard"))
    return total.select("expected", "heard", ratio(F.col("heard"), F.col("expected"), 0.0).alias("recall"))


def thresholds_for(models: DataFrame, measured: DataFrame, auto_from: float, review_from: float) -> DataFrame:
    """Models (provider, model_version) with their measured thresholds (model, auto_from, review_from), or the usual ones.

    A model is addressed as provider/model_version.
    """
    keyed = models.withColumn("model", F.concat_ws("/", "provider", "model_version"))
    own = measured.select("model", F.col("auto_from").alias("a"), F.col("review_from").alias("r"))
    return keyed.join(own, "model", "left").select(*models.columns, "model", F.coalesce("a", F.lit(auto_from)).alias("auto_from"), F.coalesce("r", F.lit(review_from)).alias("review_from"))
