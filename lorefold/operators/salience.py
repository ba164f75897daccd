"""Salience scores, activity history, and the sections of daily and weekly briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefold.functions.dates import days_between

# Weights, steps and caps of the sections.
RECENCY, RECENCY_DAYS, OPEN_LOOP, DEBT, DORMANCY = 40.0, 30.0, 25.0, 15.0, 20.0
IMMINENCE = ((2, 30.0), (7, 20.0), (30, 10.0))
CLOSED = ("done", "dropped", "abandoned")
DAILY_CAPS = {"Today": 8, "Worth doing": 5, "Looks stuck": 3, "Coming up": 5}
WEEKLY_CAPS = {"What moved": 8, "What didn't": 5, "Open loops": 8, "New this week": 10, "People": 6}


def history(events: DataFrame, now: Column) -> DataFrame:
    """(entity_id, first_at, last_at, this_week, last_week, status_changed, changes_ever) of each aggregate.

    First and last follow the order of the log, not of time; events after
    ``now`` count as this week. One pass of partial aggregates.
    """
    ago = days_between(F.col("recorded_at"), now)
    return events.groupBy(F.col("aggregate_id").alias("entity_id")).agg(
        F.min_by("recorded_at", "position").alias("first_at"), F.max_by("recorded_at", "position").alias("last_at"),
        F.count_if(ago <= 7).alias("this_week"), F.count_if((ago > 7) & (ago <= 14)).alias("last_week"),
        F.coalesce(F.bool_or((F.col("type") == "FieldSet") & (F.col("field") == "status") & (ago <= 7)), F.lit(False)).alias("status_changed"), F.count(F.lit(1)).alias("changes_ever"),
    )


def salience_terms(entities: DataFrame, now: Column) -> DataFrame:
    """Entities with recency, open_loop, imminence, attention_debt, dormancy and salience.

    entities: (entity_id, entity_type, status, due_at, has_outcome, last_mentioned);
    what was never mentioned counts as mentioned now. People have recency only.
    """
    silent = days_between(F.coalesce("last_mentioned", now), now)
    kind, status = F.col("entity_type"), F.coalesce("status", F.lit(""))
    recency = F.when(silent <= 0, RECENCY).when(silent >= RECENCY_DAYS, 0.0).otherwise(RECENCY * (1 - silent / RECENCY_DAYS))
    loop = F.when((kind == "Project") & status.isin("active", "blocked") | (kind == "Task") & (status == "open"), OPEN_LOOP).otherwise(0.0)
    until = days_between(now, F.col("due_at"))
    closed = status.isin(*CLOSED)
    near = F.when(until.isNull(), 0.0).when(until < 0, F.when(closed, 0.0).otherwise(IMMINENCE[0][1]))
    for days, points in IMMINENCE:
        near = near.when(until <= days, points)
    near = near.otherwise(0.0)
    debt = F.when((kind == "Project") & (status == "blocked") & (silent >= 14) | (kind == "Task") & (status == "open") & (silent >= 30), DEBT).otherwise(0.0)
    dormant = F.when(closed | (kind == "Event") & F.coalesce("has_outcome", F.lit(False)) & (until < -7), DORMANCY).otherwise(0.0)
    person = kind == "Person"
    terms = {"recency": recency, "open_loop": loop, "imminence": near, "attention_debt": debt, "dormancy": dormant}
    for name, term in terms.items():
        entities = entities.withColumn(name, term if name == "recency" else F.when(person, 0.0).otherwise(term))
    total = F.col("recency") + F.col("open_loop") + F.col("imminence") + F.col("attention_debt") - F.col("dormancy")
    return entities.withColumn("salience", F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)))


def person_association(scored: DataFrame, relations: DataFrame) -> DataFrame:
    """People with ``association``, the best score of a related project, task or event, and salience with it."""
    edges = relations.select(F.col("from_id").alias("entity_id"), F.col("to_id").alias("other"), F.col("to_type").alias("t")).unionAll(relations.select("to_id", "from_id", "from_type")).filter(F.col("t").isin("Project", "Task", "Event")).distinct()
    best = edges.join(scored.select(F.col("entity_id").alias("other"), F.col("salience").alias("s")), "other", "left").groupBy("entity_id").agg(F.max(F.coalesce("s", F.lit(0.0))).alias("association"))
    people = scored.filter("entity_type = 'Person'").join(best, "entity_id", "left").withColumn("association", F.coalesce("association", F.lit(0.0)))
    return people.withColumn("salience", F.least(F.col("recency") + F.col("association"), F.lit(100.0)))


def with_association(scored: DataFrame, relations: DataFrame) -> DataFrame:
    """All entities with their final salience: people by recency and association, others by their own terms."""
    people = person_association(scored, relations).select(*scored.columns)
    return scored.filter("entity_type IS NULL OR entity_type <> 'Person'").unionByName(people)


def rank(scored: DataFrame, k: int) -> DataFrame:
    """The k most salient entities; equal scores by id."""
    return scored.orderBy(F.desc("salience"), "entity_id").limit(k)


def _sections(parts: list[tuple[str, DataFrame]], caps: dict[str, int]) -> DataFrame:
    listed = None
    for heading, rows in parts:
        part = rows.withColumn("heading", F.lit(heading))
        listed = part if listed is None else listed.unionByName(part)
    order = Window.partitionBy("heading").orderBy(F.desc("salience"), "entity_id")
    cap = F.coalesce(*[F.when(F.col("heading") == h, F.lit(n)) for h, n in caps.items()])
    # the constant bound lets Spark keep the best of every partition before the shuffle by heading
    return listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(caps.values())).filter(F.col("rank") <= cap)


def daily_sections(scored: DataFrame, now: Column) -> DataFrame:
    """Today, Worth doing, Looks stuck and Coming up, each ranked and capped."""
    until = days_between(now, F.col("due_at"))
    open_task = "entity_type = 'Task' AND status = 'open'"
    today = scored.filter(open_task).filter(until < 1).unionByName(scored.filter("entity_type = 'Event'").filter(F.to_date("due_at") == F.to_date(now)))
    actionable = scored.filter(f"({open_task}) OR (entity_type = 'Project' AND status = 'active')").join(today.select("entity_id").distinct(), "entity_id", "left_anti")
    coming = scored.filter(~F.coalesce(F.col("status").isin(*CLOSED), F.lit(False))).filter(until.between(0, 7))
    parts = [("Today", today), ("Worth doing", actionable.select(*scored.columns)), ("Looks stuck", scored.filter("attention_debt > 0")), ("Coming up", coming)]
    return _sections(parts, DAILY_CAPS)


def weekly_sections(scored: DataFrame, activity: DataFrame) -> DataFrame:
    """What moved, What didn't, Open loops, New this week and People, each ranked and capped; ``scored`` has association in it."""
    columns = scored.columns
    known = scored.join(activity.select("entity_id", "this_week", "last_week", "status_changed", "is_new"), "entity_id", "left")
    week = F.coalesce("this_week", F.lit(0))
    moved = known.filter(F.coalesce("status_changed", F.lit(False)) | (week > F.coalesce("last_week", F.lit(0))))
    still = known.filter(F.col("open_loop") > 0).filter(week == 0)
    parts = [
        ("What moved", moved.select(*columns)), ("What didn't", still.select(*columns)), ("Open loops", scored.filter("open_loop > 0")),
        ("New this week", known.filter("is_new").select(*columns)), ("People", known.filter("entity_type = 'Person'").filter(week > 0).select(*columns)),
    ]
    return _sections(parts, WEEKLY_CAPS)
