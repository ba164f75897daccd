"""One object for an application: the engine's reads over a data folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.operators import captures, event_store, fold, reads, resolution, salience, search, stores
from lorefold.sources.tables import table


class Engine:
    """Reads and batch writes over the tables of ``data_dir``; every method returns a DataFrame."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark, self.data_dir = spark, data_dir

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.data_dir, name)

    def _now(self, now: datetime):
        return F.lit(now).cast("timestamp")

    def events(self) -> DataFrame:
        return fold.read_log(self._table("event_log"))

    def ingest(self, arriving: DataFrame) -> DataFrame:
        """The captures that (source, text, source_timestamp) rows would add."""
        return captures.ingest(arriving, self._table("captures"))

    def append(self, arriving: DataFrame) -> DataFrame:
        """The log rows that events would add, with their positions."""
        return event_store.append_events(self._table("event_log"), arriving)

    def recover(self) -> DataFrame:
        """Captures whose ingestion event is missing from the log."""
        return captures.without_event(self._table("captures"), self._table("event_log"))

    def entity_view(self, entity_id: str) -> DataFrame:
        """The fields an entity holds, with the event each value comes from; what it absorbed in merges is among them."""
        return fold.fold_fields(self.events()).filter(F.col("entity_id") == entity_id)

    def relations_of(self, entity_id: str) -> DataFrame:
        return fold.fold_relations(self.events()).filter((F.col("from_id") == entity_id) | (F.col("to_id") == entity_id))

    def entities_of_type(self, entity_type: str) -> DataFrame:
        return fold.created(self.events()).filter(F.col("entity_type") == entity_type).select(F.col("aggregate_id").alias("entity_id"))

    def search_captures(self, query: str, limit: int = 20) -> DataFrame:
        return search.search(captures.effective_text(self._table("captures")).withColumnRenamed("capture_id", "doc_key"), query, limit)

    def search_entities(self, query: str, limit: int = 20) -> DataFrame:
        return search.search(reads.entity_texts(self.events()), query, limit)

    def rank(self, now: datetime, k: int = 20) -> DataFrame:
        """The most salient entities at ``now``, people by what they are related to."""
        at = self._now(now)
        scored = salience.salience_terms(reads.salient_entities(self.events(), at), at)
        return salience.rank(salience.with_association(scored, fold.fold_relations(self.events())), k)

    def daily_brief(self, now: datetime) -> DataFrame:
        """(heading, prose) of the day's sections."""
        at = self._now(now)
        sections = salience.daily_sections(salience.salience_terms(reads.salient_entities(self.events(), at), at), at)
        return stores.brief_sections(sections.withColumn("name", F.coalesce("name", "entity_id")))

    def resolve(self, mentions: DataFrame) -> DataFrame:
        """Outcomes of (mention_id, mention_text, entity_type) against the projected entities, by name."""
        entities, aliases = self._table("projection_entities"), self._table("projection_aliases")
        names = resolution.all_names(entities, aliases)
        found = resolution.candidate_union(resolution.exact_candidates(mentions, names), resolution.fuzzy_candidates(mentions, entities))
        return resolution.resolve(resolution.score_candidates(found, mentions, names), mentions)

    def duplicates(self) -> DataFrame:
        """Pairs of entities that look like one, the likest first."""
        return resolution.duplicate_pairs(self._table("projection_entities"), self._table("projection_aliases")).orderBy(F.desc("similarity"), "duplicate_id")
