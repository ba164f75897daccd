"""The write side: executing commands, triage with its queue, confirming, correcting and proposing again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.functions import ids
from lorefold.operators.event_store import current_versions
from lorefold.operators.triage import diff_entities, field_schema, triage

# The event that each command becomes, all of version 1.
EVENT_FOR_COMMAND = (
    ("CreateEntity", "EntityCreated"),
    ("SetField", "FieldSet"),
    ("AddToSet", "SetMemberAdded"),
    ("ClearField", "FieldCleared"),
    ("RelateEntities", "EntitiesRelated"),
    ("MergeEntities", "EntitiesMerged"),
    ("IngestCapture", "CaptureIngested"),
    ("CorrectTranscript", "CaptureTranscriptCorrected"),
)
EVENT_VERSION = 1
HUMAN = "human"
MERGE = "MergeEntities"


def human_provenance(capture_id: Column, proposal_id: Column) -> list[Column]:
    """Provenance of what a person confirmed: no model and no confidence."""
    return [
        proposal_id.alias("proposal_id"), capture_id.alias("capture_id"), F.lit(HUMAN).alias("provider"), F.lit(HUMAN).alias("model_version"),
        F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("is_human_confirmed"),
    ]


def event_types(spark) -> DataFrame:
    """(type, event_type) of the commands that are known."""
    return spark.createDataFrame(list(EVENT_FOR_COMMAND), "type string, event_type string")


def _accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The version at which each command is applied, null if it expects another; commands of one aggregate follow each other in order."""
    aggregate, version = None, 0
    for batch in batches:
        at = []
        for own, expected, stored in zip(*(batch.column(n).to_pylist() for n in ("aggregate_id", "expected_version", "stored_version")), strict=True):
            if own != aggregate:
                aggregate, version = own, stored
            fits = expected is None or expected == version
            at.append(version if fits else None)
            version += fits
        yield pa.RecordBatch.from_arrays([batch.column("command_key"), pa.array(at, pa.int64())], names=["command_key", "at"])


def execute(commands: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """Commands with ``outcome`` (unknown_command, stale or applied) and the event that each applied one becomes.

    commands: (command_key, arrival, type, aggregate_type, aggregate_id,
    expected_version, payload, proposal_id, capture_id, provider,
    model_version, confidence, is_human_confirmed); ``command_key`` is unique.
    Commands of one aggregate are taken in order of arrival, ties by key; one
    that expects another version than the log and those before it have led to
    is stale and changes nothing; one that expects none (null) takes what it
    finds. Events are stamped with the version they were applied at.
    Only the commands of one aggregate, as rows in order, meet in a task.
    """
    known = commands.join(F.broadcast(event_types(commands.sparkSession)), "type", "left")  # a fixed list
    versions = current_versions(log.join(commands.select("aggregate_id").distinct(), "aggregate_id", "left_semi"))
    placed = known.filter("event_type IS NOT NULL").join(versions, "aggregate_id", "left").select("command_key", "arrival", "aggregate_id", "expected_version", F.coalesce("next_version", F.lit(0)).cast("long").alias("stored_version"))
    judged = placed.repartition("aggregate_id").sortWithinPartitions("aggregate_id", "arrival", "command_key").mapInArrow(_accepted, "command_key string, at long")
    outcome = F.when(F.col("event_type").isNull(), "unknown_command").when(F.col("at").isNotNull(), "applied").otherwise("stale")
    event = ids.event_id(*[F.col(c) for c in ("capture_id", "proposal_id", "type", "aggregate_id", "at", "provider", "model_version")])
    is_applied = F.col("outcome") == "applied"
    return known.join(judged, "command_key", "left").withColumn("outcome", outcome).withColumns({
        "event_id": F.when(is_applied, event), "event_version": F.when(is_applied, F.lit(EVENT_VERSION)), "aggregate_version": F.col("at"), "recorded_at": F.when(is_applied, now),
    }).drop("at")


def events_of(executed: DataFrame) -> DataFrame:
    """The rows that applied commands add to the log, without a position; ``append_events`` gives them one."""
    return executed.filter("outcome = 'applied'").select(
        "event_id", F.col("event_type").alias("type"), F.col("event_version").alias("version"), "aggregate_type", "aggregate_id", "aggregate_version", "payload", "proposal_id",
        "capture_id", "provider", "model_version", "confidence", "is_human_confirmed", "recorded_at",
    )


@dataclass
class Triaged:
    """dispositions (proposal_id, disposition, confidence, is_sampled, decided_at); queue: those not discarded; executed: the confident ones' commands with outcomes."""

    dispositions: DataFrame
    queue: DataFrame
    executed: DataFrame


def triage_all(proposals: DataFrame, corrections: DataFrame, log: DataFrame, now: Column, draw: str | None = None) -> Triaged:
    """Decides on proposals, queues what isn't discarded, and executes what is to be applied.

    proposals: the columns of ``triage`` and, as ``command_type``, ``arrival``,
    ``aggregate_type``, ``aggregate_id``, ``expected_version``, ``payload`` and
    ``capture_id``, those of their command. A confident proposal whose
    aggregate has moved on comes back as stale in ``executed``.
    """
    decided = triage(proposals, corrections, draw)
    dispositions = decided.select("proposal_id", "capture_id", "disposition", "confidence", "is_sampled", now.alias("decided_at"))
    queue = decided.filter("disposition <> 'discard'").select(
        "proposal_id", "capture_id", "command_type", "aggregate_type", "aggregate_id", "expected_version", "payload", "disposition", "confidence", "is_sampled", now.alias("queued_at"), F.lit(None).cast("timestamp").alias("adjudicated_at")
    )
    commands = decided.filter("disposition = 'auto_apply'").select(
        F.col("proposal_id").alias("command_key"), "arrival", F.col("command_type").alias("type"), "aggregate_type", "aggregate_id", "expected_version", "payload",
        "proposal_id", "capture_id", "provider", "model_version", "confidence", F.lit(False).alias("is_human_confirmed"),
    )
    return Triaged(dispositions, queue, execute(commands, log, now))


def _retargeted(commands: DataFrame, redirects: DataFrame) -> DataFrame:
    """Commands on the entity that theirs was merged into; moved ones and merges take the version they find.

    redirects: (id, final_id), one row for an id that was merged away.
    """
    moved = commands.join(redirects.select(F.col("id").alias("aggregate_id"), "final_id"), "aggregate_id", "left")
    restamps = F.col("final_id").isNotNull() | (F.col("type") == MERGE)
    return moved.withColumn("expected_version", F.when(~restamps, F.col("expected_version"))).withColumn("aggregate_id", F.coalesce("final_id", "aggregate_id")).drop("final_id")


def confirm(queue: DataFrame, confirmed: DataFrame, log: DataFrame, redirects: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(executed commands, queue rows with their stamp) of confirming proposals; those adjudicated already are left alone.

    confirmed: (proposal_id, arrival). Unknown proposals change nothing. A
    command that turns out stale leaves its entry open.
    """
    open_ = queue.filter("adjudicated_at IS NULL").join(confirmed.groupBy("proposal_id").agg(F.min("arrival").alias("arrival")), "proposal_id")
    commands = open_.select(
        F.col("proposal_id").alias("command_key"), "arrival", F.col("command_type").alias("type"), "aggregate_type", "aggregate_id", "expected_version", "payload",
        *human_provenance(F.col("capture_id"), F.col("proposal_id")),
    )
    executed = execute(_retargeted(commands, redirects), log, now)
    done = executed.filter("outcome = 'applied'").select("proposal_id", F.lit(True).alias("is_done"))
    stamped = queue.join(done, "proposal_id", "left").withColumn("adjudicated_at", F.when(F.col("is_done"), now).otherwise(F.col("adjudicated_at"))).drop("is_done")
    return executed, stamped


def correct(queue: DataFrame, chosen: DataFrame, corrections: DataFrame, log: DataFrame, redirects: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(executed commands, new corrections) of choosing another command for queued proposals.

    chosen: (proposal_id, arrival, type, aggregate_type, aggregate_id,
    payload). A correction recorded before under the same id is not made
    again. The chosen command takes the version that it finds its target at.
    """
    own = chosen.join(queue.select("proposal_id", "capture_id"), "proposal_id").withColumn("correction_id", ids.correction_id(F.col("proposal_id"), F.col("type"), F.col("aggregate_id"), F.col("payload")))
    fresh = own.dropDuplicates(["correction_id"]).join(corrections.select("correction_id").distinct(), "correction_id", "left_anti")
    commands = fresh.select(F.col("correction_id").alias("command_key"), "arrival", "type", "aggregate_type", "aggregate_id", F.lit(None).cast("long").alias("expected_version"), "payload", *human_provenance(F.col("capture_id"), F.col("proposal_id")))
    executed = execute(_retargeted(commands, redirects), log, now)
    made = executed.filter("outcome = 'applied'").select(F.col("command_key").alias("correction_id"))
    return executed, fresh.join(made, "correction_id").select("correction_id", "proposal_id", "capture_id", F.col("type").alias("chosen_type"), F.col("aggregate_id").alias("chosen_target_id"), F.col("payload").alias("chosen_payload"), now.alias("corrected_at"))


def correction_violations() -> Column:
    """Names of the fields of a correction that are missing; empty for a good one."""
    return F.array_compact(F.array(*[F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0, c) for c in ("correction_id", "proposal_id", "capture_id", "chosen_type", "chosen_target_id")]))


def repropose(proposals: DataFrame, claims: DataFrame, held: DataFrame, versions: DataFrame) -> DataFrame:
    """(proposal_id, outcome, field, value, change, expected_version, disposition): stale proposals against what is held now.

    proposals: (proposal_id, entity_id); claims: (proposal_id, entity_id,
    entity_type, field, value); versions: (entity_id, version) of entities that
    exist. Without its entity a proposal is closed as target_gone, without a
    change as no_change; else every change is proposed anew for review, at the
    entity's present version.
    """
    live = proposals.join(versions, "entity_id", "left")
    asked = claims.select("entity_id", "entity_type", "field", "value").distinct()
    changes = diff_entities(asked, held, field_schema(proposals.sparkSession)).filter(F.col("change").isin("set_field", "add_to_set"))
    wanted = claims.select("proposal_id", "entity_id", "field", "value").distinct().join(changes.select("entity_id", "field", "value", "change").distinct(), ["entity_id", "field", "value"])
    rows = live.join(wanted, ["proposal_id", "entity_id"], "left")
    outcome = F.when(F.col("version").isNull(), "target_gone").when(F.col("change").isNull(), "no_change").otherwise("changed")
    is_changed = F.col("outcome") == "changed"
    return rows.withColumn("outcome", outcome).select(
        "proposal_id", "outcome", *[F.when(is_changed, F.col(c)).alias(c) for c in ("field", "value", "change")], F.when(is_changed, F.col("version")).alias("expected_version"), F.when(is_changed, "needs_review").alias("disposition")
    ).distinct()
