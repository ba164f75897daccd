"""The write side, briefs, ports and the stored projection on small fixtures."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorefold.functions.text import proper_name_runs
from lorefold.operators import briefs, captures, evaluation, extraction, resolution, writing
from lorefold.streaming import catch_up as projection
from tests.test_operators import LOG, log_row



def now():
    return F.lit("2026-06-01 12:00:00").cast("timestamp")

COMMANDS = "command_key string, arrival long, type string, aggregate_type string, aggregate_id string, expected_version long, payload string, proposal_id string, capture_id string, provider string, model_version string, confidence double, is_human_confirmed boolean"
QUEUE = "proposal_id string, capture_id string, command_type string, aggregate_type string, aggregate_id string, expected_version long, payload string, disposition string, adjudicated_at timestamp"


def command(key, arrival, kind, aggregate, expected):
    return (key, arrival, kind, "Entity", aggregate, expected, "{}", "p", "c", "local", "m", 0.9, False)


def test_commands_follow_each_other(spark):
    log = spark.createDataFrame([log_row(3, "FieldSet", "a", {"field": "role", "value": "x"})], LOG)
    rows = [command("k1", 1, "SetField", "a", 4), command("k2", 2, "SetField", "a", 4), command("k3", 3, "ClearField", "a", 5), command("k4", 4, "Nonsense", "a", 6), command("k5", 5, "CreateEntity", "new", 0), command("k6", 6, "SetField", "a", None)]
    done = writing.execute(spark.createDataFrame(rows, COMMANDS), log, now())
    got = {r.command_key: (r.outcome, r.aggregate_version) for r in done.collect()}
    assert got == {"k1": ("applied", 4), "k2": ("stale", None), "k3": ("applied", 5), "k4": ("unknown_command", None), "k5": ("applied", 0), "k6": ("applied", 6)}
    assert {r.type for r in writing.events_of(done).collect()} == {"FieldSet", "FieldCleared", "EntityCreated"}
    assert writing.execute(spark.createDataFrame([], COMMANDS), log, now()).count() == 0


def test_confirming_and_correcting(spark):
    log = spark.createDataFrame([log_row(1, "EntityCreated", "s", {"entityType": "Person", "name": "S"}), log_row(2, "EntityCreated", "b", {"entityType": "Person", "name": "B"})], LOG)
    queue = spark.createDataFrame([
        ("p1", "c", "SetField", "Entity", "gone", 9, "{}", "needs_review", None), ("p2", "c", "SetField", "Entity", "b", 3, "{}", "needs_review", datetime(2026, 1, 1)), ("p3", "c", "SetField", "Entity", "b", 1, "{}", "needs_review", None),
    ], QUEUE)
    redirects = spark.createDataFrame([("gone", "s")], "id string, final_id string")
    confirmed = spark.createDataFrame([("p1", 1), ("p1", 2), ("p2", 3), ("p3", 4), ("unknown", 5)], "proposal_id string, arrival long")
    executed, stamped = writing.confirm(queue, confirmed, log, redirects, now())
    assert {(r.proposal_id, r.aggregate_id, r.outcome, r.provider) for r in executed.collect()} == {("p1", "s", "applied", "human"), ("p3", "b", "stale", "human")}
    assert {r.proposal_id for r in stamped.filter("adjudicated_at IS NULL").collect()} == {"p3"}
    chosen = spark.createDataFrame([("p3", 1, "SetField", "Entity", "b", "{}"), ("p3", 2, "ClearField", "Entity", "b", "{}")], "proposal_id string, arrival long, type string, aggregate_type string, aggregate_id string, payload string")
    none = spark.createDataFrame([], "correction_id string")
    executed, made = writing.correct(queue, chosen, none, log, redirects, now())
    assert {(r.type, r.aggregate_version) for r in executed.collect()} == {("SetField", 3), ("ClearField", 4)}
    assert writing.correct(queue, chosen, made, log, redirects, now())[1].count() == 0


def test_reproposing(spark):
    proposals = spark.createDataFrame([("p1", "a"), ("p2", "a"), ("p3", "gone")], "proposal_id string, entity_id string")
    claims = spark.createDataFrame([("p1", "a", "Person", "role", "s:x"), ("p2", "a", "Person", "role", "s:held"), ("p3", "gone", "Person", "role", "s:x")], "proposal_id string, entity_id string, entity_type string, field string, value string")
    held = spark.createDataFrame([("a", "role", "s:held")], "entity_id string, field string, value string")
    got = {(r.proposal_id, r.outcome, r.change, r.expected_version) for r in writing.repropose(proposals, claims, held, spark.createDataFrame([("a", 7)], "entity_id string, version long")).collect()}
    assert got == {("p1", "changed", "set_field", 7), ("p2", "no_change", None, None), ("p3", "target_gone", None, None)}


def test_name_runs(spark):
    texts = [("Then Ann came: Bob Lee saw Monday Market. Carl Dee left\nEve Foe stayed on Monday", ["Ann", "Lee", "Monday Market", "Dee", "Foe"]), ("", []), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [r[0] for r in df.select(proper_name_runs(F.col("t"))).collect()] == [w for _, w in texts]


def test_briefs(spark):
    selection = spark.createDataFrame([("b", "Today", 0, 1, "e", "Sarah Chen", 5.0), ("b", "Today", 0, 2, "f", "Acme Project", 4.0)], "brief_id string, heading string, section int, rank int, entity_id string, name string, salience double")
    wanted = spark.createDataFrame([("b",), ("q",)], "brief_id string")
    for prose, kept in (("We saw Sarah and Sarah Chen.", True), ("We saw Chen Project.", False)):
        said = spark.createDataFrame([("b", prose, "p", "m"), ("q", prose, "p", "m")], "brief_id string, prose string, provider string, model_version string")
        got = {r.brief_id: r.prose for r in briefs.compose(wanted, selection, said).collect()}
        assert got == {"b": prose if kept else "## Today\n- Sarah Chen\n- Acme Project", "q": briefs.QUIET_PROSE}
    stored = spark.createDataFrame([("old",)], "brief_id string")
    fresh, entities, written = briefs.put(stored, selection.limit(0), spark.createDataFrame([("b",), ("b",), ("old",)], "brief_id string"), selection)
    assert [r.brief_id for r in fresh.collect()] == ["b"] and entities.count() == 2
    assert {(r.brief_id, r.was_stored) for r in written.collect()} == {("b", True), ("old", False)}


def test_ports(spark):
    texts = spark.createDataFrame([("c1", " Ann "), ("c2", "Bob")], "capture_id string, text string")
    assert {r.answer for r in extraction.ask(texts, lambda batch: [t.strip().upper() for t in batch]).collect()} == {"ANN", "BOB"}
    assert {r.capture_id: r.answer for r in extraction.canned(texts, spark.createDataFrame([("Ann", "{}")], "text string, answer string")).collect()} == {"c1": "{}", "c2": None}
    assert extraction.embed(texts.withColumnRenamed("capture_id", "key"), lambda batch: [[float(len(t))] for t in batch]).count() == 2
    with pytest.raises(Exception, match="answered"):
        extraction.ask(texts, lambda batch: []).collect()
    answers = spark.createDataFrame([("c", '{"mentions": [{"text": " Ann ", "entity_type": "Person", "fields": [{"field": "role", "value": "x"}, {"field": "salience", "value": "1"}]}, {"text": "", "entity_type": "Task"}, {"text": "x", "entity_type": "Thing", "confidence": 7}]}'), ("d", "no json"), ("e", None), (None, "{}")], "capture_id string, answer string")
    mentions, fields, violations = extraction.parse_extraction(answers)
    assert [tuple(r) for r in mentions.collect()] == [("c", 0, "Person", "Ann", 0.5)]
    assert [tuple(r) for r in fields.collect()] == [("c", 0, "role", "x")]
    assert {(r.violation, r.detail) for r in violations.collect()} == {("derived_field", "salience"), ("unknown_entity_type", "Thing")}


def test_adjudication(spark):
    resolved = spark.createDataFrame([(m, "matched", "e1", 0.8, 0.01, True) for m in ("m1", "m2", "m3")] + [("m4", "matched", "e1", 0.9, 0.4, False)], "mention_id string, outcome string, entity_id string, score double, margin double, is_ambiguous boolean")
    listed = spark.createDataFrame([(f"m{i}", c, f"e{c}") for i in range(1, 5) for c in (1, 2)], "mention_id string, choice int, entity_id string")
    answers = spark.createDataFrame([("m1", 2), ("m2", None), ("m3", 9), ("m4", 2)], "mention_id string, choice int")
    got = {r.mention_id: (r.outcome, r.entity_id) for r in resolution.adjudicate(resolved, listed, answers).collect()}
    assert got == {"m1": ("matched", "e2"), "m2": ("rejected_candidates", None), "m3": ("rejected_candidates", None), "m4": ("matched", "e1")}


def test_contact_and_company_raise_scores(spark):
    found = spark.createDataFrame([("m", "e1", 1, 0, 1.0, 9.0), ("m", "e2", 1, 0, 0.0, -3.0)], "mention_id string, entity_id string, sources int, source_rank int, together double, days_since_contact double")
    mentions = spark.createDataFrame([("m", "Ann")], "mention_id string, mention_text string")
    names = spark.createDataFrame([("e1", "Ann"), ("e2", "Ann")], "entity_id string, spelling string")
    got = {r.entity_id: round(r.score, 6) for r in resolution.score_candidates(found, mentions, names).collect()}
    assert got == {"e1": round(0.75 + 0.1 / 3 + 0.1 + 0.05 * 0.9, 6), "e2": round(0.75 + 0.1 / 3, 6)}
    together = resolution.co_occurrence(found, spark.createDataFrame([("m", "c"), ("n", "c"), ("o", "c")], "mention_id string, capture_id string"), spark.createDataFrame([("n", "x"), ("o", "y"), ("m", "e1")], "mention_id string, entity_id string"), spark.createDataFrame([("e1", "x"), ("y", "e2"), ("e2", "x")], "from_id string, to_id string"))
    assert {r.entity_id: r.together for r in together.collect()} == {"e1": 0.5, "e2": 1.0}


def test_nouns_and_percentiles(spark):
    rows = spark.createDataFrame([("met ann-marie today", "Ann-Marie"), ("mariann", "Ann"), ("a+b", "a+b")], "text string, noun string")
    assert evaluation.noun_recall(rows).first().heard == 2
    many = spark.createDataFrame([("g", float(i % 97)) for i in range(1000)] + [(None, 1.0)], "g string, v double")
    values = sorted(float(i % 97) for i in range(1000))
    got = {r.g: (r.p50, r.p95) for r in evaluation.percentile_by_rank(many, "g", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"g": (values[500], values[950]), None: (1.0, 1.0)}


def test_guards(spark):
    before = spark.createDataFrame([("a", "x", None), ("b", "x", "y"), ("c", "x", None), ("d", "x", None)], "k string, t string, c string")
    after = spark.createDataFrame([("a", "x", "new"), ("b", "x", "z"), ("c", "other", None)], "k string, t string, c string")
    assert {tuple(r) for r in captures.append_only_violations(before, after, "k", "c").collect()} == {("b", "changed"), ("c", "changed"), ("d", "removed")}
    asked = spark.createDataFrame([("typed", "x", "2026-01-01T10:00:00Z"), ("x", " ", "1.1.2026"), (None, None, None)], "source string, text string, source_timestamp string")
    assert [r[0] for r in asked.select(captures.request_violations()).collect()] == [[], ["source", "text", "source_timestamp"], ["source", "text", "source_timestamp"]]


def test_snapshots_and_freshness(spark, tmp_path):
    rows = [log_row(i, "EntityCreated", x, {"entityType": "Person", "name": x}) for i, x in enumerate("abc", 1)] + [log_row(4, "FieldSet", "b", {"field": "role", "value": "r"}), log_row(5, "EntitiesMerged", "a", {"mergedId": "b"})]
    log = spark.createDataFrame(rows, LOG)
    folder = str(tmp_path / "snapshots")
    assert projection.freshness(spark, str(tmp_path / "none")).first() == (0, False)
    assert projection.latest_snapshot(spark, folder) is None
    whole = {tuple(r) for r in projection.rebuild_from_snapshot(log, folder).collect()}
    early = projection.rebuild_from_snapshot(log.filter("position <= 3"), folder)
    assert projection.save_snapshot(early, 3, folder) and not projection.save_snapshot(early, 2, folder)
    assert {tuple(r) for r in projection.rebuild_from_snapshot(log, folder).collect()} == whole
    assert {(r[0], r[1]) for r in whole} == {("a", "name"), ("a", "role"), ("a", "notes"), ("c", "name")}
    assert not projection.snapshot_due(10**9, 0) and projection.snapshot_due(10, 0, 10)
