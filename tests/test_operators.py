"""Operators of the engine on small fixtures, against plain Python."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorefold.functions import confidence as C
from lorefold.functions.edits import close_pairs
from lorefold.functions.text import name_similarity, normalise, proper_name_runs
from lorefold.functions.vectors import cosine_distance, hash_vector
from lorefold.operators import captures, evaluation, event_store, fold, resolution, salience, search, stores, triage
from lorefold.plans import reference
from lorefold.streaming.catch_up import catch_up

LOG = "position long, event_id string, type string, version int, aggregate_type string, aggregate_id string, aggregate_version long, payload string, capture_id string, provider string, model_version string, confidence double, recorded_at timestamp"


def log_row(position, kind, aggregate, payload, name=None):
    return (position, name or f"e{position}", kind, 1, "Entity", aggregate, position, json.dumps(payload), "cap", "local", "m", 0.5, datetime(2025, 1, 1))


def random_rows(rng, n=50):
    ids, rows = ["p1", "p2", "p3", "p4"], []
    for i in range(1, n + 1):
        a = rng.choice(ids)
        kind = rng.choice(["EntityCreated", "FieldSet", "FieldSet", "SetMemberAdded", "SetMemberAdded", "FieldCleared", "EntitiesRelated", "EntitiesMerged" if rng.random() < 0.5 else "FieldSet"])
        payload = {
            "EntityCreated": {"entityType": "Person", "name": rng.choice("xy")}, "FieldCleared": {"field": rng.choice(["role", "aliases"]), "because": "b"},
            "EntitiesRelated": {"relation": "knows", "fromId": a, "fromType": "Person", "toId": rng.choice(ids), "toType": rng.choice(["Person", "Task"])},
            "EntitiesMerged": {"mergedId": rng.choice(ids)},
        }.get(kind, {"field": "aliases" if kind == "SetMemberAdded" else rng.choice(["role", "aliases", "name"]), "value": rng.choice("abc")})
        rows.append(log_row(i, kind, a, payload))
    return rows


def ordered_fold(rows):
    """(values, versions, pointers, relations, merges) of a log, one event after the other."""
    entities, versions, pointers, relations, valid = {}, {}, {}, {}, []
    for r in rows:
        kind, a, doc, event = r[2], r[5], json.loads(r[7]), r[1]
        if kind == "EntityCreated":
            if a not in entities:
                entities[a], versions[a], pointers[a] = {"name": ["s:" + doc["name"]]}, 1, {"name": event}
        elif kind == "EntitiesRelated":
            relations[doc["fromId"], doc["toId"]] = (doc["fromType"], doc["toType"])
        elif kind == "EntitiesMerged":
            loser = doc["mergedId"]
            if a in entities and loser in entities and a != loser:
                valid.append((r[0], a, loser))
                own, notes_before = entities[a], len(entities[a].get("notes", []))
                notes = list(own.get("notes", []))
                lost, lost_pointers = entities.pop(loser), pointers.pop(loser)
                for field, values in lost.items():
                    if field == "notes":
                        notes += [v for v in values if v not in notes]
                    elif field not in own:
                        own[field] = list(values)
                    elif field in fold.SET_FIELDS:
                        own[field] = list(dict.fromkeys([*own[field], *values]))
                    else:
                        notes += [n for v in values if v not in own[field] and (n := f"s:{field}: {v[2:]}") not in notes]
                if notes:
                    own["notes"] = notes
                for field, pointer in lost_pointers.items():
                    if field in own:
                        pointers[a].setdefault(field, pointer)
                if len(notes) > notes_before:
                    pointers[a]["notes"] = event
                versions[a] += 1
                versions.pop(loser)
                relations = {(a if x == loser else x, a if y == loser else y): t for (x, y), t in relations.items()}
        elif a in entities:
            own, value = entities[a], "s:" + doc.get("value", "")
            if kind == "FieldSet":
                own[doc["field"]] = [value]
            elif kind == "FieldCleared":
                own.pop(doc["field"], None)
                pointers[a].pop(doc["field"], None)
                versions[a] += 1
                continue
            elif value in own.setdefault(doc["field"], []):
                continue
            else:
                own[doc["field"]].append(value)
            versions[a] += 1
            pointers[a][doc["field"]] = event
    return entities, versions, pointers, relations, valid


@pytest.mark.parametrize("seed", (1, 4, 7))
def test_fold_equals_ordered_fold(spark, seed):
    rows = random_rows(random.Random(seed), 50 + 10 * seed)
    events = fold.read_log(spark.createDataFrame(rows, LOG)).cache()
    entities, versions, pointers, relations, valid = ordered_fold(rows)
    line = fold.lineage(events)
    assert sorted((r.position, r.survivor, r.loser) for r in line.merges.collect()) == valid
    got = {}
    for r in fold.fold_fields(events, line).collect():
        got.setdefault((r.entity_id, r.field), set()).add(r.value)
    assert got == {(e, f): set(v) for e, fields in entities.items() for f, v in fields.items() if v}
    assert {r.entity_id: r.version for r in fold.entity_versions(events, line).collect()} == versions
    assert {(r.entity_id, r.field): r.event_id for r in fold.field_provenance(events, line).collect()} == {(e, f): p for e, own in pointers.items() for f, p in own.items()}
    assert {(r.from_id, r.to_id) for r in fold.fold_relations(events, line).collect()} == set(relations)
    assert {r.aggregate_id for r in fold.created(events, line).collect()} == set(entities)


def test_merge_rules(spark):
    rows = [
        log_row(1, "EntityCreated", "a", {"entityType": "Person", "name": "A"}), log_row(2, "EntityCreated", "b", {"entityType": "Person", "name": "B"}),
        log_row(3, "FieldSet", "b", {"field": "role", "value": "r"}), log_row(4, "SetMemberAdded", "a", {"field": "aliases", "value": "x"}),
        log_row(5, "SetMemberAdded", "b", {"field": "aliases", "value": "y"}), log_row(6, "EntitiesMerged", "a", {"mergedId": "b"}),
    ]
    events = fold.read_log(spark.createDataFrame(rows, LOG))
    got = {(r.entity_id, r.field, r.value, r.event_id) for r in fold.fold_fields(events).collect()}
    assert got == {("a", "name", "s:A", "e1"), ("a", "role", "s:r", "e3"), ("a", "aliases", "s:x", "e4"), ("a", "aliases", "s:y", "e5"), ("a", "notes", "s:name: B", "e6")}


def test_set_fields_of_a_type_only(spark):
    """Contacts of people are joined; of an event, which declares none, the survivor's stay and the loser's become a note."""
    for kind, want in (("Person", {"s:c", "s:d"}), ("Event", {"s:c"})):
        rows = [log_row(i + 1, "EntityCreated", x, {"entityType": kind, "name": "N"}) for i, x in enumerate("ab")]
        rows += [log_row(3, "SetMemberAdded", "a", {"field": "contact", "value": "c"}), log_row(4, "SetMemberAdded", "b", {"field": "contact", "value": "d"}), log_row(5, "EntitiesMerged", "a", {"mergedId": "b"})]
        held = fold.fold_fields(fold.read_log(spark.createDataFrame(rows, LOG))).collect()
        assert {r.value for r in held if r.field == "contact"} == want
        assert {r.value for r in held if r.field == "notes"} == ({"s:contact: d"} if kind == "Event" else set())


def test_enums_and_dependents(spark):
    said = spark.createDataFrame([("Idea", "status", "Promoted "), ("Task", "status", "paused"), ("Event", "kind", "Call"), ("Idea", "body", "x"), ("Task", "status", None)], "entity_type string, field string, value string")
    got = [(r.entity_type, r.parsed, r.note) for r in triage.enum_fallback(said).orderBy("entity_type", "field", "value").collect()]
    assert sorted(got, key=str) == sorted([("Idea", "promoted", None), ("Task", "other", "status: paused"), ("Event", "call", None), ("Idea", None, None), ("Task", "other", None)], key=str)
    changes = spark.createDataFrame([("a", "Project", "status", "s:blocked", "set_field"), ("b", "Project", "status", "s:active", "set_field"), ("c", "Task", "status", "s:done", "set_field")], "entity_id string, entity_type string, field string, value string, change string")
    held = spark.createDataFrame([(x, "blocker", "s:y") for x in "abc"], "entity_id string, field string, value string")
    assert [tuple(r) for r in triage.diff_dependents(changes, held).collect()] == [("b", "blocker", "clear_field")]


def test_redirects_end_and_rings_stop(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("r1", "r2"), ("r2", "r1"), (None, "x"), ("y", None), ("z", "z")]
    got = {r.from_id: r.final_id for r in fold.resolve_redirects(spark.createDataFrame(chain, "from_id string, to_id string")).collect()}
    assert all(got[f"n{i}"] == "n40" for i in range(40))
    assert set(got) == {f"n{i}" for i in range(40)} | {"r1", "r2"}


def test_text_functions(spark):
    df = spark.createDataFrame([("Ann  Lee", "ann lee"), ("", "x"), ("abcd", "abce")], "a string, b string")
    assert [r[0] for r in df.select(name_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.75]
    odd = spark.createDataFrame([("  é  x ",), (None,), ("",)], "t string")
    assert [r[0] for r in odd.select(normalise("t")).collect()] == ["é x", None, ""]
    runs = spark.createDataFrame([("Then we met Anna Berg on Monday. Later Anna Berg left for Rome.",)], "t string")
    assert runs.select(proper_name_runs(F.col("t"))).first()[0] == ["Anna Berg", "Rome"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 2.0]
    v = spark.range(1).select(hash_vector(F.lit("x"), 8)).first()[0]
    assert abs(sum(x * x for x in v) - 1) < 1e-9


def test_confidence(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.5,), (-1.0,), (0.9,)], "c double")
    assert [r[0] for r in df.select(C.clamp_unit(F.col("c"))).collect()] == [0.5, 0.5, 1.0, 0.0, 0.9]
    assert [r[0] for r in df.select(C.band_for(C.clamp_unit(F.col("c")))).collect()] == ["needs_review", "needs_review", "auto_apply", "discard", "auto_apply"]
    assert spark.range(1).select(C.most_restrictive(F.lit("auto_apply"), F.lit("needs_review"))).first()[0] == "needs_review"


def test_capture_identity_and_ingest(spark):
    arriving = spark.createDataFrame([("typed", "Coffee with Sarah about the Helios rollout.", datetime(2026, 8, 1, 9))] * 2, "source string, text string, source_timestamp timestamp")
    stored = spark.createDataFrame([], "capture_id string")
    rows = captures.ingest(arriving, stored).collect()
    assert [r.capture_id for r in rows] == ["cap-0ee28d5f3077a14b63959caaf2f7415a"]
    assert captures.ingest(arriving, captures.ingest(arriving, stored)).count() == 0


def test_event_store(spark):
    good = spark.createDataFrame([log_row(1, "FieldSet", "a", {}), log_row(2, "FieldSet", "a", {}), log_row(2, "FieldSet", "a", {})], LOG)
    bad = spark.createDataFrame([(3, " ", "FieldSet", 0, "Entity", "a", -1, "{}", "c", "p", "m", 2.0, datetime(2025, 1, 1))], LOG)
    assert event_store.split_valid(bad)[1].first().violations == ["event_id", "version", "aggregate_version", "confidence"]
    added = event_store.append_events(good.filter("position = 1"), good.unionByName(bad).drop("position"))
    assert [(r.event_id, r.position) for r in added.collect()] == [("e2", 2)]
    with pytest.raises(Exception, match="no step"):
        event_store.upcast(good, {"FieldSet": 2}, {}).collect()


@pytest.mark.parametrize("least", [0.7, 0.85])
def test_similar_spellings_loses_no_pair(spark, least):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)}
    words |= {w[:i] + "z" + w[i:] for w in list(words)[:40] for i in (1,)}
    df = spark.createDataFrame([("t", w) for w in words], "entity_type string, x string")
    got = {(r.x, r.y) for r in resolution.similar_spellings(df, df.withColumnRenamed("x", "y"), least).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    want = {(a, b) for a in words for b in words if a == b or 1 - distance(a, b) / max(len(a), len(b)) >= least}
    assert got == want


def test_search_phrases(spark):
    docs = spark.createDataFrame([("1", "The price table is late"), ("2", "table of a price"), ("3", "Price-Table, again: price table"), ("4", None), (None, "price table")], "doc_key string, text string")
    assert {r.doc_key for r in search.search(docs, 'PRICE-table').collect()} == {"1", "3"}
    assert search.search(docs, "price table", limit=1).count() == 1
    assert search.search(docs, "-- !").count() == 0


def test_daily_sections(spark):
    rows = [
        ("t1", "Task", "open", datetime(2026, 6, 1, 20), False, datetime(2026, 5, 31)), ("t2", "Task", "open", None, False, datetime(2026, 4, 1)),
        ("p1", "Project", "blocked", datetime(2026, 6, 5), False, datetime(2026, 5, 1)), ("x", "Task", "done", datetime(2026, 6, 2), False, None),
    ]
    entities = spark.createDataFrame(rows, "entity_id string, entity_type string, status string, due_at timestamp, has_outcome boolean, last_mentioned timestamp")
    now = F.lit("2026-06-01 12:00:00").cast("timestamp")
    scored = salience.salience_terms(entities, now)
    assert {r.entity_id: r.salience for r in scored.collect()} == {"t1": pytest.approx(93.0, abs=1.1), "t2": 40.0, "p1": pytest.approx(60.0), "x": 50.0}
    got = {(r.heading, r["rank"], r.entity_id) for r in salience.daily_sections(scored, now).collect()}
    assert got == {("Today", 1, "t1"), ("Worth doing", 1, "t2"), ("Looks stuck", 1, "p1"), ("Looks stuck", 2, "t2"), ("Coming up", 1, "t1"), ("Coming up", 2, "p1")}


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "expected long, found long, correct long, fields long, fields_right long, emitted long, violations long, confidence double")
    assert tuple(evaluation.extraction_metrics(empty).first()) == (1.0, 1.0, 1.0, 0.0, 0.0)


def test_expired_discards(spark):
    rows = spark.createDataFrame([("a", "discard", datetime(2026, 1, 1)), ("b", "auto_apply", datetime(2026, 1, 1))], "proposal_id string, disposition string, decided_at timestamp")
    kept = stores.with_expiry(rows)
    at = F.lit("2026-01-31 00:00:00").cast("timestamp")
    assert stores.live_discards(kept, at).count() == 0
    assert [r.proposal_id for r in stores.without_expired(kept, at).collect()] == ["b"]


def test_stream_equals_rebuild(spark, tmp_path):
    rows = random_rows(random.Random(9), 80)
    frame = lambda part: spark.createDataFrame(part, LOG).coalesce(1)
    for i in range(0, 80, 30):
        frame(rows[i : i + 30]).write.mode("append").parquet(str(tmp_path / "log"))
        state = catch_up(spark, str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "checkpoint"))
        want = fold.fold_fields(fold.read_log(frame(rows[: i + 30])))
        key = lambda d: {(r.entity_id, r.field, r.value, r.event_id) for r in d.collect()}
        assert key(state) == key(want)


def test_close_pairs_of_any_letters():
    rng = random.Random(4)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    left = ["".join(rng.choice("ab é😀") for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 13, 40, 63, 64, 65, 90) for _ in range(3)]
    right = [t[:i] + rng.choice(("", "b", "éa")) + t[i + 1 :] for t in left for i in (0, len(t) // 2, len(t))]
    for least in (0.0, 0.5, 0.7, 0.85, 1.0):
        met = {(i, j) for a, b in close_pairs(left, right, least) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        want = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x and y and distance(x, y) <= (1 - least) * max(len(x), len(y)) + 1e-9}
        assert want <= met and {p for p in met if len(left[p[0]]) <= 64} <= want  # longer ones are left to the caller


def test_similar_spellings_of_many_names(spark):
    """Names of few parts, as those of people are, in more blocks than one: the former join on pieces of two letters didn't end in six minutes."""
    rng = random.Random(5)
    part = lambda: "".join(rng.choice(("ka", "lo", "mi", "ren", "sto", "ve", "and")) for _ in range(3))
    given, family = [part() for _ in range(60)], [part() for _ in range(60)]
    names = sorted({f"{g} {f}" for g in given for f in family})
    df = spark.createDataFrame([("t", n) for n in names] + [(None, names[0])], "entity_type string, x string")
    began = time.time()
    got = {(r.x, r.y): r.similarity for r in resolution.similar_spellings(df, df.withColumnRenamed("x", "y"), 0.8).collect()}
    assert time.time() - began < 120
    assert {(n, n) for n in names} <= set(got) and all(got[y, x] == s for (x, y), s in got.items()) and min(got.values()) >= 0.8
    for x in names[:: len(names) // 4]:
        pairs = spark.createDataFrame([(x, y) for y in names], "x string, y string").withColumn("s", name_similarity(F.col("x"), F.col("y"))).filter("s >= 0.8").collect()
        assert {(r.x, r.y): r.s for r in pairs} == {p: s for p, s in got.items() if p[0] == x}
    once = {(r.x, r.y): r.similarity for r in resolution.similar_spellings(df, None, 0.8).collect()}
    assert once == {p: s for p, s in got.items() if p[0] <= p[1]}


def test_similar_spellings_splits_large_types_only(spark, monkeypatch):
    """a type with few texts stays in one block, whatever the others have, and what is found doesn't depend on blocks."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 8))) for _ in range(200)})
    df = spark.createDataFrame([("many", w) for w in words] + [("few", w) for w in words[:9]], "entity_type string, x string")
    found = lambda right: {tuple(r) for r in resolution.similar_spellings(df, right, 0.7).collect()}
    whole, once = found(df.withColumnRenamed("x", "y")), found(None)
    monkeypatch.setattr(resolution, "LEAST_TEXTS", 60)
    assert resolution.blocks_of(df) == {"many": -(-len(words) // 60)}
    assert found(df.withColumnRenamed("x", "y")) == whole and found(None) == once


def test_nearest_candidates_keep_ties_in_nine_digits(spark):
    """distances that differ beyond the ninth digit only rank by id, also those just beyond the bound of a block."""
    rows = [(f"e{i}", "t", [1.0, 1e-4 + (9 - i) * 1e-9]) for i in range(10)] + [("z", "t", [0.0, 0.0]), ("far", "t", [0.0, 1.0])]
    near = resolution.nearest_candidates(spark.createDataFrame([("m", "t", [1.0, 0.0])], "mention_id string, entity_type string, vector array<double>"), spark.createDataFrame(rows, "entity_id string, entity_type string, embedding array<double>").coalesce(1), 3)
    assert sorted(r.entity_id for r in near.collect()) == ["e0", "e1", "e2"]
    everything = resolution.nearest_candidates(spark.createDataFrame([("m", "t", [1.0, 0.0])], "mention_id string, entity_type string, vector array<double>"), spark.createDataFrame(rows, "entity_id string, entity_type string, embedding array<double>"), 12)
    assert {r.entity_id: r.distance for r in everything.collect() if r.entity_id in ("z", "far")} == {"z": 2.0, "far": 1.0}


def test_resolution_reads_the_log_once(spark, monkeypatch):
    """F4, F8: contacts are folded from what was kept of one reading of the log; co_occurrence folds no fields at all."""
    folded, plain = [], fold.fold_fields

    def watched(events, line=None):
        folded.append(events.inputFiles())
        return plain(events, line)

    monkeypatch.setattr(fold, "fold_fields", watched)
    reference.QUERIES["co_occurrence"](spark, "/root/testdata/sf0.001")
    assert not folded
    reference.QUERIES["resolution_scores"](spark, "/root/testdata/sf0.001")
    assert folded == [[]]


def test_nearest_candidates_hold_one_chunk_of_queries(spark, monkeypatch):
    """queries of a chunk are let go before the next; what is found is the same in one chunk and in many."""
    rng = random.Random(9)
    rows = [(f"e{i}", rng.choice("tu"), [rng.random() for _ in range(rng.choice((2, 3)))]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "entity_id string, entity_type string, embedding array<double>")
    asked = vectors.limit(20).select(F.col("entity_id").alias("mention_id"), "entity_type", F.col("embedding").alias("vector"))
    whole = resolution.nearest_candidates(asked, vectors, 4)
    assert "MapInArrow" not in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(resolution, "QUERIES_AT_ONCE", 3)
    assert sorted(map(tuple, resolution.nearest_candidates(asked, vectors, 4).collect())) == sorted(map(tuple, whole.collect()))
