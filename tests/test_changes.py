"""The change feed and the history against an ordered replay in plain Python."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest

from lorefold.operators.change_feed import current_fields
from lorefold.operators.history import attribute_history, build_store

START = datetime(2025, 1, 1, tzinfo=UTC)
SCHEMA = "position long, event_id string, type string, aggregate_type string, aggregate_id string, aggregate_version long, payload string, recorded_at timestamp, clash string"


def event(position, name, kind, aggregate, version, payload, minute, aggregate_type="Entity"):
    text = payload if isinstance(payload, str) or payload is None else json.dumps(payload)
    return (position, name, kind, aggregate_type, aggregate, version, text, START + timedelta(minutes=minute), "x")


def standing(rows):
    first = {}
    for r in sorted((r for r in rows if r[3] == "Entity" and r[1] and r[4] and r[5] is not None), key=lambda r: r[0] if r[0] is not None else 1 << 62):
        first.setdefault(r[1], r)
    by_version = {}
    for r in sorted(first.values(), key=lambda r: (r[0] if r[0] is not None else 1 << 62, r[1])):
        by_version.setdefault((r[4], r[5]), r)
    out = []
    for r in sorted(by_version.values(), key=lambda r: (r[4], r[5])):
        try:
            doc = json.loads(r[6])
        except (TypeError, ValueError):
            continue
        if isinstance(doc, dict):
            out.append((r, doc))
    return out


def key_of(value):
    return ("d", value.get("timestamp"), value["precision"]) if isinstance(value, dict) else ("s", value)


def changes(rows):
    for r, doc in standing(rows):
        if r[2] == "EntityCreated" and isinstance(doc.get("name"), str):
            yield r, "name", key_of(doc["name"])
        elif r[2] == "FieldSet" and isinstance(doc.get("field"), str):
            yield r, doc["field"], key_of(doc.get("value"))
        elif r[2] == "FieldCleared" and isinstance(doc.get("field"), str):
            yield r, doc["field"], None


def removed(rows):
    out = {}
    for r, doc in standing(rows):
        if r[2] == "EntitiesMerged" and doc.get("mergedId"):
            out[doc["mergedId"]] = min(out.get(doc["mergedId"], r[7]), r[7])
    return out


def replayed(rows):
    state = {}
    for r, field, value in changes(rows):
        state[r[4], field] = (r[1], value)
    gone = removed(rows)
    return {(a, f, e) for (a, f), (e, v) in state.items() if v is not None and a not in gone}


def periods(rows):
    gone, lines = removed(rows), {}
    for r, field, value in changes(rows):
        lines.setdefault((r[4], field), {})[r[7]] = value
    out = set()
    us = lambda t: round((t - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)
    for (a, f), line in lines.items():
        held, since = None, None
        runs = []
        for at, value in sorted(line.items()):
            if value != held:
                if held is not None:
                    runs.append((since, at))
                held, since = value, at
        if held is not None:
            runs.append((since, None))
        for begin, end in runs:
            if a in gone:
                if begin >= gone[a]:
                    continue
                end = gone[a] if end is None or end > gone[a] else end
            out.add((a, f, us(begin), us(end) if end else -1))
    return out


def random_log(rng, aggregates=4, events=60):
    rows, versions, minute = [], dict.fromkeys(range(aggregates), 0), 0
    for i in range(events):
        a = 0 if rng.random() < 0.4 else rng.randrange(aggregates)
        minute += rng.choice([0, 0, 1, 5, -4])
        kind = rng.choice(["EntityCreated", "FieldSet", "FieldSet", "FieldSet", "FieldCleared", "SetMemberAdded", "EntitiesMerged" if rng.random() < 0.2 else "FieldSet"])
        field, value = rng.choice("fg"), rng.choice(["u", "v", {"timestamp": None, "precision": "day", "phrase": str(i)}, {"precision": "day", "timestamp": "2025-01-01T00:00:00.000Z", "phrase": "x"}])
        payload = {"EntityCreated": {"name": "n", "entityType": "Person"}, "FieldCleared": {"because": "b", "field": field}, "EntitiesMerged": {"mergedId": f"a{rng.randrange(aggregates)}"}}.get(kind, {"field": field, "value": value})
        if rng.random() < 0.06:
            payload = rng.choice(["", "{\"fi", "[object Object]", "\x00", None, "[1]"])
        rows.append(event(None, f"e{i}", kind, f"a{a}", versions[a], payload, minute))
        versions[a] += rng.choice([0, 1, 1, 1, 3])
    rows += [(None, r[1], *r[2:6], r[6] and r[6].replace(":", ": "), r[7] + timedelta(minutes=3), "y") for r in rng.sample(rows, 8)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(order[i] + 1, *r[1:]) for i, r in enumerate(rows)]
    return rows + rng.sample(rows, 5)


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(spark, seed):
    rows = random_log(random.Random(seed))
    log = spark.createDataFrame(rows, SCHEMA)
    for segment in (3, 4096):
        assert {tuple(r) for r in current_fields(log, segment).collect()} == replayed(rows)
    for changes_apart in (1, 3, 2048):  # times fall with the versions in these logs
        got = {(r.aggregate_id, r.field_name, r.valid_from_us, r.valid_to_us) for r in attribute_history(log, changes_apart).collect()}
        assert got == periods(rows)


def test_history_of_falling_times(spark):
    rows = [event(i + 1, f"e{i}", "FieldSet", "a", i + 1, {"field": "f", "value": f"v{i}"}, minute) for i, minute in enumerate((10, 30, 20, 40))]
    log = spark.createDataFrame(rows, SCHEMA)
    for changes_apart in (1, 2, 3, 2048):
        got = {(r.aggregate_id, r.field_name, r.valid_from_us, r.valid_to_us) for r in attribute_history(log, changes_apart).collect()}
        assert got == periods(rows) and len(got) == 4


def test_checkpoints_are_full_versions(spark):
    """Every checkpoint holds every field held then, also those that its segment leaves alone."""
    rows = [event(1, "n", "FieldSet", "a", 1, {"field": "still", "value": "s"}, 0)]
    rows += [event(i + 2, f"e{i}", "FieldSet", "a", i + 2, {"field": "f", "value": f"v{i}"}, i + 1) for i in range(8)]
    store = build_store(spark.createDataFrame(rows, SCHEMA), 2)
    held = {}
    for r in store.checkpoints.collect():
        held.setdefault(r.segment, set()).add(r.field_name)
    assert held and all("still" in fields for segment, fields in held.items())
    assert len(held) == store.patches.agg({"segment": "max"}).first()[0]


def test_history_over_segments(spark):
    rows = [event(i + 1, f"e{i}", "FieldSet", "a", i, {"field": "f", "value": v}, i // 2) for i, v in enumerate("uuvvuuuwwwuuvvvvx")]
    log = spark.createDataFrame(rows, SCHEMA)
    for segment in (1, 2, 5, 100):
        got = {(r.aggregate_id, r.field_name, r.valid_from_us, r.valid_to_us) for r in attribute_history(log, segment).collect()}
        assert got == periods(rows)


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert current_fields(empty).count() == 0
    assert attribute_history(empty).count() == 0
    rows = [
        event(1, None, "FieldSet", "a", 1, {"field": "f", "value": "v"}, 0), event(2, "e", "FieldSet", None, 1, {"field": "f", "value": "v"}, 0),
        event(3, "g", "FieldSet", "a", None, {"field": "f", "value": "v"}, 0), event(None, "h", "FieldSet", "a", 2, {"field": "f", "value": "x" * 100_000}, 0),
        event(4, "i", "FieldSet", "a", 3, {"field": None, "value": "v"}, 0), event(5, "j", "FieldSet", "c", 1, {"field": "f", "value": "v"}, 0, "Capture"),
    ]
    log = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in current_fields(log).collect()] == [("a", "f", "h")]
    assert attribute_history(log).count() == 1
