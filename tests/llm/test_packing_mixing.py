import random
from collections import Counter

import pytest

from lorefold.llm.mixing import mix_documents, mixture_shares
from lorefold.llm.packing import best_two_fit, pack_documents, packing_report

DOCS = "doc_id long, text string, source string, tokens string"


def test_best_two_fit():
    assert sorted(sum(s for s, _ in b) for b in best_two_fit([(6, (0,)), (3, (1,)), (2, (2,)), (2, (3,)), (5, (4,))], 10)) == [8, 10]
    rng = random.Random(1)
    items = [(rng.randint(1, 100), (i,)) for i in range(500)]
    bins = best_two_fit(items, 100)
    assert sorted(i for b in bins for _, i in b) == [(i,) for i in range(500)]
    assert all(sum(s for s, _ in b) <= 100 for b in bins)
    assert sum(s for s, _ in items) / (100 * len(bins)) > 0.97


def test_pack_documents(spark):
    docs = [(i, "word " * (1 + i % 37), "s", "") for i in range(300)] + [(900, "long text " * 700, "s", ""), (901, "", "s", ""), (902, None, "s", ""), (903, "word", "s", ""), (903, "word", "s", "")]
    boxes = spark.createDataFrame([("small", 64), ("big", 512), ("none", 0), (None, 5)], "container_kind string, capacity_tokens int")
    rows = pack_documents(spark.createDataFrame(docs, DOCS), boxes, shard_items=100).collect()
    used = Counter()
    for r in rows:
        used[r.container_kind, r.container_id] += r.tokens
    assert {r.container_kind for r in rows} == {"small", "big"}
    for kind, capacity in (("small", 64), ("big", 512)):
        assert all(v <= capacity for (k, _), v in used.items() if k == kind)
        own = [r for r in rows if r.container_kind == kind]
        assert Counter(r.doc_id for r in own if r.part == 0) == Counter(d[0] for d in docs)
        for r in own:
            assert r.parts == 1 or r.start_token == r.part * capacity and r.doc_id == 900
    fill = {r.container_kind: r.fill for r in packing_report(pack_documents(spark.createDataFrame(docs, DOCS), boxes)).collect()}
    assert fill["small"] > 0.95
    assert pack_documents(spark.createDataFrame([], DOCS), boxes).count() == 0
    assert pack_documents(spark.createDataFrame(docs, DOCS), boxes.limit(0)).count() == 0


def test_mixture(spark):
    rng = random.Random(2)
    topics = {"a": "river boat water", "b": "stock price market", "c": "goal team match"}
    docs = []
    for i in range(900):
        s = rng.choices("abc", (8, 3, 1))[0]
        docs.append((i, " ".join(rng.choice(topics[s].split()) for _ in range(rng.randint(3, 60))), None if i % 20 == 0 else s, ""))
    docs += [(2000, None, "a", ""), (2001, "", "b", ""), (None, "goal", "c", "")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("empty", 0.05, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture = mix_documents(spark.createDataFrame(docs, DOCS), targets)
    most = {"a": 1, "b": 2, "c": 3, "empty": 4}
    assert all(0 <= r.copies <= most[r.target_source] for r in mixture.collect())
    shares = {r.source: r.reached_share for r in mixture_shares(mixture, targets.filter("source IS NOT NULL")).collect()}
    assert shares["empty"] == 0
    known = shares["a"] + shares["b"] + shares["c"]
    for s, wanted in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert shares[s] / known == pytest.approx(wanted / 0.95, abs=0.03)
    assert mix_documents(spark.createDataFrame([], DOCS), targets).count() == 0
    assert mix_documents(spark.createDataFrame(docs, DOCS), targets.limit(0)).count() == 0
