import numpy as np

from lorefold.llm import neighbours
from lorefold.llm.neighbours import close_pairs, encode, fit_index, search_cell, similar_pairs

SCHEMA = "entity_id string, entity_type string, embedding array<float>, similarity string"


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, d))
    return (centres[rng.integers(len(centres), size=n)] + 0.35 * rng.normal(size=(n, d))).astype(np.float32)


def truth(x, types, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = set()
    for i in range(len(x)):
        s = np.where((types == types[i]) & (np.arange(len(x)) != i), u @ u[i], -9)
        pairs |= {tuple(sorted((i, int(j)))) for j in np.argsort(-s)[:k] if s[j] >= least}
    return pairs


def test_recall_and_exact_scores(spark):
    x = clustered(3000, 30, 1)
    types = np.array([f"t{i % 3 // 2}" for i in range(len(x))])
    df = spark.createDataFrame([(f"{i:05}", types[i], x[i].tolist(), "clash") for i in range(len(x))], SCHEMA)
    found = {(int(r.entity_a), int(r.entity_b)) for r in close_pairs(df, "entity_id", "entity_type", "embedding", 30, 10, 0.8).collect()}
    want = truth(x, types, 10, 0.8)
    assert len(want) > 1000
    assert len(found & want) >= 0.9 * len(want)
    assert len(found & want) >= 0.97 * len(found)


def test_hot_cell_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    x = clustered(400, 16, 2)
    df = spark.createDataFrame([(f"{i:05}", "t", x[i].tolist(), "") for i in range(len(x))], SCHEMA)
    found = {(int(r.entity_a), int(r.entity_b)) for r in close_pairs(df, "entity_id", "entity_type", "embedding", 16, 5, 0.8).collect()}
    want = truth(x, np.array(["t"] * len(x)), 5, 0.8)
    assert len(found & want) >= 0.95 * len(want)


def test_cells_grow_with_rows(spark, monkeypatch):
    """With a bounded model the cells are pairs of centroids, and little is lost."""
    monkeypatch.setattr(neighbours, "MOST_CELLS", 5)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    x = clustered(3000, 24, 5)
    index = fit_index(["t"] * len(x), x / np.linalg.norm(x, axis=1, keepdims=True), len(x))
    assert len(index.centroids) == 5 and len(index.fine) == 10
    placed = index.nearest(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert np.bincount(placed.ravel(), minlength=50).max() < 3000 * placed.shape[1] / 8
    df = spark.createDataFrame([(f"{i:05}", "t", x[i].tolist(), "") for i in range(len(x))], SCHEMA)
    found = {(int(r.entity_a), int(r.entity_b)) for r in close_pairs(df, "entity_id", "entity_type", "embedding", 24, 10, 0.8).collect()}
    want = truth(x, np.array(["t"] * len(x)), 10, 0.8)
    assert len(found & want) >= 0.9 * len(want)


def test_many_copies(spark):
    """Copies of one vector, more than are reranked, get their k smallest ids and each other's neighbours."""
    rows = [(f"c{i:03}", "t", [1.0, 1.0, 0.0], "") for i in range(150)] + [("n1", "t", [1.0, 0.9, 0.0], ""), ("n2", "t", [0.0, 0.0, 1.0], ""), ("c000", "t", [1.0, 1.0, 0.0], "")]
    got = {}
    for r in similar_pairs(spark.createDataFrame(rows, SCHEMA), "entity_id", "entity_type", "embedding", 3, k=4, least=0.5).collect():
        got.setdefault(r.query_id, set()).add(r.other_id)
    assert got["c149"] == {"c000", "c001", "c002", "c003"} and got["c001"] == {"c000", "c002", "c003", "c004"}
    assert got["n1"] == {"c000", "c001", "c002", "c003"} and "n2" not in got and len(got) == 151


def test_unusable_rows(spark):
    nan = float("nan")
    rows = [
        ("a", "t", [1.0, 0.0], ""), ("b", "t", [2.0, 0.0], ""), ("b", "t", [2.0, 0.0], ""), ("c", "t", [0.0, 0.0], ""), ("d", "t", [1.0], ""), ("e", "t", [nan, 1.0], ""),
        ("f", "t", None, ""), ("g", "t", [None, 1.0], ""), (None, "t", [1.0, 0.0], ""), ("h", None, [1.0, 0.0], ""), ("i", "u", [1.0, 0.0], ""), ("j", "t", [], ""), ("k", "t", [float("inf"), 1.0], ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in close_pairs(df, "entity_id", "entity_type", "embedding", 2, 10, 0.8).collect()] == [("a", "b")]
    assert similar_pairs(df.limit(0), "entity_id", "entity_type", "embedding", 2).count() == 0


def test_ties_rank_by_id(spark):
    df = spark.createDataFrame([(f"{i:02}", "t", [1.0, 1.0], "") for i in range(20)], SCHEMA)
    rows = similar_pairs(df, "entity_id", "entity_type", "embedding", 2, k=3).collect()
    assert {r.other_id for r in rows if r.query_id == "19"} == {"00", "01", "02"}


def test_anisotropic_codes_keep_scores():
    x = clustered(800, 32, 3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = fit_index(["t"] * len(x), x, len(x))
    centre = index.centroids[0]
    ids = np.array([f"{i:04}" for i in range(len(x))])
    best = [o for q, o, _ in search_cell(x, x[:50], centre, index.books, 1, -1.0, ids, ids[:50])]
    exact = [ids[np.argsort(-(x @ x[i]))[1]] for i in range(50)]
    assert np.mean([a == b for a, b in zip(best, exact, strict=True)]) >= 0.9
    plain, shaped = (encode(x, x - centre, index.books, eta) for eta in (1.0, 16.0))

    def parallel(codes):
        residual = x - centre - np.stack([index.books[j][codes[:, j]] for j in range(codes.shape[1])], axis=1).reshape(len(x), -1)
        return np.mean((residual * x).sum(1) ** 2)

    assert parallel(shaped) < parallel(plain)
