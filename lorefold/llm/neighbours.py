"""Most similar vectors for every vector: anisotropic 4-bit codes, table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows on which centroids and codebooks are fitted, at most.
FIT_ROWS = 16_384
#: Vectors that a cell is meant to hold; cells estimated above BLOCK_ROWS are split into blocks.
CELL_ROWS = 600
BLOCK_ROWS = 8_192
#: Centroids, and residual centroids that every one of them shares: cells are the pairs of both, so their number
#: grows with the rows to MOST_CELLS * MOST_FINE while the model stays bounded.
MOST_CELLS = 2_048
MOST_FINE = 2_048
#: Cells that every vector is placed in, one more where cells are pairs; and centroids whose pairs are looked at then.
SPILL = 2
PROBES = 4
#: Components in a 4-bit code, and candidates that are reranked exactly.
WIDTH = 8
RERANK = 64
#: Score from which parallel residual error is penalised.
ANISOTROPIC_T = 0.2
_QUERIES_AT_ONCE = 64


@dataclass
class Index:
    """centroids (c, d); fine (f, d), one of zeros where cells are no pairs; books (d / WIDTH, 16, WIDTH); blocks[(group, cell)] where more than one."""

    centroids: np.ndarray
    fine: np.ndarray
    books: np.ndarray
    blocks: dict[tuple[str, int], int]

    def centre(self, cell: int) -> np.ndarray:
        return self.centroids[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The cells that each vector is placed in, the nearest not always first."""
        coarse = _nearest(x, self.centroids, SPILL if len(self.fine) == 1 else PROBES)
        if len(self.fine) == 1:
            return coarse
        out = np.empty((len(x), min(SPILL + 1, coarse.shape[1] * len(self.fine))), np.int64)
        half = 0.5 * (self.fine**2).sum(1)
        for at in range(0, len(x), 256):  # bounds the scores that are held at once
            near = coarse[at : at + 256]
            rest = x[at : at + 256, None] - self.centroids[near]
            score = rest @ self.fine.T - half - 0.5 * (rest**2).sum(2, keepdims=True)
            cells = near[:, :, None] * len(self.fine) + np.arange(len(self.fine))
            flat = score.reshape(len(near), -1)
            best = np.argpartition(-flat, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            out[at : at + 256] = np.take_along_axis(cells.reshape(len(near), -1), best, axis=1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def _kmeans(x: np.ndarray, c: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.choice(len(x), c, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ centroids.T - 0.5 * (centroids**2).sum(1), axis=1) for i in range(0, len(x), 4096)])
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=c)
        np.add.at(sums, near, x)
        held = counts > 0
        centroids[held] = sums[held] / counts[held, None]
        centroids[~held] = x[rng.integers(len(x), size=int((~held).sum()))]
    return centroids


def encode(x: np.ndarray, residual: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, m) by coordinate descent on |r|^2 + (eta - 1) (r . x)^2 for unit vectors x."""
    m, _, w = books.shape
    parts, xs = residual.reshape(-1, m, w), x.reshape(-1, m, w)
    plain = np.stack([(books[j] ** 2).sum(1) - 2 * parts[:, j] @ books[j].T for j in range(m)], axis=1)
    along = np.stack([xs[:, j] @ books[j].T for j in range(m)], axis=1)
    codes = plain.argmin(axis=2)
    rows = np.arange(len(x))
    error = (parts * xs).sum((1, 2)) - sum(along[rows, j, codes[:, j]] for j in range(m))
    for _ in range(sweeps):
        for j in range(m):
            rest = error + along[rows, j, codes[:, j]]
            loss = plain[:, j] + (eta - 1) * (rest[:, None] - along[:, j]) ** 2
            codes[:, j] = loss.argmin(axis=1)
            error = rest - along[rows, j, codes[:, j]]
    return codes.astype(np.uint8)


def _fit_books(x: np.ndarray, residual: np.ndarray, eta: float, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """Codebooks that minimise the anisotropic loss: assignment and exact codeword updates in turn."""
    d = x.shape[1]
    m = d // WIDTH
    parts, xs = residual.reshape(-1, m, WIDTH), x.reshape(-1, m, WIDTH)
    books = np.stack([_kmeans(parts[:, j], 16, 4, rng) for j in range(m)])
    for _ in range(rounds):
        codes = encode(x, residual, books, eta, sweeps=1)
        chosen = np.stack([books[j][codes[:, j]] for j in range(m)], axis=1)
        off = ((parts - chosen) * xs).sum(2)
        total = off.sum(1)
        for j in range(m):
            rest = total - off[:, j] + (parts[:, j] * xs[:, j]).sum(1)
            for k in range(16):
                own = codes[:, j] == k
                if own.any():
                    p, a = parts[own, j].astype(np.float64), xs[own, j].astype(np.float64)
                    lhs = own.sum() * np.eye(WIDTH) + (eta - 1) * a.T @ a
                    books[j, k] = np.linalg.solve(lhs, p.sum(0) + (eta - 1) * a.T @ rest[own])
    return books


def fit_index(groups: list[str], x: np.ndarray, rows: int, seed: int = 7) -> Index:
    """An index fitted on unit sample vectors ``x`` of ``rows`` in all."""
    if x.shape[1] % WIDTH:
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))
    rng = np.random.default_rng(seed)
    wanted = max(1, rows // CELL_ROWS)
    cells = int(np.clip(wanted, 1, min(MOST_CELLS, max(1, len(x) // 8))))
    centroids = _kmeans(x, cells, 6, rng)
    near = _nearest(x, centroids, 1)[:, 0]
    pairs = int(np.clip(wanted // cells, 1, min(MOST_FINE, max(1, len(x) // 8))))
    fine = _kmeans(x - centroids[near], pairs, 6, rng) if pairs > 1 else np.zeros((1, x.shape[1]), x.dtype)
    index = Index(centroids, fine, np.zeros((0, 16, WIDTH)), {})
    placed = index.nearest(x)
    eta = (x.shape[1] - 1) * ANISOTROPIC_T**2 / (1 - ANISOTROPIC_T**2)
    some = np.resize(np.arange(len(x)), max(64, min(len(x), 4096)))
    index.books = _fit_books(x[some], x[some] - centroids[placed[some, 0] // pairs] - fine[placed[some, 0] % pairs], eta, rng)
    # rows of a cell: those of its centroid in the group, and the share of its residual centroid
    scale = rows / len(x)
    held: dict[tuple[str, int], int] = {}
    share = np.bincount((placed % pairs).ravel(), minlength=pairs) / placed.size
    for group, own in zip(groups, placed, strict=True):
        for cell in own:
            held[group, int(cell) // pairs] = held.get((group, int(cell) // pairs), 0) + 1
    for (group, coarse), n in held.items():
        for f in range(pairs):
            if n * scale * share[f] > BLOCK_ROWS:
                index.blocks[group, coarse * pairs + f] = int(np.ceil(n * scale * share[f] / BLOCK_ROWS))
    return index


def _nearest(x: np.ndarray, centroids: np.ndarray, many: int) -> np.ndarray:
    take = min(many, len(centroids))
    score = x @ centroids.T - 0.5 * (centroids**2).sum(1)
    return np.argpartition(-score, take - 1, axis=1)[:, :take]


def search_cell(points: np.ndarray, queries: np.ndarray, centroid: np.ndarray, books: np.ndarray, k: int, least: float, point_ids: np.ndarray, query_ids: np.ndarray) -> Iterator[tuple]:
    """(query id, point id, similarity) of the best k others at ``least`` or above, by scan and rerank."""
    m, _, w = books.shape
    wide = m * w
    pad = lambda x: np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x
    full, asked = pad(points), pad(queries)
    scan = len(points) > RERANK + 1
    if scan:
        eta = (wide - 1) * ANISOTROPIC_T**2 / (1 - ANISOTROPIC_T**2)
        codes = encode(full, full - centroid, books, eta)
        if m % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        bytes_ = codes[:, 0::2].astype(np.intp) * 16 + codes[:, 1::2]
    for at in range(0, len(queries), _QUERIES_AT_ONCE):
        q, names = asked[at : at + _QUERIES_AT_ONCE], query_ids[at : at + _QUERIES_AT_ONCE]
        if scan:
            tables = np.einsum("qmw,mkw->mkq", q.reshape(len(q), m, w), books)
            if m % 2:
                tables = np.concatenate([tables, np.zeros_like(tables[:1])])
            both = (tables[0::2, :, None] + tables[1::2, None]).reshape(len(tables) // 2, 256, len(q))
            rough = np.zeros((len(points), len(q)), np.float32)
            for j in range(len(both)):
                rough += both[j][bytes_[:, j]]
            best = np.argpartition(-rough, RERANK, axis=0)[: RERANK + 1].T
        else:
            best = np.broadcast_to(np.arange(len(points)), (len(q), len(points)))
        exact = np.einsum("qrd,qd->qr", full[best].astype(np.float64), q.astype(np.float64))
        for row, name in enumerate(names):
            good = np.flatnonzero(exact[row] >= least)
            found = sorted((-exact[row, g], point_ids[best[row, g]]) for g in good if point_ids[best[row, g]] != name)
            for score, other in found[:k]:
                yield name, other, -score


def similar_pairs(vectors: DataFrame, id_column: str, group_column: str, vector_column: str, dims: int, k: int = 10, least: float = -1.0) -> DataFrame:
    """(query_id, other_id, similarity): for every vector its k most similar others of its group.

    Cosine similarity, at ``least`` or more. The index (cell centroids, 4-bit
    codebooks under a score-aware anisotropic loss) is fitted on at most
    FIT_ROWS rows; every row is indexed, in the SPILL cells nearest to it, and
    every row is a query in these cells. A cell is scanned by 4-bit tables and
    the RERANK best are ranked again by their exact similarity. Cells that are
    large even so are split into blocks of points and of queries, each pair of
    which is scanned apart. Equal vectors of a group are searched once, for all
    of them. Equal similarities rank by id.

    Vectors of another length, with nulls, NaN or infinite members, or all
    zero, and rows without id or group, aren't usable and don't take part. Of
    several usable rows of an id one counts: equal ones are one row, of
    different ones that of the smallest hash. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    usable = vectors.select(
        F.col(id_column).cast("string").alias("id"), F.col(group_column).cast("string").alias("grp"), F.col(vector_column).cast("array<float>").alias("v")
    ).filter(
        F.col("id").isNotNull() & F.col("grp").isNotNull() & (F.size("v") == dims)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    usable = usable.withColumn("h", F.xxhash64("grp", "v"))
    ids = usable.groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    rows, unclear = ids.agg(F.count(F.lit(1)), F.count_if(F.col("low") != F.col("high"))).first()
    if unclear:
        usable = usable.join(ids.filter("low <> high").select("id", F.col("low")), "id", "left").filter("low IS NULL OR h = low")
    schema = "query_id string, other_id string, similarity double"
    if not rows:
        return spark.createDataFrame([], schema)
    # equal vectors are one; two hashes stand for a vector
    usable = usable.withColumn("h2", F.hash("v"))
    same = usable.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    copied = same.filter("rep <> last")
    if copied.isEmpty():
        searched, members = usable, None
    else:
        members = usable.select("id", "h", "h2").distinct().join(same.select("h", "h2", "rep"), ["h", "h2"]).select("id", "rep")
        searched = usable.join(same.select("rep"), F.col("id") == F.col("rep"), "left_semi")
    # rows in the order of a hash, so that the bound below takes no part of the table before another
    part = usable if rows <= FIT_ROWS else usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * FIT_ROWS / rows) + 1)
    sample = part.select("grp", "v", F.xxhash64("id", F.lit(1)).alias("o")).orderBy("o").limit(FIT_ROWS).drop("o").toArrow()
    x = _unit(sample.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, dims))
    index = spark.sparkContext.broadcast(fit_index(sample.column("grp").to_pylist(), x, rows))  # at most MOST_CELLS centroids and MOST_FINE residual ones

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                if not b.num_rows:
                    continue
                x = _unit(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                wide = np.pad(x, ((0, 0), (0, -dims % WIDTH)))
                cells = ix.nearest(wide)
                raw = [r.tobytes() for r in x]
                out: dict[str, list] = {n: [] for n in ("grp", "cell", "block", "asked", "point", "query", "id", "x")}
                for name, group, own, vec in zip(b.column("id").to_pylist(), b.column("grp").to_pylist(), cells, raw, strict=True):
                    for cell in map(int, own):
                        n = ix.blocks.get((group, cell), 1)
                        home = hash_of(name) % n
                        # a point in its own block for every block of queries, a query in its own for every block of points
                        places = [(home, q, True, q == home) for q in range(n)] + [(b, home, False, True) for b in range(n) if b != home]
                        for place_ in places:
                            for key, value in zip(out, (group, cell, *place_, name, vec), strict=True):
                                out[key].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["grp"]), pa.array(out["cell"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["asked"], pa.int32()), pa.array(out["point"]), pa.array(out["query"]), pa.array(out["id"]), pa.array(out["x"], pa.binary())],
                    names=list(out),
                )

    def scan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ix: Index = index.value
        pdf = pdf.drop_duplicates("id")
        names = pdf["id"].to_numpy()
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(-1, dims)
        here, asks = pdf["point"].to_numpy(), pdf["query"].to_numpy()
        found = search_cell(x[here], x[asks], ix.centre(key[1]), ix.books, k, least, names[here], names[asks])
        return pd.DataFrame(list(found), columns=["query_id", "other_id", "similarity"])

    placed = searched.select("id", "grp", "v").mapInArrow(place, "grp string, cell int, block int, asked int, point boolean, query boolean, id string, x binary")
    found = placed.groupBy("grp", "cell", "block", "asked").applyInPandas(scan, schema).groupBy("query_id", "other_id").agg(F.max("similarity").alias("similarity"))
    if members is not None:
        found = _with_copies(found, members, k, least)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "other_id")
    return found.withColumn("nth", F.row_number().over(ranked)).filter(F.col("nth") <= k).drop("nth")


def _with_copies(found: DataFrame, members: DataFrame, k: int, least: float) -> DataFrame:
    """Neighbours of representatives given to all of their copies, as (query_id, other_id, similarity); the best k of each are among them.

    members: (id, rep) of every id. Of copies of one vector the k + 1 smallest
    ids can be among anyone's k best, itself left out.
    """
    by_id = Window.partitionBy("rep").orderBy("id")
    first = members.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1).drop("nth")
    own = first.filter(F.lit(least) <= 1.0).select(F.col("rep").alias("query_id"), F.col("id").alias("other_id"), F.lit(1.0).alias("similarity"))
    others = found.join(first.select(F.col("rep").alias("other_id"), "id"), "other_id").select("query_id", F.col("id").alias("other_id"), "similarity")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "other_id")
    few = own.unionByName(others).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).drop("nth")
    return few.withColumnRenamed("query_id", "rep").join(members, "rep").filter("id <> other_id").select(F.col("id").alias("query_id"), "other_id", "similarity")


def hash_of(name: str) -> int:
    """A hash that is the same in every process."""
    value = 2166136261
    for byte in name.encode():
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    return value


def close_pairs(vectors: DataFrame, id_column: str, group_column: str, vector_column: str, dims: int, k: int, least: float) -> DataFrame:
    """(entity_a, entity_b), smaller first: pairs of which one is among the k most similar of the other."""
    pairs = similar_pairs(vectors, id_column, group_column, vector_column, dims, k, least)
    return pairs.select(F.least("query_id", "other_id").alias("entity_a"), F.greatest("query_id", "other_id").alias("entity_b")).distinct()
