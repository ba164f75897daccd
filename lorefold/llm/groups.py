"""One group identifier for all records that pairwise matches connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.session import cut

#: Contraction goes on while a round removes at least this share of the edges; the rest is the core.
WORTHWHILE = 0.2
#: Rows of one key from which it is looked up by broadcast; there are at most MOST_HOT such keys.
HOT_ROWS = 500_000
MOST_HOT = 10_000


def look_up(rows: DataFrame, key: str, held: DataFrame, at_most: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the other columns of ``held``, which has one row for a key; null where it has none.

    Keys that very many rows share, such as the centre of a star or the root of
    a giant group, aren't gathered in one task: their few rows of ``held`` are
    broadcast, all others meet in a shuffle. Of ``at_most`` rows, where that is
    known to be few, no key can have so many.
    """
    if at_most is not None and at_most < hot_rows:
        return rows.join(held, key, "left")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.filter(F.col("n") >= hot_rows))
    total = counts.count()
    if not total:
        return rows.join(held, key, "left")
    if total > MOST_HOT:  # more rows than hot_rows for each: the most frequent alone are hot
        counts = cut(counts.orderBy(F.desc("n")).limit(MOST_HOT))
    hot = counts.select(key, F.lit(True).alias("is_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")  # MOST_HOT rows at most
    few = F.broadcast(held.join(F.broadcast(hot.drop("is_hot")), key, "left_semi"))
    return marked.filter("is_hot").drop("is_hot").join(few, key, "left").unionByName(marked.filter("is_hot IS NULL").drop("is_hot").join(held, key, "left"))


def _ends(edges: DataFrame) -> DataFrame:
    """(v, degree, low, high): every vertex with its smallest and largest neighbour."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    return both.groupBy("v").agg(F.count(F.lit(1)).alias("degree"), F.min("w").alias("low"), F.max("w").alias("high"))


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _strip_leaves(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes degree-one vertices; of a single edge between two, the larger. (parents, edges left)"""
    leaves = _ends(edges).filter("degree = 1").select("v", *_pair("v", "low"))
    spokes = cut(
        leaves.groupBy("a", "b").agg(F.count(F.lit(1)).alias("tips"), F.max("v").alias("v"))
    )
    parents = spokes.select("v", F.when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent"))
    return parents, edges.join(spokes, ["a", "b"], "left_anti")


def _compress_chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces each chain of degree-two vertices by one edge between its ends. (parents, edges left)

    List ranking: an arc (v, w) leaves the chain vertex v towards w; its pointer
    is doubled until it meets a vertex of another degree. Joins are on vertex
    pairs, so a hub with many chains is no hot key here. Rings without such a vertex
    never end; they are left to the core.
    """
    twos = _ends(edges).filter("degree = 2")
    through = twos.select("v", F.col("low").alias("w"), F.col("high").alias("back")).unionAll(
        twos.select("v", F.col("high").alias("w"), F.col("low").alias("back"))
    )
    through = cut(through)
    onward = through.select(F.col("v").alias("w"), F.col("back").alias("v"), F.col("w").alias("then"))
    arcs = through.select("v", "w").join(onward, ["v", "w"], "left").select(
        "v",
        "w",
        F.when(F.col("then").isNotNull(), F.col("w")).alias("nv"),
        F.col("then").alias("nw"),
        F.when(F.col("then").isNull(), F.col("w")).alias("end"),
    )
    open_before = None
    while True:
        arcs = cut(arcs)
        still = arcs.filter("end IS NULL").count()
        if still == 0 or still == open_before:
            break
        open_before = still
        ahead = arcs.select(F.col("v").alias("nv"), F.col("w").alias("nw"), F.col("nv").alias("nnv"), F.col("nw").alias("nnw"), F.col("end").alias("nend"))
        arcs = arcs.join(ahead, ["nv", "nw"], "left").select(
            "v",
            "w",
            F.when(F.col("end").isNull(), F.col("nnv")).alias("nv"),
            F.when(F.col("end").isNull(), F.col("nnw")).alias("nw"),
            F.coalesce("end", "nend").alias("end"),
        )
    done = arcs.filter("end IS NOT NULL")
    chains = cut(done.groupBy("v").agg(F.min("end").alias("parent"), F.max("end").alias("other")))
    bridges = chains.filter("parent <> other").select(*_pair("parent", "other")).distinct()
    touched = done.select(*_pair("v", "w")).distinct()
    left = edges.join(touched, ["a", "b"], "left_anti").unionAll(bridges).distinct()
    return chains.select("v", "parent"), left


def roots_of(parents: DataFrame, at_most: int | None = None) -> DataFrame:
    """Pointer doubling over a forest (v, parent) of ``at_most`` rows: every removed vertex with its root."""
    parents = cut(parents)
    at_most = parents.count() if at_most is None else at_most
    while True:
        up = parents.select(F.col("v").alias("parent"), F.col("parent").alias("above"))
        jumped = cut(look_up(parents, "parent", up, at_most).select("v", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        parents = jumped.select("v", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def _contract_core(edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Hangs every vertex below its smallest smaller neighbour and contracts the trees."""
    roots = roots_of(_ends(edges).filter("low < v").select("v", F.col("low").alias("parent")), 2 * size)
    by_a = look_up(edges, "a", roots.select(F.col("v").alias("a"), F.col("parent").alias("ra")), size)
    left = (
        look_up(by_a, "b", roots.select(F.col("v").alias("b"), F.col("parent").alias("rb")), size)
        .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        .filter("x <> y")
        .select(*_pair("x", "y"))
        .distinct()
    )
    return roots, left


def connected_groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(record_id, group_id): every id with the smallest id it is linked to, directly or not.

    Degree-one vertices are stripped and chains of degree-two vertices
    compressed by list ranking, again and again while that removes much; the
    reduced core is solved by contraction; then every removed vertex gets the
    label of the vertex it was hung below. Links, vertices and labels stay in
    DataFrames; the driver only sees counts.

    A null on one side links nothing, but the other id is still a record; rows
    null on both sides give nothing. Self links and repeated pairs change
    nothing. An empty table gives no rows; other columns are not read.
    """
    links = pairs.select(F.col(left).cast("string").alias("x"), F.col(right).cast("string").alias("y"))
    records = (
        links.select(F.col("x").alias("v")).unionAll(links.select(F.col("y").alias("v"))).filter("v IS NOT NULL").distinct()
    )
    edges = cut(links.filter("x <> y").select(*_pair("x", "y")).distinct())
    size, hung, core = edges.count(), [], False
    vertices = 2 * size  # at most
    while size:
        if core:
            parents, edges = _contract_core(edges, size)
            hung.append(parents)
        else:
            for step in (_strip_leaves, _compress_chains):
                parents, edges = step(edges)
                hung.append(parents)
        edges = cut(edges)
        now = edges.count()
        core = core or now > (1 - WORTHWHILE) * size
        size = now
    if not hung:
        return records.select(F.col("v").alias("record_id"), F.col("v").alias("group_id"))
    forest = hung[0]
    for parents in hung[1:]:
        forest = forest.unionAll(parents)
    labelled = cut(records.join(roots_of(forest, vertices), "v", "left").select("v", F.coalesce("parent", "v").alias("root")))
    smallest = labelled.groupBy("root").agg(F.min("v").alias("group_id"))
    return look_up(labelled, "root", smallest, vertices).select(F.col("v").alias("record_id"), "group_id")
