"""Packing documents into containers of fixed token capacity by best-two-fit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.llm.tokens import TOKENIZER_DIR, token_counts
from lorefold.session import cut

#: Items that one task packs; each shard leaves at most one poorly filled container.
SHARD_ITEMS = 40_000


class _Pool:
    """Unpacked items by size: a count for each size and a bit for each size there is."""

    def __init__(self, items: list[tuple[int, tuple]]):
        self.by_size: dict[int, list[tuple]] = {}
        for size, item in items:
            self.by_size.setdefault(size, []).append(item)
        self.mask = sum(1 << size for size in self.by_size)

    def largest(self, limit: int) -> int:
        """The largest size up to ``limit``, or -1."""
        return (self.mask & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 else -1

    def take(self, size: int) -> tuple:
        held = self.by_size[size]
        item = held.pop()
        if not held:
            del self.by_size[size]
            self.mask ^= 1 << size
        return item

    def put(self, size: int, item: tuple) -> None:
        self.by_size.setdefault(size, []).append(item)
        self.mask |= 1 << size

    def best_two(self, room: int, above: int) -> tuple[int, int] | None:
        """Two sizes that fill ``room`` best, together more than ``above``."""
        best, found = above, None
        first = self.largest(room - 1)
        while first > 0 and 2 * first > best:
            second = self.largest(min(first, room - first))
            if second == first and len(self.by_size[first]) < 2:
                second = self.largest(first - 1)
            if second > 0 and first + second > best:
                best, found = first + second, (first, second)
                if best == room:
                    break
            first = self.largest(first - 1)
        return found


def best_two_fit(items: list[tuple[int, tuple]], capacity: int) -> list[list[tuple[int, tuple]]]:
    """Containers of (size, item). Sizes lie between 1 and ``capacity``.

    A container is opened with the largest unpacked item and filled greedily
    with the largest that fits. If room is left, its smallest item gives way to
    two unpacked ones that fill the room better.
    """
    pool, bins = _Pool(sorted(items, key=lambda x: (x[0], x[1]), reverse=True)), []
    while pool.mask:
        size = pool.largest(capacity)
        held, room = [(size, pool.take(size))], capacity - size
        while (size := pool.largest(room)) > 0:
            held.append((size, pool.take(size)))
            room -= size
        if room and (two := pool.best_two(room + held[-1][0], held[-1][0])):
            pool.put(*held.pop())
            held += [(s, pool.take(s)) for s in two]
        bins.append(held)
    return bins


def pack_documents(documents: DataFrame, containers: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_kind, container_id, doc_id, part, parts, start_token, tokens, capacity_tokens).

    Every document is assigned once for each kind of container. One that
    exceeds the capacity is cut into parts of exactly the capacity and a rest,
    which is packed like others; no other is split. Documents are spread over
    shards by a hash of their id and packed within their shard, so no task
    holds more than about ``shard_items``; copies of a text are packed one by
    one. Null and empty texts have no tokens and take part 0 of a container
    named ``empty``. Kinds without a positive capacity get nothing; a kind that
    is named twice has its largest capacity. Empty tables give no rows.
    """
    sizes = cut(token_counts(documents, ["doc_id"], tokenizer_dir))
    kinds = containers.filter("container_kind IS NOT NULL AND capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("c")).orderBy("container_kind").collect()  # a short parameter table
    schema = "container_kind string, container_id string, doc_id long, part int, parts int, start_token long, tokens long, capacity_tokens int"
    if not kinds:
        return documents.sparkSession.createDataFrame([], schema)
    shards = max(1, -(-sizes.count() // shard_items))
    menu = F.array(*[F.struct(F.lit(r.container_kind).alias("container_kind"), F.lit(r.c).cast("int").alias("capacity_tokens")) for r in kinds])
    each = sizes.select("doc_id", "tokens", F.inline(menu)).withColumn(
        "parts", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens"))).cast("int")
    )
    rest = F.col("tokens") - (F.col("parts") - 1) * F.col("capacity_tokens")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    full = each.filter("parts > 1").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("parts") - 2)).alias("part")
    ).select(
        "container_kind", F.concat_ws("-", "container_kind", F.lit("full"), name, "part").alias("container_id"), "doc_id", "part", "parts",
        (F.col("part") * F.col("capacity_tokens")).cast("long").alias("start_token"), F.col("capacity_tokens").cast("long").alias("tokens"), "capacity_tokens",
    )
    loose = each.select(
        "container_kind", "doc_id", (F.col("parts") - 1).alias("part"), "parts", (F.col("tokens") - rest).alias("start_token"), rest.alias("tokens"), "capacity_tokens",
        F.pmod(F.xxhash64(name), F.lit(shards)).alias("shard"),
    )
    empty = loose.filter("tokens <= 0").select(
        "container_kind", F.concat_ws("-", "container_kind", F.lit("empty")).alias("container_id"), "doc_id", "part", "parts", "start_token", F.lit(0).cast("long").alias("tokens"), "capacity_tokens"
    )

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, capacity, shard = key
        items = [(int(t), (i,)) for i, t in enumerate(pdf.sort_values(["tokens", "doc_id", "part"])["tokens"])]
        ordered = pdf.sort_values(["tokens", "doc_id", "part"]).reset_index(drop=True)
        names = [""] * len(ordered)
        for n, held in enumerate(best_two_fit(items, int(capacity))):
            for _, (i,) in held:
                names[i] = f"{kind}-{shard}-{n}"
        ordered["container_id"] = names
        return ordered[["container_kind", "container_id", "doc_id", "part", "parts", "start_token", "tokens", "capacity_tokens"]]

    packed = loose.filter("tokens > 0").groupBy("container_kind", "capacity_tokens", "shard").applyInPandas(pack, schema)
    return packed.unionByName(full).unionByName(empty)


def packing_report(packed: DataFrame) -> DataFrame:
    """(container_kind, containers, documents, tokens, fill) of a packing; ``fill`` is the used part of the space."""
    boxes = packed.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("used"), F.max("capacity_tokens").alias("space"), F.count(F.lit(1)).alias("pieces"), F.count_if(F.col("part") == 0).alias("firsts"))
    return boxes.filter("used > 0").groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("firsts").alias("documents"), F.sum("used").alias("tokens"), (F.sum("used") / F.sum("space")).alias("fill")
    )
