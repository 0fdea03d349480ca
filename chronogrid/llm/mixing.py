"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are put into blocks by a hash. A source's target becomes an exact quota of blocks, drawn in
permuted order, whole passes first. The quotas of all sources are parted among the output shards by a binary tree:
each node deals half of its block draws, without replacement, to the left. Leaves take disjoint runs of the permuted
blocks and order their documents by a hash. Only DataFrame functions run on the executors; the driver sees one row
per source.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronogrid.llm.common import free_name
from chronogrid.shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the block table, which is broadcast; 32 bytes each.
MAX_BLOCKS = 1 << 18


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], budget: float, limit: float = 2.0) -> list[float]:
    """Shares of budget by weight; a share stops at limit times its size, and the excess goes by weight to the rest."""
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > limit * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = limit * sizes[i]
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return target


def splitting_tree(quotas: list[int], leaves: int, seed: int) -> list[list[int]]:
    """For each leaf its number of draws from each source; sums are exact and a leaf's total differs by one at most."""
    rng = np.random.default_rng(seed)
    out: list[list[int]] = []

    def part(q: np.ndarray, n: int) -> None:
        if n == 1:
            out.append([int(x) for x in q])
            return
        left = n // 2
        take = int(q.sum()) * left // n
        got = rng.multivariate_hypergeometric(q, take, method="marginals") if q.size else q
        part(got, left)
        part(q - got, n - left)

    part(np.array(quotas, dtype=np.int64), leaves)
    return out


def _plan(docs: DataFrame, source_col: str, key: str, size: str, weights, share, limit, leaves: int, seed: int, fills: int):
    """(per-source table, block table, bits of a key that name its block); both tables are small by their bounds."""
    spark = docs.sparkSession
    rows = docs.groupBy(source_col).agg(F.sum(size).alias("s")).limit(MAX_BLOCKS + 1).collect()
    if len(rows) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} sources")
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r["s"] or 0 for r in rows]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), limit)
    bits = max(0, min(12, int(math.log2(MAX_BLOCKS / max(1, len(rows))))))
    passes = [int(t // s) if s else 0 for t, s in zip(target, sizes, strict=True)]
    rest = [max(0, math.floor(t - p * s + 0.5)) for t, s, p in zip(target, sizes, passes, strict=True)]
    schema = f"name {docs.schema[source_col].dataType.simpleString()}, src int, source_size long, target double, passes int, rest long"
    sources = spark.createDataFrame([(r[0], i, sizes[i], target[i], passes[i], rest[i]) for i, r in enumerate(rows)], schema)
    units = (
        docs.join(F.broadcast(sources), F.col(source_col).eqNullSafe(F.col("name")))
        .groupBy("src", F.col(key).alias("key"))
        .agg(F.sum(size).alias("size"))
        .withColumn("block", F.shiftrightunsigned(F.col("key"), 64 - bits) if bits else F.lit(0).cast("long"))
    )
    units = materialise(units)
    order = W.partitionBy("src").orderBy(F.xxhash64("block", "src", F.lit(seed)), "block")
    blocks = materialise(
        units.groupBy("src", "block")
        .agg(F.sum("size").alias("words"))
        .withColumn("pos", F.row_number().over(order))
        .withColumn("upto", F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0)))
    )
    small = F.broadcast(sources.select("src", "rest"))
    # the block in which the rest of the target ends, and how far its documents go in key order
    edge = blocks.join(small, "src").filter("upto - words < rest and rest <= upto").select("src", "block", "pos", (F.col("upto") - F.col("words")).alias("before"), "rest")
    inside = (
        units.join(F.broadcast(edge), ["src", "block"])
        .withColumn("upto", F.sum("size").over(W.partitionBy("src").orderBy("key").rowsBetween(W.unboundedPreceding, 0)))
        .filter("before + upto <= rest")
        .groupBy("src")
        .agg(F.max("key").alias("last"), F.max("upto").alias("got"))
    )
    ends = {r["src"]: r.asDict() for r in edge.join(inside, "src", "left").collect()}
    lowest = -(1 << 63)
    edge_pos = [ends[i]["pos"] if i in ends else (1 << 30 if rest[i] else 0) for i in range(len(rows))]
    last_key = [ends[i]["last"] if i in ends and ends[i]["last"] is not None else lowest for i in range(len(rows))]
    gap = {i: e["rest"] - e["before"] - (e["got"] or 0) for i, e in ends.items()}
    extra: list[list[int]] = [[] for _ in rows]

    def table() -> DataFrame:
        held = [(r[0], i, sizes[i], target[i], passes[i], edge_pos[i], last_key[i], extra[i], gap.get(i, 0)) for i, r in enumerate(rows)]
        return spark.createDataFrame(held, schema.replace("rest long", "edge_pos long, last_key long, extra array<long>, gap long"))

    # a document that just overran the target is replaced by the largest unused one that still fits, a few times
    for _ in range(fills):
        if not any(gap.values()):
            break
        free = (
            units.filter("size > 0")
            .join(F.broadcast(table().filter("gap > 0").select("src", "edge_pos", "last_key", "extra", "gap")), "src")
            .filter("size <= gap")
            .join(F.broadcast(blocks.select("src", "block", "pos")), ["src", "block"])
            .filter((F.col("pos") > F.col("edge_pos")) | ((F.col("pos") == F.col("edge_pos")) & (F.col("key") > F.col("last_key"))))
            .filter(~F.array_contains("extra", F.col("key")))
            .groupBy("src")
            .agg(F.max(F.struct("size", "key")).alias("best"))
        )
        found = free.collect()
        if not found:
            break
        for r in found:
            extra[r["src"]].append(r["best"]["key"])
            gap[r["src"]] -= r["best"]["size"]
    n_blocks = {r["src"]: r["n"] for r in blocks.groupBy("src").agg(F.count("*").alias("n")).collect()}
    quota = [n_blocks.get(i, 0) * passes[i] + min(edge_pos[i], n_blocks.get(i, 0)) for i in range(len(rows))]
    tree = splitting_tree(quota, leaves, seed)
    starts = [[sum(t[i] for t in tree[:leaf]) for leaf in range(leaves)] for i in range(len(rows))]
    dealt = F.from_json(F.lit(json.dumps(starts)), "array<array<bigint>>")
    return table().withColumn("starts", F.get(dealt, F.col("src"))), blocks.select("src", "block", "pos"), bits


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    leaves: int = 16,
    seed: int = 20240,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    fills: int = 4,
) -> DataFrame:
    """docs with size, source_size, target, taken and mix_shards (the output shard of every copy taken).

    Sources, in code-point order with null last, have the weights in turn. Their targets share ``share`` times all
    words; none is above ``limit`` times its source. A source gives whole passes and then whole documents up to its
    target, which it misses by less than the smallest unused document that was tried; a document is taken 0, 1 or 2
    times and never cut. The choice depends on ids, texts, sources and seed alone.

    Null or empty texts have size 0 and are taken by their block; rows that repeat an id and a text are taken alike; a null
    source is a source; an empty table gives an empty result; columns with the names given here are replaced.
    """
    made = ["size", "source_size", "target", "taken", "mix_shards"]
    keep = [c for c in docs.columns if c.lower() not in made]
    key, size = free_name(docs, "mix_key"), free_name(docs, "mix_size")
    keyed = docs.select(
        *keep, F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias(key), word_count(F.col(text_col)).alias(size)
    )
    narrow = materialise(keyed.select(F.col(source_col).alias("source"), F.col(key).alias("key"), F.col(size).alias("size")))
    sources, blocks, bits = _plan(narrow, "source", "key", "size", weights, share, limit, leaves, seed, fills)
    names = {c: free_name(docs, f"mix_{c}") for c in ("name", "src", "passes", "edge_pos", "last_key", "extra", "gap", "starts", "block", "pos", "n")}
    block_src = free_name(docs, "mix_block_src")
    counts = blocks.groupBy("src").agg(F.count("*").alias("n"))
    sources = sources.join(F.broadcast(counts), "src", "left").select(
        "source_size", "target", *[F.col(c).alias(names[c]) for c in ("name", "src", "passes", "edge_pos", "last_key", "extra", "starts", "n")]
    )
    blocks = blocks.select(*[F.col(c).alias(names[c]) for c in ("block", "pos")], F.col("src").alias(block_src))
    block = F.shiftrightunsigned(F.col(key), 64 - bits) if bits else F.lit(0).cast("long")
    c = {k: F.col(v) for k, v in names.items()}
    out = (
        keyed.join(F.broadcast(sources), F.col(source_col).eqNullSafe(c["name"]))
        .withColumn(names["gap"], block)
        .join(F.broadcast(blocks), (c["src"] == F.col(block_src)) & (F.col(names["gap"]) == c["block"]))
    )
    more = (c["pos"] < c["edge_pos"]) | ((c["pos"] == c["edge_pos"]) & (F.col(key) <= c["last_key"])) | F.array_contains(c["extra"], F.col(key))
    copies = c["passes"] + F.when(more, 1).otherwise(0)
    draw = lambda k: F.least((k * c["n"] + c["pos"] - 1).cast("long"), (c["passes"] * c["n"] + c["edge_pos"] - 1).cast("long"))
    leaf = lambda k: F.greatest(F.lit(0), F.size(F.filter(c["starts"], lambda s: s <= draw(k))) - 1)
    shards = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), leaf)).otherwise(F.array().cast("array<int>"))
    return out.select(
        *keep,
        F.col(size).alias("size"),
        "source_size",
        "target",
        (F.col(size) * copies).cast("long").alias("taken"),
        shards.alias("mix_shards"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every copy taken is a row with the columns of docs, dealt to its output shard and in the shard's
    shuffled order."""
    shard = free_name(docs, "mix_shard")
    made = {"size", "source_size", "target", "taken", "mix_shards"}
    clash = {x: free_name(docs, f"kept_{x}") for x in docs.columns if x.lower() in made}
    mixed = mix(docs.withColumnsRenamed(clash), **options)
    copies = mixed.select(*[F.col(clash.get(x, x)).alias(x) for x in docs.columns], F.explode("mix_shards").alias(shard))
    order = F.xxhash64(F.col(options.get("id_col", "doc_id")), F.col(shard), F.lit(options.get("seed", 20240)))
    return copies.repartition(shard, F.pmod(order, F.lit(64))).sortWithinPartitions(shard, order).select(*docs.columns)
