"""Near-duplicates by MinHash bands, odd sketches and full shingle sets.

Texts with the same set of shingles are one node. A node has ``BANDS`` x ``ROWS`` MinHash samples; nodes that agree on all
samples of a band meet in its bucket. The samples are also folded into a bitmap of ``BITS`` bits, each flipping one bit: an odd
sketch. Two sketches differ in as many bits as the sample sets differ in elements, but for chance collisions, so the
population count of their XOR tells high similarities well apart, and pairs over ``MAX_BITS`` are discarded. At similarity
0.8 a pair meets in no bucket with probability 4e-9 and is then discarded with 1e-8.

Every node is first compared with the least node of each of its buckets. Buckets whose nodes do not all hang together by
then are dealt in blocks, and two blocks at a time give a spanning forest of what the sketches leave. What hangs together so
is a cluster; its texts are read again, and only links of the full sets, within a cluster, make components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import connected_components, free_name
from chronogrid.llm.near_copies import _exact_groups, _stars, shingle_set
from chronogrid.shared import materialise

SHINGLE = 4
SIMILARITY = 0.8
BANDS, ROWS = 64, 6
BITS, MAX_BITS = 1024, 200
WORDS = BITS // 64
#: Nodes of a bucket that one task holds of each side.
BLOCK = 1024
#: Fixed seeds: a multiplier and a summand for each sample, and one for the bit that a sample flips.
_RNG = np.random.default_rng(20251)
TIMES = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
PLUS = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def hashes_of(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(s) for s in shingle_set(text, shingle)], dtype=np.uint64))


def samples(hashes: np.ndarray) -> np.ndarray:
    """The least value of every sample's permutation over the set."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    # the permutations are linear in 32 bits, so they need the upper and lower half folded together
    mixed = ((hashes ^ (hashes >> np.uint64(29))) * _ODD >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(mixed), 512):
        part = mixed[at : at + 512, None] * TIMES
        part += PLUS
        np.minimum(low, part.min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """A bucket for every band: its number and samples, hashed."""
    rows = np.ascontiguousarray(low.reshape(BANDS, ROWS))
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64)


def sketch(low: np.ndarray) -> np.ndarray:
    """The parity bitmap of the pairs (sample, value), as words."""
    with np.errstate(over="ignore"):
        h = (low.astype(np.uint64) + FLIP) * FLIP
        bit = ((h ^ (h >> np.uint64(31))) * _ODD) >> np.uint64(64 - 10)
    odd = np.bincount(bit.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prints(shingle: int):
    """digest (two longs, null without words), n_shingles, bands and sketch of each text."""

    @F.pandas_udf("struct<high:long,low:long,n_shingles:long,bands:array<long>,sketch:array<long>>")
    def column(texts: pd.Series) -> pd.DataFrame:
        def row(text: str | None) -> tuple:
            h = hashes_of(text, shingle)
            if not len(h):
                return None, None, 0, None, None
            high, low = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=">i8")
            least = samples(h)
            return int(high), int(low), len(h), bands(least), sketch(least)

        names = ["high", "low", "n_shingles", "bands", "sketch"]
        out = dict(zip(names, zip(*map(row, texts), strict=True), strict=True)) if len(texts) else dict.fromkeys(names, ())
        # with nulls among them, whole numbers would go by way of floats
        return pd.DataFrame({k: pd.array(v, dtype="Int64") if k in ("high", "low") else pd.Series(v, dtype=object) for k, v in out.items()}).astype({"n_shingles": "int64"})

    return column


def _sets(shingle: int):
    """digest and hashed shingles of each text; named nondeterministic, so that no filter on the digest is moved to before the
    join that leaves a part of the texts, which would read all of them."""

    @F.pandas_udf("struct<high:long,low:long,set:array<long>>")
    def column(texts: pd.Series) -> pd.DataFrame:
        def row(text: str | None) -> tuple:
            h = hashes_of(text, shingle)
            high, low = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=">i8")
            return int(high), int(low), h.view(np.int64)

        return pd.DataFrame([row(t) for t in texts], columns=["high", "low", "set"])

    return column.asNondeterministic()


def differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, n: s + n)


def _block_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links that connect all nodes of a deal (bucket and two of its blocks) which the sketches leave and which do not hang
    together yet; rows come sorted by deal and node, and a deal has two blocks of rows at most."""

    def solve(pdf: pd.DataFrame) -> np.ndarray:
        label, node = pdf["label"].to_numpy(), pdf["node"].to_numpy()
        bits = np.stack(pdf["sketch"].to_numpy()).view(np.uint64)
        found = []
        for i in range(len(pdf) - 1):
            open_ = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            if len(open_):
                near = open_[np.bitwise_count(bits[open_] ^ bits[i]).sum(axis=1, dtype=np.int64) <= MAX_BITS]
                if len(near):
                    found.append(np.stack([np.full(len(near), i), near], axis=1))
                    # all that hangs together from here on is not compared again
                    joined = np.isin(label, label[near])
                    label = np.where(joined, label[i], label)
        if not found:
            return np.zeros((0, 2), np.int64)
        pairs = np.concatenate(found)
        x, y = _stars(pairs[:, 0], pairs[:, 1], len(pdf))
        return np.stack([node[x], node[y]], axis=1)

    held: list[pd.DataFrame] = []

    def given() -> pd.DataFrame:
        links = [solve(part) for _, part in pd.concat(held, ignore_index=True).groupby(["bucket", "i", "j"], sort=False) if len(part) > 1]
        return pd.DataFrame(np.concatenate([np.zeros((0, 2), np.int64), *links]), columns=["a", "b"])

    keys = ["bucket", "i", "j"]
    for pdf in batches:
        if pdf.empty:
            continue
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
        if not last.all() or (held and (held[-1][keys].iloc[-1] != pdf[keys].iloc[-1]).any()):
            held.append(pdf[~last])
            yield given()
            held = []
        held.append(pdf[last])
    if held:
        yield given()


def clusters(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, component) of the nodes that hang together with others by buckets and sketches. nodes: (node, bands, sketch)."""
    spark = nodes.sparkSession
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = materialise(rows.join(least, "bucket"))
    light = nodes.select("node", "sketch")
    pairs = met.filter("node <> first").select("node", "first").distinct()
    near = pairs.join(light, "node").join(light.select(F.col("node").alias("first"), F.col("sketch").alias("other")), "first")
    stars = materialise(near.filter(differing("sketch", "other") <= MAX_BITS).select(F.col("node").alias("a"), F.col("first").alias("b")))

    labels = materialise(connected_components(stars))
    told = met.filter("n > 2").join(labels, "node", "left").select("bucket", "n", "node", F.coalesce("component", "node").alias("label"))
    open_ = told.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    left = materialise(told.join(open_, "bucket", "left_semi"))
    deals = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("node"), F.col("deals"))
    left = left.withColumn("deals", deals).withColumn("own", own)
    left = left.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    left = left.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "label").join(light, "node")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    links = dealt.mapInPandas(_block_links, "a long, b long")
    return connected_components(stars.unionAll(links))


def similar_sets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """docs' columns without the text, with n_shingles, component_id and kept.

    Two rows are linked if their sets of shingles have Jaccard similarity of at least ``similarity``, 0.8 or more; a text of
    fewer words is one shingle, and one without words (null too) has none, is linked with nothing and has its own id as
    component. component_id is the smallest id reachable, kept says whether that is the row's own. Rows that repeat an id
    stay; a row with a null id has its component's id, null if no row there has one, and is not kept. An empty table gives an
    empty result; columns with the names given here are replaced. Sets are equal by 128 bits of their shingles' hashes.
    """
    if similarity < SIMILARITY:
        raise ValueError("bands and sketches are made for similarities of 0.8 and more")
    made = ("n_shingles", "component_id", "kept")
    keep = [c for c in docs.columns if c.lower() not in made and c != text_col]
    x = free_name(docs, "print_x")
    if id_col not in keep:
        raise ValueError(f"{id_col} has a name that the result gives to another column")
    held = materialise(docs.select(*keep, _prints(shingle)(F.col(text_col)).alias(x)))
    own = held.select(F.col(id_col).alias("id"), F.col(f"{x}.high").alias("high"), F.col(f"{x}.low").alias("low"), F.col(f"{x}.bands").alias("bands"), F.col(f"{x}.sketch").alias("sketch"))
    sets = own.filter("high is not null").groupBy("high", "low").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialise(sets.withColumn("node", F.monotonically_increasing_id()))

    parts = materialise(clusters(nodes))
    wanted = nodes.join(parts, "node").select("node", "component", "id", "high", "low")
    ids = wanted.select(F.col("id").alias("wanted_id")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = rows.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
    texts = asked.select(_sets(shingle)(F.col("text")).alias("s")).select("s.*").dropDuplicates(["high", "low"])
    full = materialise(texts.join(wanted, ["high", "low"]).select("component", "node", "set"))
    groups = _exact_groups(full, similarity=similarity)
    named = nodes.join(groups, "node", "left").select("high", "low", "id", F.coalesce("group", "node").alias("group"))
    first = named.groupBy("group").agg(F.min("id").alias("first"))
    high, low, least = (free_name(docs, n) for n in ("set_high", "set_low", "set_least"))
    named = named.join(first, "group").select(F.col("high").alias(high), F.col("low").alias(low), F.col("first").alias(least))
    out = held.join(named, (F.col(f"{x}.high") == F.col(high)) & (F.col(f"{x}.low") == F.col(low)), "left")
    component = F.when(F.col(f"{x}.high").isNull(), F.col(id_col)).otherwise(F.col(least))
    kept = F.coalesce(F.col(id_col) == component, F.lit(False))
    return out.select(*keep, F.col(f"{x}.n_shingles").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
