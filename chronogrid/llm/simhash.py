"""SimHash near-duplicates with pivot distance tables.

Fingerprints within ``max_bits`` of each other are linked. Candidates meet where they agree on two of five bit blocks
(more than three differing bits are needed to break four of five). In a bucket every fingerprint has a table of its
Hamming distances to fixed reference fingerprints: by the triangle inequality a pair whose tables differ by more than
``max_bits`` in any coordinate is discarded, and only the rest is compared bit by bit. A bucket gives a spanning forest,
never its pairs. A bucket over ``bucket_rows`` is divided by further blocks of its free bits, until those bound it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import connected_components, free_name
from chronogrid.shared import materialise

SEED = 42
BLOCKS = (13, 13, 13, 13, 12)
#: Reference fingerprints for the distance tables.
PIVOTS = np.random.default_rng(20240).integers(0, 1 << 63, 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half of the shingles' hashes; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = words if shingle == 1 else [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))
    digest, n = xxhash.xxh64_intdigest, len(parts)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(s, SEED) for s in parts[at : at + (1 << 16)]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text, shingle: int = 3):
    @F.pandas_udf("long")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype=np.uint64).astype(np.int64)

    return column(text)


def _masks(levels: int) -> list[list[int]]:
    """Masks of the bits two blocks fix; then each mask with one of four parts of its free bits, level by level."""
    blocks, low = [], 0
    for width in BLOCKS:
        blocks.append(((1 << width) - 1) << low)
        low += width
    out = [[blocks[i] | blocks[j] for i in range(5) for j in range(i)]]
    for _ in range(levels - 1):
        finer = []
        for mask in out[-1]:
            free = [b for b in range(64) if not mask >> b & 1]
            for part in np.array_split(free, 4):
                finer.append(mask | sum(1 << int(b) for b in part))
        out.append(finer)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(bits: np.ndarray, nodes: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Edges from each member of a linked set to its smallest node."""
    table = np.bitwise_count(bits[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    bits, nodes, table = bits[order], nodes[order], table[order]
    open_ = np.arange(len(bits))
    while len(open_) > 1:
        frontier, group, open_ = open_[:1], [open_[:1]], open_[1:]
        while len(frontier) and len(open_):
            new = np.zeros(len(open_), dtype=bool)
            for at in range(0, len(frontier), 64):
                f = frontier[at : at + 64]
                first = table[open_, 0]
                lo = np.searchsorted(first, table[f, 0].min() - max_bits, "left")
                hi = np.searchsorted(first, table[f, 0].max() + max_bits, "right")
                part = open_[lo:hi]
                near = np.abs(table[f][:, None, :] - table[part][None, :, :]).max(axis=2) <= max_bits
                a, b = np.nonzero(near)
                new[lo + b[np.bitwise_count(bits[f[a]] ^ bits[part[b]]) <= max_bits]] = True
            frontier, open_ = open_[new], open_[~new]
            group.append(frontier)
        members = nodes[np.concatenate(group)]
        if len(members) > 1:
            root = members.min()
            yield from ((int(m), int(root)) for m in members if m != root)


def _bucket_forests(max_bits: int):
    """Linked sets of every bucket; rows come sorted by bucket (mask, val)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            m, v = pdf["mask"].to_numpy(), pdf["val"].to_numpy()
            start = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (v[1:] != v[:-1])])
            end = np.r_[start[1:], len(pdf)]
            bits, nodes = pdf["bits"].to_numpy().astype(np.uint64), pdf["node"].to_numpy()
            many = end - start > 1
            edges = [e for s, t in zip(start[many], end[many], strict=True) for e in _forest(bits[s:t], nodes[s:t], max_bits)]
            return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

        rest: pd.DataFrame | None = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            last = (pdf["mask"] == pdf["mask"].iloc[-1]) & (pdf["val"] == pdf["val"].iloc[-1])
            rest = pdf[last]
            yield solve(pdf[~last])
        if rest is not None:
            yield solve(rest)

    return run


def link_fingerprints(prints: DataFrame, max_bits: int = 3, bucket_rows: int = 4096, levels: int = 5) -> DataFrame:
    """Edges (a, b) that connect every two fingerprints at most max_bits apart. prints: distinct (bits, node)."""
    if max_bits > 3:
        raise ValueError("five blocks find all pairs of up to three differing bits")
    spark = prints.sparkSession
    masks = _masks(levels)
    rows = prints.select("bits", "node", F.explode(F.array(*[F.lit(i) for i in range(len(masks[0]))])).alias("mask"))
    edges = None
    for level in range(levels):
        held = F.array(*[F.lit(_signed(m)) for m in masks[level]]) if level == 0 else F.split(F.lit(",".join(str(_signed(m)) for m in masks[level])), ",").cast("array<bigint>")
        rows = rows.withColumn("val", F.col("bits").bitwiseAND(F.get(held, F.col("mask"))))
        hot = None
        if level < levels - 1:
            hot = materialise(rows.groupBy("mask", "val").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("mask", "val"))
            if hot.isEmpty():
                hot = None
        calm = rows if hot is None else rows.join(hot, ["mask", "val"], "left_anti")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = (
            calm.select("mask", "val", "bits", "node")
            .repartition(n, "mask", "val")
            .sortWithinPartitions("mask", "val", "bits")
            .mapInPandas(_bucket_forests(max_bits), "a long, b long")
        )
        edges = found if edges is None else edges.unionAll(found)
        if hot is None:
            break
        rows = rows.join(hot, ["mask", "val"], "left_semi").select(
            "bits", "node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("mask") * 4 + i)).alias("mask")
        )
    return edges


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3
) -> DataFrame:
    """docs' columns without the text, with fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links of at most max_bits differing bits; ids may be of any type that has
    an order. Null and wordless texts have fingerprint zero and link like others; rows with a null id get the component of
    their fingerprint, null if no row reachable has an id; repeated rows stay; an empty table gives an empty result; columns with the names given here are
    replaced.
    """
    made = ("fingerprint", "component_id")
    keep = [c for c in docs.columns if c.lower() not in made and c != text_col]
    bits, node = free_name(docs, "simhash_bits"), free_name(docs, "simhash_node")
    held = materialise(docs.select(*keep, fingerprint_column(F.col(text_col), shingle).alias(bits)))
    prints = held.groupBy(F.col(bits).alias("bits")).agg(F.min(id_col).alias("id"))
    prints = materialise(prints.withColumn("node", F.monotonically_increasing_id()))
    parts = connected_components(link_fingerprints(prints.select("bits", "node"), max_bits))
    classes = prints.join(parts, "node", "left").select("bits", "id", F.coalesce("component", "node").alias("component"))
    least = classes.groupBy("component").agg(F.min("id").alias(node))
    classes = classes.join(least, "component").select(F.col("bits").alias(bits), node)
    out = held.join(classes, bits)
    return out.select(*keep, F.lpad(F.lower(F.hex(F.col(bits))), 16, "0").alias("fingerprint"), F.col(node).alias("component_id"))
