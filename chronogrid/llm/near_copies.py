"""Near copies by Jaccard similarity of word shingles, found by wide SimHash fingerprints.

A word is what stands between white space; of scripts written without spaces each character is one. Texts with the same set
of shingles are one node, by 128 bits of the set. A node has a fingerprint of ``BITS`` bits over its shingles: similarity
0.8 differs in 15 % of the bits on average (39, deviation 5.7), unrelated texts in half. Candidates meet where they agree on one
of several samples of the bits, and are linked if they differ in at most ``MAX_BITS``. The samples hold more bits the more
nodes there are, so that a bucket has four unrelated nodes on average at every size, and there are as many as ``RECALL`` asks
for; two unrelated nodes differ in so few bits with probability 3e-12, and meet then in fewer than one case of ten: at 10^9
nodes that is 0.0002 chance links a node. So what hangs together by these links does so by texts that are alike, and only
there the shingle sets themselves are compared: similarity >= 0.8 links two texts. A bucket of over ``BLOCK`` nodes is dealt
in blocks, two at a time.

In every bucket the fingerprints have a table of their Hamming distances to pivots, which are fingerprints of that bucket: fixed
ones would be 128 bits from everything, and tell nothing apart at this radius. By the triangle inequality a pair whose
tables differ by more than ``MAX_BITS`` in any coordinate is discarded, and only the rest is compared bit by bit.

A component with up to ``SLICE`` distinct shingles is compared by one task. A larger one is dealt in slices: its texts are
compared with ``REFERENCES`` of them and then with as many of its most central texts, which gives each text a table of its
distances to these pivots and links what is near one. Only texts outside the largest group so made are then compared with
the texts of other groups, in blocks, and by the triangle inequality a pair whose tables differ by more than the allowed
distance in any coordinate is discarded before that.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronogrid.llm.common import connected_components, free_name
from chronogrid.llm.decontaminate import UNSPACED
from chronogrid.shared import materialise

SHINGLE = 5
SIMILARITY = 0.8
BITS, MAX_BITS = 256, 72
#: Share of the bits in which texts of similarity 0.8 agree, and of such pairs that are to meet in some bucket.
AGREE, RECALL = 0.8485, 0.995
#: Nodes of a bucket that one task holds of each side.
BLOCK = 2048
#: Divided buckets whose list is sent to all tasks; a longer list is joined.
BROADCAST_ROWS = 1 << 17
#: Shingles of a component that one task compares; larger components are dealt in slices of about so many.
SLICE = 1 << 16
#: Texts of a large component that all its texts are compared with: so many by their hash, so many by their place.
REFERENCES = 16
#: Rows of a bucket up to which all its pairs are compared, and given, at once.
SMALL = 32
#: A small bucket's nodes for each of its pivots, and the pivots that a larger bucket's table has at once.
EACH, PIVOTS = 8, 16
ONE_CHARACTER = re.compile(f"([{UNSPACED}])")
WORDS = ("a", "b", "c", "d")


def shingle_set(text: str | None, shingle: int = SHINGLE) -> set[bytes]:
    """The distinct runs of ``shingle`` lower-cased words; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))


def script_shingles(text: str | None, shingle: int = SHINGLE) -> set[bytes]:
    """shingle_set() where each character of a script written without spaces is a word."""
    if text and ONE_CHARACTER.search(text):
        text = ONE_CHARACTER.sub(r" \1 ", text)
    return shingle_set(text, shingle)


def wide_fingerprint(parts: set[bytes]) -> np.ndarray:
    """Words of a fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    ones, n, held = np.zeros(BITS, dtype=np.int64), len(parts), []
    digest = xxhash.xxh3_128_digest

    def count() -> None:
        h = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(-1, BITS // 8)
        np.add(ones, np.unpackbits(h, axis=1).sum(axis=0, dtype=np.uint16), out=ones)
        held.clear()

    for s in parts:
        held += (digest(s, 0), digest(s, 1))
        if len(held) == 1 << 15:
            count()
    if held:
        count()
    return np.packbits(2 * ones > n).view("<i8")


def _prints(text, shingle: int):
    """The set's 128 bits (high, low) and its fingerprint (a, b, c, d)."""
    names = ("high", "low", *WORDS)

    @F.pandas_udf(f"struct<{','.join(f'{n}:long' for n in names)}>")
    def column(texts: pd.Series) -> pd.DataFrame:
        def row(text: str | None) -> tuple:
            parts = script_shingles(text, shingle)
            set_hash = np.frombuffer(xxhash.xxh3_128_digest(_hashes(parts).tobytes()), dtype=">i8")
            return (*map(int, set_hash), *map(int, wide_fingerprint(parts)))

        return pd.DataFrame([row(t) for t in texts], columns=names, dtype=np.int64)

    return column(text)


def _hashes(parts: set[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(x) for x in parts], dtype=np.uint64)).view(np.int64)


def samples_for(nodes: int, recall: float = RECALL) -> np.ndarray:
    """The sampled bits of each table, for so many nodes."""
    sampled = min(44, max(14, math.ceil(math.log2(max(nodes, 1))) - 2))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - AGREE**sampled))
    rng = np.random.default_rng(20250)
    return np.stack([rng.choice(BITS, sampled, replace=False) for _ in range(tables)])


def _buckets(samples: np.ndarray, whole: bool) -> Callable:
    """A row for each table: bucket holds the table and the sampled bits. Without ``whole`` nothing else is given."""
    tables, sampled = samples.shape
    power = 1 << np.arange(sampled, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                words = np.ascontiguousarray(part[list(WORDS)].to_numpy(dtype="<i8"))
                bits = np.unpackbits(words.view(np.uint8).reshape(len(part), -1), axis=1)
                bucket = np.stack([bits[:, s].astype(np.int64) @ power + (t << sampled) for t, s in enumerate(samples)], axis=1)
                rest = ("node", *WORDS) if whole else ()
                yield pd.DataFrame({"bucket": bucket.ravel(), **{c: np.repeat(part[c].to_numpy(), tables) for c in rest}})

    return run


def _stars(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links x - y among n places those from each place to the first one that it hangs together with."""
    first = np.arange(n)
    while True:
        low = np.minimum(first[x], first[y])
        new = first.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, first):
            break
        first = new
    at = np.flatnonzero(first != np.arange(n))
    return at, first[at]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def _small_pairs(bits: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within MAX_BITS that connect all of every bucket of up to SMALL nodes.

    A bucket's pivots are nodes of its own, the first that no pivot before is near to, one for every EACH nodes. A pair whose
    distances to a pivot differ by more than MAX_BITS is discarded, and one that a pivot is near to on both sides hangs together by
    that; only the rest is compared."""
    home, end = np.repeat(start, size), np.repeat(start + size, size)
    room = np.repeat(np.where(size <= SMALL, size, 0), size)
    free, pivot = room > 1, np.zeros(len(bits), dtype=bool)
    table, pairs = [], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(SMALL // EACH):
        at = np.flatnonzero(free & (room > EACH * k))
        if not len(at):
            break
        own = at[np.r_[True, home[at[1:]] != home[at[:-1]]]]
        of = np.full(len(bits), -1)
        of[home[own]] = own
        of = of[home]
        rows, far = np.flatnonzero(of >= 0), np.full(len(bits), BITS, dtype=np.int16)
        far[rows] = _apart(bits[rows], bits[of[rows]])
        near = rows[(far[rows] <= MAX_BITS) & (rows != of[rows])]
        pairs.append((of[near], near))
        pivot[own], free[own], free[near] = True, False, False
        table.append(far)
    left = np.where((room > 0) & ~pivot, end - np.arange(len(bits)), 0)
    for step in range(1, SMALL):
        i = np.flatnonzero(left > step)
        if not len(i):
            break
        i = i[~pivot[i + step]]
        for far in table:
            a, b = far[i], far[i + step]
            i = i[(np.abs(a - b) <= MAX_BITS) & ((a > MAX_BITS) | (b > MAX_BITS))]
        near = i[_apart(bits[i], bits[i + step]) <= MAX_BITS]
        pairs.append((near, near + step))
    return tuple(np.concatenate(p) for p in zip(*pairs, strict=True))


def _forest(bits: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    """Edges that connect all of a bucket within MAX_BITS, each to the first of its group.

    The first of every group is a pivot: a table holds the open nodes' distances to the last PIVOTS of them, and what differs by more
    than MAX_BITS there from a node of the group is not compared with it."""
    out, open_, table, k = [], np.arange(len(bits)), np.full((len(bits), PIVOTS), BITS, dtype=np.int16), 0
    while len(open_) > 1:
        root, open_ = open_[0], open_[1:]
        table[open_, k % PIVOTS] = far = _apart(bits[open_], bits[root])
        k += 1
        new, open_ = open_[far <= MAX_BITS], open_[far > MAX_BITS]
        group, frontier = [new], list(new)
        while frontier and len(open_):
            f = frontier.pop()
            may = np.flatnonzero((np.abs(table[open_] - table[f]) <= MAX_BITS).all(axis=1))
            at = may[_apart(bits[open_[may]], bits[f]) <= MAX_BITS]
            if len(at):
                group.append(open_[at])
                frontier.extend(open_[at])
                open_ = np.delete(open_, at)
        members = np.concatenate(group)
        if len(members):
            out.append(np.stack([nodes[members], np.full(len(members), nodes[root])], axis=1))
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges within every deal (bucket and two of its blocks), one for each node at most, to the least node of its group there;
    rows come sorted by deal and node. Groups that meet in many buckets so have the same edges again and again, which are one."""
    keys = ["bucket", "i", "j"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key, nodes = pdf[keys].to_numpy(), pdf["node"].to_numpy()
        bits = pdf[list(WORDS)].to_numpy(np.int64).view(np.uint64)
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(key)])
        edges = [np.zeros((0, 2), np.int64)]
        x, y = _stars(*_small_pairs(bits, start, size), len(key))
        edges.append(np.stack([nodes[x], nodes[y]], axis=1))
        for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
            edges.extend(_forest(bits[s : s + n], nodes[s : s + n]))
        return pd.DataFrame(np.concatenate(edges), columns=["x", "y"])

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
        if not last.all() or (held and (held[-1][keys].iloc[-1] != pdf[keys].iloc[-1]).any()):
            yield solve(pd.concat([*held, pdf[~last]], ignore_index=True))
            held = []
        held.append(pdf[last])
    if held:
        yield solve(pd.concat(held, ignore_index=True))


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by x: the edges of one x become one to its least y, and one from each other y to that. What hangs
    together still does, and the many edges of a group that meets in all tables become one for each text."""
    for pdf in batches:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        new = np.r_[True, x[1:] != x[:-1]] if len(x) else np.zeros(0, dtype=bool)
        least = y[new][np.cumsum(new) - 1]
        edges = np.r_[np.stack([x, least], axis=1), np.stack([y, least], axis=1)]
        edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
        yield pd.DataFrame(edges, columns=["x", "y"])


def _shingles(text, shingle: int):
    """The sorted 64-bit hashes of a text's distinct shingles."""

    @F.pandas_udf("array<long>")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series([_hashes(script_shingles(t, shingle)) for t in texts])

    return column(text)


class _Similar:
    """Jaccard similarities of one set to all of a slice, by an index from hashes to their sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        flat, owner = np.concatenate([np.zeros(0, np.int64), *sets]), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def to(self, one: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.flat, one, "left"), np.searchsorted(self.flat, one, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.size))
        return common / np.maximum(len(one) + self.size - common, 1)


def _exact(similarity: float):
    """(node, least node of its group) of one component: groups are linked by Jaccard similarity of shingle sets."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        nodes, sets = pdf["node"].to_numpy(), list(pdf["set"])
        index, group, free = _Similar(sets), np.full(len(sets), -1), np.ones(len(sets), dtype=bool)
        for root in range(len(sets)):
            if not free[root]:
                continue
            free[root], group[root], frontier = False, root, [root]
            while frontier and free.any():
                new = np.flatnonzero(free & (index.to(sets[frontier.pop()]) >= similarity))
                free[new], group[new] = False, root
                frontier.extend(new)
        return pd.DataFrame({"node": nodes, "group": nodes[group]})

    return solve


def _to_references(refs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Each member of a slice with its similarities to the component's references, by their order."""
    if members.empty:
        return pd.DataFrame({"node": [], "refs": [], "near": []}, dtype=object)
    refs, index = refs.sort_values("node"), _Similar(list(members["set"]))
    near = np.stack([index.to(s) for s in refs["set"]], axis=1)
    return pd.DataFrame({"node": members["node"], "refs": [refs["node"].to_numpy()] * len(members), "near": list(near)})


def _between_groups(similarity: float):
    """Links of a block's texts with a slice's texts of other groups, as pairs of groups."""

    def solve(block: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), np.int64)]
        if len(block) and len(members):
            index, table, group = _Similar(list(members["set"])), np.stack(members["near"]), members["group"].to_numpy()
            for own, near, one in zip(block["group"], block["near"], block["set"], strict=True):
                may = (group != own) & (np.abs(table - near).max(axis=1) <= 1 - similarity + 1e-9)
                if may.any():
                    other = np.unique(group[may & (index.to(one) >= similarity)])
                    found.append(np.stack([np.full(len(other), own), other], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    return solve


def keep_one_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for every group of texts linked by Jaccard similarity >= 0.8 of 5-word shingles.

    The row kept is the first by (id, null last; hash of the row), so it is the same in every run, whatever other rows share
    its id. Texts without words, null ones too, are one text; so are texts with the same shingles. Rows and sets are told apart by
    128 bits.
    """
    rows = [free_name(docs, n) for n in ("copy_row", "copy_row_too")]
    told = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    keyed = docs.select("*", *[F.xxhash64(F.lit(i), *told).alias(r) for i, r in enumerate(rows)])
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *[F.col(r).alias(f"row{i}") for i, r in enumerate(rows)])
    held = materialise(keyed.select(rank.alias("rank"), _prints(F.col(text_col), SHINGLE).alias("seen")).select("rank", "seen.*"))
    sets = held.groupBy("high", "low").agg(F.min("rank").alias("rank"), *[F.min(w).alias(w) for w in WORDS])
    best = materialise(sets.select(F.monotonically_increasing_id().alias("node"), "rank", *WORDS))

    def rows_of(ranks: DataFrame) -> DataFrame:
        """The rows of docs with these ranks, one each."""
        wanted = ranks.select(*[F.col(f"rank.row{i}").alias(r) for i, r in enumerate(rows)])
        return keyed.join(wanted, rows, "left_semi").dropDuplicates(rows)

    def texts_of(ranks: DataFrame) -> DataFrame:
        wanted = ranks.select("node", *[F.col(f"rank.row{i}").alias(r) for i, r in enumerate(rows)])
        node = free_name(docs, "copy_node")
        return rows_of(ranks).join(wanted.withColumnRenamed("node", node), rows).select(F.col(node).alias("node"), F.col(text_col).alias("text"))

    groups = materialise(_groups(best, texts_of))
    first = best.join(groups, "node", "left").groupBy(F.coalesce("group", "node").alias("group")).agg(F.min("rank").alias("rank"))
    return rows_of(first).select(*docs.columns)


def _groups(best: DataFrame, texts_of: Callable, block: int = BLOCK) -> DataFrame:
    """(node, group) of the texts that are near copies of one with a smaller node. best: (node, rank, a, b, c, d)."""
    n = int(best.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    samples = samples_for(best.count())
    prints = best.select("node", *WORDS)
    words = ", ".join(f"{w} long" for w in WORDS)
    rows = prints.mapInPandas(_buckets(samples, True), f"bucket long, node long, {words}")
    counts = prints.mapInPandas(_buckets(samples, False), "bucket long").groupBy("bucket").agg(F.count("*").alias("n"))
    hot = materialise(counts.filter(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).alias("deals")))
    number = hot.count()
    zero = F.lit(0).cast("long")
    if number:
        rows = rows.join(F.broadcast(hot) if number <= BROADCAST_ROWS else hot, "bucket", "left")
        rows = rows.withColumn("own", F.when(F.col("deals").isNull(), zero).otherwise(F.pmod(F.xxhash64("node"), F.col("deals"))))
        rows = rows.withColumn("with", F.explode(F.sequence(zero, F.coalesce(F.col("deals") - 1, zero))))
        rows = rows.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", *WORDS)
    else:
        rows = rows.select("bucket", zero.alias("i"), zero.alias("j"), "node", *WORDS)
    keys = ["bucket", "i", "j"]
    edges = rows.repartition(n, *keys).sortWithinPartitions(*keys, "node").mapInPandas(_links, "x long, y long")
    edges = edges.repartition(n, "x").sortWithinPartitions("x", "y").mapInPandas(_contracted, "x long, y long")
    parts = materialise(connected_components(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    texts = texts_of(best.join(parts, "node", "left_semi")).select("node", _shingles(F.col("text"), SHINGLE).alias("set"))
    held = materialise(texts.join(parts, "node").select("component", "node", "set"))
    return _exact_groups(held)


def _exact_groups(held: DataFrame, slice_: int = SLICE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, group) where the least node of a text's group is another one. held: (component, node, set of hashes)."""
    total = held.groupBy("component").agg(F.sum(F.size("set").cast("long")).alias("total"))
    large = materialise(total.filter(F.col("total") > slice_).select("component", F.ceil(F.col("total") / slice_).alias("slices")))
    small = held.join(large, "component", "left_anti")
    out = small.groupBy("component").applyInPandas(_exact(similarity), "node long, group long").filter("node <> group")
    return out if large.isEmpty() else out.unionAll(_large_groups(held.join(large, "component"), slice_, similarity))


def _large_groups(held: DataFrame, slice_: int, similarity: float) -> DataFrame:
    """_exact_groups of components in several slices. held: (component, node, set, slices)."""
    held = materialise(held.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices"))))
    in_slices = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")

    def first(rows: DataFrame, *order) -> DataFrame:
        """REFERENCES rows of each component: the rest is left before rows are dealt by component."""
        by = Window.partitionBy("component").orderBy(*order, "node")
        return rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= REFERENCES).select("component", "node")

    def near(refs: DataFrame) -> DataFrame:
        dealt = held.join(refs, ["component", "node"], "left_semi").select("component", "node", "set", in_slices)
        dealt = dealt.toDF(*dealt.columns)  # columns of its own beside those of held
        pairs = dealt.groupBy("component", "slice").cogroup(held.select("component", "node", "set", "slice").groupBy("component", "slice"))
        return materialise(pairs.applyInPandas(_to_references, "node long, refs array<long>, near array<double>"))

    some = near(first(held.select("component", "node"), F.xxhash64("node")))
    centre = F.aggregate("near", F.lit(0.0), lambda x, y: x + y)
    central = near(first(held.select("component", "node").join(some.select("node", centre.alias("centre")), "node"), F.desc("centre")))
    edges = [t.select("node", F.explode(F.arrays_zip("refs", "near")).alias("r")).filter(F.col("r.near") >= similarity) for t in (some, central)]
    hung = connected_components(edges[0].unionAll(edges[1]).select(F.col("node").alias("a"), F.col("r.refs").alias("b")))

    tables = some.select("node", "near").join(central.select("node", F.col("near").alias("more")), "node")
    tables = tables.join(hung.withColumnRenamed("component", "group"), "node", "left")
    tables = tables.select("node", F.coalesce("group", "node").alias("group"), F.concat("near", "more").alias("near"))
    members = materialise(held.join(tables, "node"))
    counts = members.groupBy("component", "group").agg(F.count("*").alias("n"), F.sum(F.size("set").cast("long")).alias("total"))
    blocks = counts.groupBy("component").agg(
        F.max_by("group", F.struct("n", "group")).alias("most"),
        F.ceil((F.sum("total") - F.max_by("total", F.struct("n", "group"))) / slice_).alias("blocks"),
    )
    blocks = materialise(blocks.filter("blocks > 0"))
    columns = ["component", "set", "group", "near"]
    asking = members.join(blocks, "component").filter("group <> most").select(*columns, F.pmod(F.xxhash64("node"), "blocks").alias("block"), in_slices)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    asked = members.join(blocks, "component").select(*columns, each, "slice")
    asked = asked.toDF(*asked.columns)
    keys = ["component", "slice", "block"]
    links = asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_between_groups(similarity), "a long, b long")
    merged = connected_components(links).withColumnRenamed("node", "group").withColumnRenamed("component", "least")
    out = members.select("node", "group").join(merged, "group", "left").select("node", F.coalesce("least", "group").alias("group"))
    return out.filter("node <> group")
