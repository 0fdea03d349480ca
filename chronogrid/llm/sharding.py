"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are dealt into key
ranges, overfull ranges are divided again, and exact running sizes cut the ordered ranges into shards of near equal
bytes. Only DataFrame functions run on the executors; the driver sees the sampled keys and one row per range, both
bounded by ``max_ranges``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from chronogrid.llm.common import free_name, long_array
from chronogrid.shared import materialise

#: Bytes that one record takes besides its text.
RECORD_BYTES = 8


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def _range_of(h: Column, d: Column, splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the key (h, d): a binary search over one constant array."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    hs, ds = long_array([a for a, _ in splitters]), long_array([b for _, b in splitters])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def step(at: Column, jump: Column) -> Column:
        to = at + jump - 1
        here_h, here_d = F.get(hs, to), F.get(ds, to)
        below = (to < n) & ((here_h < h) | ((here_h == h) & (here_d <= d)))
        return F.when(below, at + jump).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _quantiles(drawn: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int]]:
    """parts - 1 keys that cut the weighted sample evenly; fewer where keys repeat."""
    drawn = sorted(drawn)
    total, at, cuts = sum(n for _, _, n in drawn), 0, []
    for h, d, n in drawn:
        if at * parts // max(total, 1) != (at + n) * parts // max(total, 1) and at:
            cuts.append((h, d))
        at += n
    return cuts


def _next_key(h: int, d: int) -> tuple[int, int]:
    """The key after (h, d); the last key has itself."""
    last = (1 << 63) - 1
    if d < last:
        return h, d + 1
    return (h + 1, -(1 << 63)) if h < last else (h, d)


def plan_ranges(keys: DataFrame, n_shards: int, ranges_per_shard: int, range_bytes: int, max_ranges: int):
    """Splitters and, for every range, its bytes and rows. keys: (h, d, size)."""
    total = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    size, rows = total["b"] or 0, total["n"]
    if not rows:
        return [], {}, 0, 0
    ranges = min(max_ranges, max(n_shards * ranges_per_shard, -(-size // range_bytes)))
    mean = size / rows
    # a record counts by its bytes and, half, as one of the rows: ranges are even in both
    weight = F.col("size") + F.lit(mean)
    luck = F.pmod(F.xxhash64("h", "d", F.lit(71)), F.lit(1 << 20)) / float(1 << 20)

    def sample(part: DataFrame, step: float) -> list[tuple[int, int, int]]:
        n = F.floor(weight / F.lit(step) + luck).cast("long")
        return [tuple(r) for r in part.select("h", "d", n.alias("n")).filter("n > 0").collect()]

    splitters = _quantiles(sample(keys, 2 * size / (8 * ranges)), ranges)
    while True:  # what is returned was counted with the splitters returned
        placed = keys.withColumn("r", _range_of(F.col("h"), F.col("d"), splitters))
        key = F.struct("h", "d")
        counts = {
            x["r"]: (x["b"], x["n"], x["one"], (x["top"]["h"], x["top"]["d"]))
            for x in placed.groupBy("r")
            .agg(F.sum("size").alias("b"), F.count("*").alias("n"), (F.min(key) == F.max(key)).alias("one"), F.max(F.struct("size", "h", "d")).alias("top"))
            .collect()
        }
        over = [r for r, (b, n, one, _) in counts.items() if not one and (b > 3 * size / ranges or n > 3 * rows / ranges)]
        if not over or len(splitters) >= 2 * max_ranges:
            break
        # each overfull range is sampled again, more densely, and cut to the planned size
        again = placed.filter(F.array_contains(long_array(sorted(over)), F.col("r").cast("long")))
        share = sum(counts[r][0] + counts[r][1] * mean for r in over)
        drawn = sample(again, share / (16.0 * max(1.0, share * ranges / (2 * size))))
        more = set(_quantiles(drawn, max(2, int(2 * share * ranges / (2 * size)))))
        # and cut on both sides of its largest key: one of the two lies inside, so every round divides every such range
        for r in over:
            more |= {counts[r][3], _next_key(*counts[r][3])}
        splitters = sorted(set(splitters) | more)
    return splitters, {r: (b, n) for r, (b, n, _, _) in counts.items()}, size, rows


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = 16,
    range_bytes: int = 128 << 20,
    max_ranges: int = 16384,
) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard.

    The order is (hash of the text, id): equal texts lie together and only a shard's edge can part them, so a group of
    copies larger than a shard is spread over several. Law ``bytes``: shard s holds the records whose middle lies in the
    s-th part of all bytes, so shards differ by at most one record's size from an equal part. slot counts from 0 in
    each shard. grown_shard belongs to another law and is null.

    Null texts are empty (size 8); null ids sort first, and ids that are no whole numbers by a 64-bit hash; rows that repeat an
    id and a text are interchangeable; an empty table gives an empty result; columns of docs with the names given here are
    replaced. At most ``max_ranges`` ranges and 16 sampled keys for each are held by the driver.
    """
    h, d, size, rng = (free_name(docs, x) for x in ("key_h", "key_d", "key_size", "key_range"))
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keep = [c for c in docs.columns if c.lower() not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lowest = F.lit(-(1 << 63))
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    own = F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    keyed = docs.select(
        *keep,
        F.xxhash64(text).alias(h),
        F.coalesce(own, lowest).alias(d),
        text_size(F.col(text_col)).alias(size),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    keys = materialise(keyed.select(F.col(h).alias("h"), F.col(d).alias("d"), F.col(size).alias("size")))
    splitters, counts, total, _ = plan_ranges(keys, n_shards, ranges_per_shard, range_bytes, max_ranges)
    bytes_before, rows_before, b, n = [], [], 0, 0
    for r in range(len(splitters) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        b, n = b + counts.get(r, (0, 0))[0], n + counts.get(r, (0, 0))[1]

    def placed(df: DataFrame, h: str, d: str, size: str, at: str) -> DataFrame:
        """With the shard and the row's number in the whole order."""
        df = df.withColumn(at, _range_of(F.col(h), F.col(d), splitters))
        w = Window.partitionBy(at).orderBy(h, d).rowsBetween(Window.unboundedPreceding, 0)
        upto = F.sum(size).over(w) + F.get(long_array(bytes_before), F.col(at))
        middle = 2 * upto - F.col(size)
        shard = F.least(F.lit(n_shards - 1), F.floor(middle.cast("double") * n_shards / F.lit(2.0 * max(total, 1)))).cast("int")
        return df.select(
            "*", shard.alias("shard"), (F.row_number().over(w.orderBy(h, d)) - 1 + F.get(long_array(rows_before), F.col(at))).alias("slot")
        )

    first = {x["shard"]: x["s"] for x in placed(keys, "h", "d", "size", "r").groupBy("shard").agg(F.min("slot").alias("s")).collect()}
    starts, low = [], 0
    for s in range(n_shards):
        low = first.get(s, low)
        starts.append(low)
    out = placed(keyed, h, d, size, rng)
    return out.select(
        *keep,
        F.col(size).alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot") - F.get(long_array(starts), F.col("shard"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
