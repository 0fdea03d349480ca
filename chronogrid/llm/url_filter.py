"""URL filtering by a cascade of Bloom filters.

Level 0 encodes the listed keys, level 1 the keys of the corpus that level 0 wrongly lets through, level 2 the listed keys
that level 1 wrongly catches, and so on until nothing is wrong. The cascade is built against every key that the corpus can
ask for, so its answers are exact and no page is joined to a list. Level 0's rate makes the second level about as large as
the list, so all levels together take some 1.44 * (log2(other keys / listed keys) + 4) bits for a listed key; that size is
checked before anything is broadcast, and beyond it the list is looked up by a join of distinct keys instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm.common import free_name
from chronogrid.shared import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All levels together; above it keys are joined.
MAX_BYTES = 64 << 20
HASHES = "h1 long, h2 long"


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def places(self, h1: np.ndarray, h2: np.ndarray, number: int) -> Iterator[np.ndarray]:
        a, b = _mix(h1 + np.uint64(number)), _mix(h2 + np.uint64(number)) | np.uint64(1)
        for i in range(self.hashes):
            yield (a + np.uint64(i) * b) % np.uint64(self.bits)

    def test(self, h1: np.ndarray, h2: np.ndarray, number: int) -> np.ndarray:
        held = np.ones(len(h1), dtype=bool)
        for at in self.places(h1, h2, number):
            held &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return held


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether the keys with these hashes are listed: the first level that says no decides by its parity."""
    out = np.zeros(len(h1), dtype=bool)
    open_ = np.arange(len(h1))
    for number, level in enumerate(levels):
        passed = level.test(h1[open_], h2[open_], number)
        out[open_[~passed]] = number % 2 == 1
        open_ = open_[passed]
    out[open_] = len(levels) % 2 == 1
    return out


def _u(column: pd.Series) -> np.ndarray:
    return column.to_numpy(dtype=np.int64).astype(np.uint64)


def _fill(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """One level over keys (h1, h2): every task ORs its keys into words, words are merged, and come to the driver."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, 64 * math.ceil(count * 1.4427 * -math.log2(rate) / 64))
    level = Level(bits, hashes, np.zeros(0, dtype=np.uint64))

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.concatenate([*level.places(_u(pdf["h1"]), _u(pdf["h2"]), number)])
            word, where = np.unique(at >> np.uint64(6), return_inverse=True)
            got = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(got, where, np.uint64(1) << (at & np.uint64(63)))
            yield pd.DataFrame({"w": word.astype(np.int64), "b": got.astype(np.int64)})

    words = np.zeros(bits // 64, dtype=np.uint64)
    for row in keys.mapInPandas(set_bits, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        words[row["w"]] = np.int64(row["b"]).astype(np.uint64)
    return Level(bits, hashes, words)


def _passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[held.value.test(_u(pdf["h1"]), _u(pdf["h2"]), number)]

    return keys.mapInPandas(keep, HASHES)


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def build_cascade(keys: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES, max_levels: int = 64) -> list[Level] | None:
    """Levels that answer exactly for every key of universe; None if they would take more than max_bytes.

    keys, universe: (h1, h2), distinct. Each level is a Spark job over the keys that the level before got wrong.
    """
    inside = materialise(keys)
    outside = materialise(universe.join(inside, ["h1", "h2"], "left_anti"))
    n, m = inside.count(), outside.count()
    if not n:
        return []
    rate = min(0.5, 0.7071 * n / max(m, 1))
    if n * 1.4427 * (-math.log2(rate) + 4) / 8 > max_bytes:
        return None
    levels: list[Level] = []
    right, wrong = (inside, n), (outside, m)
    while right[1]:
        if len(levels) >= max_levels:
            raise RuntimeError("two keys share 128 bits of hash")
        number = len(levels)
        levels.append(_fill(right[0], right[1], rate, number))
        passed = materialise(_passing(wrong[0], levels[-1], number))
        right, wrong, rate = (passed, passed.count()), right, 0.5
    return levels


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, form, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule that could fit: host suffixes at dots, each with the path's starts of the rules' lengths; longest first."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: F.char_length(path) >= n)
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))
    ordered = F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.char_length(k)).alias("n"), k.alias("k")))), lambda s: s["k"])
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(ordered))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. rules: (host, path, verdict allow or block).

    A rule fits its host and its subdomains if the path starts with the rule's path; the longest rule (host and path)
    wins, block before allow. Where none fits, rule is null and the verdict is ``default``: the key is in no list. Null
    urls and urls without ``://`` have an empty host and path and fit no rule. Rules without a host or with another verdict
    are left out. An empty rule table judges all by ``default``; an empty page table gives an empty result; columns with the names given here are replaced.
    """
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    rules = rules.select(F.concat(F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))).alias("key"), F.char_length(F.coalesce("path", F.lit(""))).alias("n"), "verdict").filter("key is not null and verdict in ('allow', 'block')")
    lengths = sorted(r["n"] for r in rules.select("n").distinct().limit(4097).collect())
    if len(lengths) > 4096:
        raise ValueError("rule paths of more than 4096 lengths")
    host, path = url_parts(F.col(url_col))
    judged = pages.select(*keep, host.alias("host"), path.alias("path"))
    keyed = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = materialise(judged.select(F.explode(keyed).alias("k")).select(*hashed(F.col("k"))).distinct())
    lists = {}
    for verdict in ("block", "allow"):
        own = rules.filter(F.col("verdict") == verdict).select(*hashed(F.col("key"))).distinct()
        lists[verdict] = build_cascade(own, universe)
    if any(levels is None for levels in lists.values()):
        return _judge_by_join(judged, keyed, rules, keep, default)
    held = spark.sparkContext.broadcast((lists["block"], lists["allow"]))

    @F.pandas_udf("int")
    def first_listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """2 * place of the longest listed key, + 1 if it allows; -1 if none is listed."""
        n = np.array([len(x) for x in h1], dtype=np.int64)
        if not n.sum():
            return pd.Series(np.full(len(n), -1, dtype=np.int32))
        a, b = (np.concatenate([np.asarray(x, dtype=np.int64) for x in h]).astype(np.uint64) for h in (h1, h2))
        block, allow = (listed(levels, a, b) for levels in held.value)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        out = np.full(len(n), np.iinfo(np.int32).max, dtype=np.int64)
        hit = block | allow
        np.minimum.at(out, row[hit], 2 * place[hit] + ~block[hit])
        return pd.Series(np.where(out == np.iinfo(np.int32).max, -1, out).astype(np.int32))

    own, place = free_name(judged, "_k"), free_name(judged, "_at")
    keys = judged.withColumn(own, keyed)
    found = keys.withColumn(place, first_listed(F.transform(own, lambda k: F.xxhash64(k)), F.transform(own, lambda k: F.xxhash64(k, F.lit(1)))))
    at = F.col(place)
    return found.select(
        *keep,
        "host",
        "path",
        F.when(at >= 0, F.get(own, F.shiftright(at, 1))).alias("rule"),
        F.when(at < 0, default).when(at % 2 == 1, "allow").otherwise("block").alias("verdict"),
    )


def _judge_by_join(judged: DataFrame, keyed: Column, rules: DataFrame, keep: list[str], default: str) -> DataFrame:
    """The way for lists beyond the broadcast bound: distinct (host, path) pairs meet the rules, then the pages."""
    best_col = free_name(judged, "best")
    best = (
        judged.select("host", "path").distinct().select("host", "path", F.explode(keyed).alias("key"))
        .join(rules, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.char_length("key").alias("n"), (F.col("verdict") == "block").alias("b"), "key", "verdict")).alias(best_col))
    )
    return judged.join(best, ["host", "path"], "left").select(
        *keep, "host", "path", F.col(f"{best_col}.key").alias("rule"), F.coalesce(f"{best_col}.verdict", F.lit(default)).alias("verdict")
    )
