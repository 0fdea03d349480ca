"""Benchmark decontamination: rare gapped n-gram seeds find passages, Smith-Waterman alignment scores them.

Three words in a row of a test item are an n-gram. A document's words meet the n-grams (a map-side join) where the three
stand in a row or with one other word between two of them, and Spark counts the documents that hold each. An item's seeds
are its rarest n-grams: as many of the most frequent ones are left out as a leak can spare. A passage of similarity t or
more loses at most 2 (1 - t) of the item's length in n-grams, since a word that is changed or missing costs 3 points of
2 for each word and breaks 3 n-grams, a word at an end 2 points and 1, and two words put in 2 points and 2; so of the m - 2
n-grams at least (2 t - 1) m - 2 are left, and one fewer may be left out. Items of up to ``SHORT`` words have pairs of words as
n-grams, and all of them are seeds. Documents that lack the words of an item are passed over; in others the passages
around seeds that hold enough of its words are aligned with it word by word, and what aligns well enough is a leak. Test
items are held in blocks of a bounded size; more items mean more passes over the documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from chronogrid.llm.common import free_name
from chronogrid.shared import materialise

#: Items of fewer words leak only as a whole: all their words, in a row.
N = 4
#: Items up to so many words have pairs of words as seeds, longer ones threes.
SHORT = 10
#: Places of a seed's words in a document, by the number of words.
PATTERNS = {1: ((0,),), 2: ((0, 1), (0, 2)), 3: ((0, 1, 2), (0, 1, 3), (0, 2, 3))}
#: Share of an item's own alignment score from which a passage is a leak.
THRESHOLD = 0.6
#: Words of the test items that one block holds in memory.
BLOCK_WORDS = 2_000_000
MATCH, MISS, GAP = 2, -1, -1
#: fixed values: scripts written without spaces (kana, Han, Thai, Lao, Khmer, Myanmar); each character is a word
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
TOKEN = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
LEAK = "array<struct<item_id:{},score:long,similarity:double,start_word:long,end_word:long,seeds:long>>"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


@dataclass
class Items:
    """One block of test items: words as numbers from 1 (0: in no item)."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    #: sorted n-gram hashes, and for each its (item, place) entries
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    #: the numbers of words of the n-grams
    kinds: tuple[int, ...]
    #: of each entry, whether it is a seed of its item; of each n-gram, whether it is one of some item
    seed: np.ndarray
    live: np.ndarray

    def choose_seeds(self, documents: np.ndarray, threshold: float) -> None:
        """Leave out each item's n-grams that the most documents hold, as far as a leak can spare them."""
        seen = np.repeat(documents, np.diff(self.first))
        order = np.lexsort((self.place, -seen, self.item))
        rank = np.arange(len(order)) - np.searchsorted(self.item[order], self.item[order])
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        spared = np.where(sizes > SHORT, np.ceil(np.round((2 * threshold - 1) * sizes - 2, 9)).astype(np.int64) - 1, 0)
        self.seed = np.ones(len(self.item), dtype=bool)
        self.seed[order] = rank >= spared[self.item[order]]
        self.live = np.logical_or.reduceat(self.seed, self.first[:-1]) if len(self.grams) else self.live

    def codes(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        found = tokens(text)
        return np.fromiter((get(w, 0) for w in found), dtype=np.int64, count=len(found))

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers of grams) of all item n-grams in a text."""
        places, numbers = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for pattern in (p for k in self.kinds for p in PATTERNS[k]):
            h, where = gram_hashes(codes, pattern)
            if len(h):
                at = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
                found = self.grams[at] == h
                places.append(where[found])
                numbers.append(at[found])
        return np.concatenate(places), np.concatenate(numbers)


def gram_hashes(codes: np.ndarray, pattern: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the words at the places of ``pattern`` from each word on, where all are in some item."""
    n = len(codes) - pattern[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    inside = codes > 0
    known = inside[:n].copy()
    for i in pattern[1:]:
        known &= inside[i : n + i]
    where = np.flatnonzero(known)
    h = np.full(len(where), len(pattern), dtype=np.uint64)
    for i in pattern:
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[where + i].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h, where


def load_items(rows: list[tuple[int | str, str]]) -> Items:
    vocabulary: dict[str, int] = {}
    ids, words, hashes, item, place = [], [], [], [], []
    kinds: set[int] = set()
    for item_id, text in rows:
        codes = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in tokens(text)], dtype=np.int64)
        if not len(codes):
            continue
        kind = 1 if len(codes) < N else 2 if len(codes) <= SHORT else 3
        kinds.add(kind)
        h, _ = gram_hashes(codes, PATTERNS[kind][0])
        hashes.append(h)
        item.append(np.full(len(h), len(ids)))
        place.append(np.arange(len(h)))
        ids.append(item_id)
        words.append(codes)
    h, it, pl = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, item, place))
    order = np.lexsort((pl, it, h))
    grams, first = np.unique(h[order], return_index=True)
    return Items(ids, words, vocabulary, grams.astype(np.uint64), np.r_[first, len(h)].astype(np.int64), it[order].astype(np.int64), pl[order].astype(np.int64), tuple(sorted(kinds)), np.ones(len(h), dtype=bool), np.ones(len(grams), dtype=bool))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(best local score, first and last + 1 word of the passage in that alignment)."""
    m = len(passage)
    score, start = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    step = np.arange(m + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = score[:-1] + np.where(passage == word, MATCH, MISS)
        up = score[1:] + GAP
        own = np.maximum(diagonal, up)
        origin = np.where(diagonal >= up, start[:-1], start[1:])
        zero = own <= 0
        own = np.r_[0, np.where(zero, 0, own)]
        origin = np.r_[0, np.where(zero, step[1:], origin)]
        # gaps along the passage: the best cell to the left, less one for each word skipped
        reach = own + step
        top = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == top, step, 0))
        score, start = top - step, origin[source]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


def _near(gram: np.ndarray, where: np.ndarray, items: Items, enough: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, sorted places where it would begin) of each item with seeds in a text, of those that enough words are there of. A text
    and an item share memory for one item at a time, however often a seed stands in both."""
    order = np.argsort(gram, kind="stable")
    gram, where = gram[order], where[order]
    grams, start = np.unique(gram, return_index=True)
    end = np.r_[start[1:], len(gram)]
    reps = items.first[grams + 1] - items.first[grams]
    at = np.repeat(items.first[grams], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    own = np.repeat(np.arange(len(grams)), reps)
    kept = items.seed[at] & enough[items.item[at]]
    at, own = at[kept], own[kept]
    order = np.argsort(items.item[at], kind="stable")
    at, own = at[order], own[order]
    item, cut, n = np.unique(items.item[at], return_index=True, return_counts=True)
    for k, lo, hi in zip(item, cut, cut + n, strict=True):
        places = [where[start[g] : end[g]] - items.place[e] for e, g in zip(at[lo:hi], own[lo:hi], strict=True)]
        yield int(k), np.sort(np.concatenate(places))


def leaks_in(text: str | None, items: Items, threshold: float = THRESHOLD, hits: np.ndarray | None = None) -> list[tuple[int, int, float, int, int, int]]:
    """The best leak of each item in a text. hits: places << 32 | numbers of its n-grams, if they are known."""
    if hits is not None:
        hits = hits[items.live[hits & 0xFFFFFFFF]]
        if not len(hits):  # the text need not be read
            return []
    codes = items.codes(text)
    where, gram = items.hits(codes) if hits is None else (hits >> 32, hits & 0xFFFFFFFF)
    if not len(where):
        return []
    there = np.zeros(len(items.vocabulary) + 1, dtype=bool)
    there[codes] = True
    # an item's words that the text has, of those items alone that have a seed in it
    reps = items.first[gram + 1] - items.first[gram]
    grams = np.unique(gram)
    met = np.unique(np.concatenate([items.item[items.first[g] : items.first[g + 1]] for g in grams])) if reps.sum() else np.zeros(0, np.int64)
    enough = np.zeros(len(items.ids), dtype=bool)
    enough[[k for k in met if there[items.words[k]].sum() >= threshold * len(items.words[k])]] = True
    out: dict[int, tuple] = {}
    for k, begin in _near(gram, where, items, enough):
        words = items.words[k]
        if len(words) < N:  # matched whole
            for at in begin:
                if 0 <= at <= len(codes) - len(words) and np.array_equal(codes[at : at + len(words)], words):
                    out[k] = (items.ids[k], MATCH * len(words), 1.0, int(at), int(at) + len(words), len(words))
                    break
            continue
        # so many words may be skipped in all between two seeds of one passage
        slack = max(4, math.ceil(2 * (1 - threshold) * len(words)))
        cuts = np.r_[0, np.flatnonzero(np.diff(begin) > slack) + 1, len(begin)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = max(0, begin[i] - slack), min(len(codes), begin[j - 1] + len(words) + slack)
            passage = codes[lo:hi]
            # each word of an item wins MATCH at most, so a leak holds that share of its words
            if np.isin(words, passage).sum() < threshold * len(words):
                continue
            score, a, b = align(words, passage)
            similarity = score / (MATCH * len(words))
            if similarity >= threshold and (k not in out or score > out[k][1]):
                out[k] = (items.ids[k], score, float(similarity), int(lo + a), int(lo + b), int(j - i))
    return sorted(out.values())


def id_type(benchmark: DataFrame, id_col: str) -> str:
    """Whole-number ids are longs in a leak, others texts."""
    return "long" if isinstance(benchmark.schema[id_col].dataType, IntegralType) else "string"


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[int | str, str]]]:
    """The test items in blocks of a bounded number of words, each read from Spark on its own."""
    sized = benchmark.select(F.col(id_col).cast(id_type(benchmark, id_col)).alias("id"), F.col(text_col).alias("text")).dropna()
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * block_words)))
    for b in range(blocks):
        part = sized.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else sized
        yield [(r["id"], r["text"]) for r in part.orderBy("id").collect()]


def _hitting(held):
    """The n-grams of a text that some item holds: places << 32 | numbers."""

    @F.pandas_udf("array<long>")
    def look(texts: pd.Series) -> pd.Series:
        def own(text: str | None) -> np.ndarray:
            where, gram = held.value.hits(held.value.codes(text))
            return where.astype(np.int64) << 32 | gram

        return pd.Series([own(t) for t in texts], dtype=object)

    return look


def _looking_for(held, threshold: float, leak: str):
    @F.pandas_udf(leak)
    def look(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([leaks_in(t, held.value, threshold, np.asarray(h, dtype=np.int64)) for t, h in zip(texts, hits, strict=True)], dtype=object)

    return look


def with_leaks(docs: DataFrame, benchmark: DataFrame, leaks: str, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the array of each one's leaks; empty for a null text. The n-grams that a document shares with items are written
    with it, so that its words are read once more only where it has some."""
    context, leak = docs.sparkSession.sparkContext, LEAK.format(id_type(benchmark, item_id))
    blocks = [items for items in map(load_items, item_blocks(benchmark, item_id, item_text, block_words)) if items.ids]
    names = [free_name(docs, f"leak_hits_{i}") for i in range(len(blocks))]
    sent = [context.broadcast(items) for items in blocks]
    held = materialise(docs.select("*", *[_hitting(b)(F.col(text_col)).alias(n) for b, n in zip(sent, names, strict=True)])) if blocks else docs
    found = []
    for items, name in zip(blocks, names, strict=True):
        grams = held.select(F.explode(F.array_distinct(F.transform(name, lambda x: x.bitwiseAND(0xFFFFFFFF)))).alias("gram"))
        counts = grams.groupBy("gram").agg(F.count("*").alias("n")).toPandas()
        documents = np.zeros(len(items.grams), dtype=np.int64)
        documents[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
        items.choose_seeds(documents, threshold)
        chosen = context.broadcast(items)
        found.append(_looking_for(chosen, threshold, leak)(F.when(F.size(name) > 0, F.col(text_col)), F.col(name)))
    leaks_of = F.flatten(F.array(*found)) if found else F.array().cast(leak)
    return held.select(*docs.columns, leaks_of.alias(leaks))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, item_id, score, similarity, start_word, end_word, seeds): a row for each document and item it leaks, with the
    best passage (of equal ones the first). Null texts and items without a word have no leak; items of fewer than N words leak
    only whole. A repeated row gives repeated leaks; long texts are searched whole; an empty table or benchmark gives an empty
    result; item ids are whole numbers or else given as texts; an id column that is named like a column of the result is an error."""
    out = with_leaks(docs.select(id_col, text_col), benchmark, "_leaks", text_col, **options)
    return out.select(id_col, F.explode("_leaks").alias("_leak")).select(id_col, "_leak.*")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that leak a test item; the rest unchanged."""
    leaks = free_name(docs, "leaks")
    return with_leaks(docs, benchmark, leaks, text_col, **options).filter(F.size(leaks) == 0).select(*docs.columns)
