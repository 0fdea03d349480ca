"""Two tokenizers' tokens of the same text, aligned by their bytes.

Equal texts are met by a shuffle on the whole text, and each distinct text is tokenized and aligned once. Where a token of
A and one of B end at the same byte a group ends; two tokens are linked if their byte ranges overlap. A text is written
with its own measures and its distinct linked id pairs. A pair's count is the number of documents that hold it linked:
every task sums the multiplicities of its texts for each pair before they are shuffled. The counts are then held by tasks
as sorted arrays, in slices of at most ``SLICE_BYTES``, with one pass over the texts' pairs for each; all links of an A id
are in the same slice, so a slice also knows each A id's highest count.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.llm.common import free_name
from chronogrid.shared import materialise

TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How the byte-level tokenizer splits a text before it merges bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of the pair counts that a task holds at once.
SLICE_BYTES = 64 << 20
#: Pairs that a task gathers before it gives their sums on.
GATHERED = 1 << 21
#: Texts whose measures a task holds at once.
AT_ONCE = 512
#: Characters from which a text is read by a library whose depth does not grow with runs of one kind of character.
LONG = 1 << 20


class ByteTokens:
    """A: ids of a text without special tokens, and every id's bytes."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # a byte is written as itself where it prints, else as one of the characters from U+0100, in the bytes' order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.path = path
        self.bytes = [b""] * (max(vocab.values()) + 1)
        ranks = {}
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                self.bytes[i] = bytes(byte_of[c] for c in token)
                if token != "<|endoftext|>":
                    ranks[self.bytes[i]] = i
        self.encoding = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.whole = None

    def ids(self, text: str) -> list[int]:
        if len(text) < LONG:
            return self.encoding.encode_ordinary(text)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = True
        return self.whole.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """B: ids of a text, which the model itself begins with a space, and every id's bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@dataclass
class Aligned:
    """One text: token counts, groups, links, the groups' text, and its distinct pairs with their numbers of links."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: np.ndarray
    times: np.ndarray


NOTHING = Aligned(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))


class Aligner:
    def __init__(self, folder: str) -> None:
        self.a, self.b = ByteTokens(os.path.join(folder, FILE_A)), PieceTokens(os.path.join(folder, FILE_B))
        self.ids_b = len(self.b.bytes)
        self.sizes = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b)]
        self.names = [{end: np.array([f"{i}{end}" for i in range(len(t.bytes))], dtype=object) for end in ends} for t, ends in ((self.a, ",|"), (self.b, ",;"))]

    def align(self, text: str | None) -> Aligned:
        if not text:
            return NOTHING
        try:
            want = b" " + text.encode()
        except UnicodeEncodeError:  # half a surrogate pair is no text in UTF-8
            return NOTHING
        a, b = self.a.ids(" " + text), self.b.ids(text)
        if b"".join([self.a.bytes[i] for i in a]) != want or b"".join([self.b.bytes[i] for i in b]) != want:
            return NOTHING
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        # between two neighbouring ends of either side lie one token of A and one of B: a link
        ends = np.union1d(end_a, end_b)
        linked = a[np.searchsorted(end_a, ends)] * self.ids_b + b[np.searchsorted(end_b, ends)]
        pairs, times = np.unique(linked, return_counts=True)
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        return Aligned(len(a), len(b), len(common), len(ends), self._groups(a, b, end_a, end_b, common), pairs, times.astype(np.int32))

    def _groups(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, common: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: every token's number with what follows it, put in the groups' order."""
        out = np.empty(len(a) + len(b), dtype=object)
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        before_a = np.r_[0, last_b + 1][np.searchsorted(common, end_a)]  # tokens of B in the groups before
        after_b = np.r_[last_a + 1][np.searchsorted(common, end_b)]  # tokens of A in the groups up to this one
        at_a, at_b = np.arange(len(a)) + before_a, np.arange(len(b)) + after_b
        out[at_a], out[at_b] = self.names[0][","][a], self.names[1][","][b]
        out[at_a[last_a]], out[at_b[last_b]] = self.names[0]["|"][a[last_a]], self.names[1][";"][b[last_b]]
        return "".join(out)[:-1]


@lru_cache(maxsize=1)
def aligner(folder: str) -> Aligner:
    """One for a Python worker."""
    return Aligner(folder)


MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _aligning(folder: str):
    """Each text's measures and packed pairs in place of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = aligner(folder)

        def row(text: str | None) -> tuple:
            x = tool.align(text)
            digest = hashlib.sha256(x.groups.encode()).hexdigest() if x.groups else ""
            return x.n_a, x.n_b, x.n_groups, x.n_links, digest, x.pairs.astype("<u4").tobytes(), x.times.astype("<u4").tobytes()

        for pdf in batches:
            for at in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[at : at + AT_ONCE].reset_index(drop=True)
                told = pd.DataFrame([row(t) for t in part.pop("text")], columns=[c.split()[0] for c in MEASURES.split(", ")])
                yield pd.concat([part, told], axis=1)

    return run


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each pair with the documents of this task's texts that hold it; given on after GATHERED pairs."""
    keys, ns, held = [], [], 0

    def given() -> pd.DataFrame:
        pair, at = np.unique(np.concatenate(keys), return_inverse=True)
        return pd.DataFrame({"pair": pair.astype(np.int64), "n": np.bincount(at, weights=np.concatenate(ns)).astype(np.int64)})

    for pdf in batches:
        for packed, copies in zip(pdf["pairs"], pdf["copies"], strict=True):
            part = np.frombuffer(packed, dtype="<u4")
            keys.append(part)
            ns.append(np.full(len(part), copies, dtype=np.float64))
            held += len(part)
            if held >= GATHERED:
                one = given()
                keys, ns, held = [one["pair"].to_numpy().astype(np.uint32)], [one["n"].to_numpy().astype(np.float64)], len(one)
                if 2 * held >= GATHERED:
                    yield one
                    keys, ns, held = [], [], 0
    if keys:
        yield given()


def pair_counts(texts: DataFrame, ids_b: int) -> DataFrame:
    """(pair, a, n, best): of every linked pair (A's id times ids_b, plus B's id) the documents that hold it, and whether no
    pair of the same A id has more. texts: (pairs, copies)."""
    sums = texts.select("pairs", "copies").mapInPandas(_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    held = materialise(sums.withColumn("a", F.expr(f"pair div {ids_b}")))
    top = held.groupBy("a").agg(F.max("n").alias("top"))
    return held.join(top, "a").select("pair", "a", "n", (F.col("n") == F.col("top")).alias("best"))


def _summing(held):
    """A text's links of highest count, and the sum over its links, of the pairs in this slice."""

    @F.pandas_udf("struct<n_best:long,count_sum:long>")
    def column(pairs: pd.Series, times: pd.Series) -> pd.DataFrame:
        pair, n, best = held.value
        out = np.zeros((len(pairs), 2), dtype=np.int64)
        for i, (p, t) in enumerate(zip(pairs, times, strict=True)):
            p, t = np.frombuffer(p, dtype="<u4").astype(np.int64), np.frombuffer(t, dtype="<u4").astype(np.int64)
            if len(p) and len(pair):
                at = np.minimum(np.searchsorted(pair, p), len(pair) - 1)
                there = pair[at] == p
                at, t = at[there], t[there]
                out[i] = t[best[at]].sum(), (t * n[at]).sum()
        return pd.DataFrame(out, columns=["n_best", "count_sum"])

    return column


def _slice_of(a: object, of: int):
    """The slice of an A id; for numbers and columns alike."""
    return a * 40503 % 65536 % of


def _loaded(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = counts.select("pair", "n", "best").toPandas().sort_values("pair")
    return rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """docs' columns without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_a and n_b are the tokens of A and B, n_groups the bytes at which both end one, n_links the linked token pairs, n_best
    those whose id pair no other of the same A id exceeds in documents, count_sum the documents summed over links. Null and empty
    texts, and those that either tokenizer doesn't give back byte by byte, have zeros and ''. Every row counts as a document,
    repeated ones and those with a null id too; an empty table gives an empty result; columns with the names given here
    are replaced. folder has to hold the vocabularies on every executor.
    """
    made = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    keep = [c for c in docs.columns if c.lower() not in made and c != text_col]
    key = free_name(docs, "text_key")
    whole = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = whole.select(F.sha2("text", 256).alias(key), "copies", "text")
    texts = materialise(keyed.mapInPandas(_aligning(folder), f"{key} string, copies long, {MEASURES}"))

    counts = materialise(pair_counts(texts, aligner(folder).ids_b))
    slices = max(1, -(-counts.count() * 17 // slice_bytes))
    context, sums = docs.sparkSession.sparkContext, None
    for number in range(slices):
        held = context.broadcast(_loaded(counts.filter(_slice_of(F.col("a"), slices) == number)))
        one = texts.select(key, _summing(held)(F.col("pairs"), F.col("times")).alias("s")).select(key, "s.*")
        sums = one if number == 0 else sums.unionAll(one)
    if slices > 1:
        sums = sums.groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measured = texts.select(key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, key)
    rows = docs.select(*keep, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias(key))
    return rows.join(measured, key).select(*keep, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
