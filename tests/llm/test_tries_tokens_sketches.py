"""The prefix trie, the token alignment and the odd sketches against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronogrid.llm import queries as llm
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "<|endoftext|> <s> ▁ <0x41>"), (8, "é ß 漢字 \U0001f600 " * 20), (9, "tab\tand  blanks \r\n "), (10, "x" * 5000), (10, "x" * 5000), (11, " lead"), (None, "one")]


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    return list(zip(docs.doc_id, docs.text, strict=True))


# prefix trie


def brute_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for key, cs in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += kids[key] == 0
            saved[key[:d]] += (len(cs) - 1) * len(key[-1][1]) if key else 0
    out = []
    for key, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(key))))
        out.append((min(cs), len(key), min(members[key[:-1]]) if key else None, len(cs), kids[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(spark, turns):
    from chronogrid.llm.prefix_trie import prefix_trie

    df = spark.createDataFrame([(*t, 5) for t in turns], "conv_id long, turn long, role string, text string, node int")
    return sorted((tuple(r) for r in prefix_trie(df).select(*TRIE).collect()), key=repr)


def test_trie_matches_oracle(spark):
    got = llm.queries()["op11_prefix_trie_contraction"](spark, SF).toPandas()
    assert difference(got, connect(SF).execute(llm.oracle_sql()["op11_prefix_trie_contraction"]).fetchdf()) is None


def test_trie_of_long_wide_and_odd_conversations(spark, monkeypatch):
    from chronogrid.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rng = random.Random(3)
    turns = [(0, i, "user" if i % 2 else None, f"turn {i}") for i in range(130)]
    turns += [(c, i, "user" if i % 2 else None, f"turn {i}" if i < c else f"other {i} {c % 7}") for c in (20, 40, 90) for i in range(100)]
    turns += [(c, i, "user", rng.choice("ab")) for c in range(100, 160) for i in range(rng.randrange(1, 7))]
    turns += [(205, None, None, None), (205, 0, "", ""), (206, 1, "user", "tie"), (206, 1, "user", "tie"), (None, 1, "user", "lost"), (-3, 0, "user", "below zero")]
    turns += [(300 + i, 0, "user", "the same") for i in range(80)]
    assert trie(spark, turns) == brute_trie(turns)


def test_trie_of_nothing(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "x")]) == []


# token alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from chronogrid.llm.token_alignment import TOKENIZERS

    a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    told, holders = [], Counter()
    for _, text in rows:
        groups, links = "", []
        if text:
            ia = a.encode(" " + text, add_special_tokens=False).ids
            ib = b.encode(text)
            ba = [bytes(code[c] for c in a.id_to_token(i)) for i in ia]
            bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode() for i in ib]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                at, owner_a, owner_b = 0, [], []
                for k, x in enumerate(ba):
                    owner_a += [k] * len(x)
                for k, x in enumerate(bb):
                    owner_b += [k] * len(x)
                links = [(ia[x], ib[y]) for x, y in sorted(set(zip(owner_a, owner_b, strict=True)))]
                parts, start_a, start_b = [], 0, 0
                for at in range(len(owner_a)):
                    end_a = at + 1 == len(owner_a) or owner_a[at + 1] != owner_a[at]
                    end_b = at + 1 == len(owner_b) or owner_b[at + 1] != owner_b[at]
                    if end_a and end_b:
                        parts.append(",".join(map(str, ia[start_a : owner_a[at] + 1])) + "|" + ",".join(map(str, ib[start_b : owner_b[at] + 1])))
                        start_a, start_b = owner_a[at] + 1, owner_b[at] + 1
                groups = ";".join(parts)
                told.append((len(ia), len(ib), len(parts), links, groups))
        if not groups:
            told.append((0, 0, 0, [], ""))
        holders.update(set(links))
    top = Counter()
    for (x, _), n in holders.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), (na, nb, ng, links, groups) in zip(rows, told, strict=True):
        best = sum(holders[p] == top[p[0]] for p in links)
        out.append((i, na, nb, ng, len(links), best, sum(holders[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("slice_bytes", [1 << 26, 1 << 16])
def test_alignment_matches_brute_force(spark, texts, slice_bytes, monkeypatch):
    from chronogrid.llm import token_alignment

    rows = texts + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", token_alignment.F.lit("clash"))
    got = token_alignment.align_tokenizers(df, slice_bytes=slice_bytes)
    assert sorted((tuple(r) for r in got.select(*ALIGNED).collect()), key=repr) == brute_alignment(rows)


def test_pair_sums_given_in_parts_are_the_same():
    import pandas as pd

    from chronogrid.llm import token_alignment as t

    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"pairs": [np.unique(rng.integers(0, 500, 60)).astype("<u4").tobytes() for _ in range(200)], "copies": rng.integers(1, 4, 200)})
    whole = pd.concat(t._sums(iter([rows]))).groupby("pair").n.sum()
    gathered, t.GATHERED = t.GATHERED, 700
    try:
        parts = pd.concat(t._sums(iter([rows[:90], rows[90:]])))
    finally:
        t.GATHERED = gathered
    assert len(parts) > len(whole) and parts.groupby("pair").n.sum().equals(whole)


def test_alignment_of_very_long_texts_and_no_rows(spark):
    from chronogrid.llm import token_alignment as t

    tool = t.Aligner(t.TOKENIZERS)
    for text in ("a" * 40_000, " " * 40_000, "\n" * 30_000 + "é" * 10_000):
        short = tool.align(text)
        long_, t.LONG = t.LONG, 1000
        try:
            other = tool.align(text)
        finally:
            t.LONG = long_
        assert short.groups == other.groups and short.n_links == other.n_links == short.times.sum()
    assert tool.align("half \ud800 pair") is t.NOTHING
    assert t.align_tokenizers(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# odd sketches


def brute_components(rows, shingle=4):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
        sets.append({tuple(words)} if 0 < len(words) < shingle else {tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)})
    first = list(range(len(rows)))

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = root(x), root(y)
                first[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for x in range(len(rows)):
        if rows[x][0] is not None:
            least[root(x)].append(rows[x][0])
    out = []
    for x in range(len(rows)):
        i = rows[x][0]
        c = min(least[root(x)]) if least[root(x)] and sets[x] else i
        out.append((i, len(sets[x]), c, i is not None and i == c))
    return sorted(out, key=repr)


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        one = list(base)
        for _ in range(rng.randrange(edits + 1)):
            one[rng.randrange(words)] = f"v{rng.randrange(5000)}"
        out.append(" ".join(one))
    return out


def linked(spark, rows, **options):
    from chronogrid.llm.odd_sketch import similar_sets

    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, kept int, print_x int")
    return sorted((tuple(r) for r in similar_sets(df, **options).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_components_match_brute_force(spark, texts):
    rows = texts + [(1000 + (i or 0) if i else None, t) for i, t in ODD]
    assert linked(spark, rows) == brute_components(rows)


@pytest.mark.parametrize("block", [1024, 16])
def test_components_of_large_groups(spark, block, monkeypatch):
    from chronogrid.llm import odd_sketch

    monkeypatch.setattr(odd_sketch.clusters, "__defaults__", (block,))
    rng = random.Random(8)
    parts = near_copies(rng, 120, 120, 8) + near_copies(rng, 60, 60, 2) + near_copies(rng, 40, 40, 12) + ["exact copy of some words here"] * 30
    rows = list(enumerate(parts))
    rng.shuffle(rows)
    assert linked(spark, rows) == brute_components(rows)


def test_components_of_nothing_and_of_text_ids(spark):
    from chronogrid.llm.odd_sketch import similar_sets

    assert linked(spark, []) == []
    named = spark.createDataFrame([("b", "the same few words"), ("a", "The same few WORDS"), ("c", None)], "doc_id string, text string")
    assert sorted(map(tuple, similar_sets(named).collect())) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]
    with pytest.raises(ValueError):
        similar_sets(named, similarity=0.5)


def test_sketches_tell_similarities_apart():
    from chronogrid.llm.odd_sketch import BITS, MAX_BITS, ROWS, BANDS, samples, sketch

    rng = np.random.default_rng(5)
    for similarity, within in ((0.9, True), (0.8, True), (0.55, False), (0.3, False)):
        common = int(2 * 1000 * similarity / (1 + similarity))
        pool = rng.integers(0, 1 << 63, 2000 - common, dtype=np.uint64)
        a, b = pool[:1000], pool[1000 - common :]
        x, y = samples(a), samples(b)
        assert abs((x == y).mean() - similarity) < 0.1
        bits = int(np.bitwise_count((sketch(x) ^ sketch(y)).view(np.uint64)).sum())
        expected = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * BANDS * ROWS * (1 - (x == y).mean())))
        assert abs(bits - expected) < 45 and (bits <= MAX_BITS) == within


def test_fingerprint_components_of_text_ids(spark):
    from chronogrid.llm.simhash import simhash_components

    rows = [("b", "the same few words here"), ("a", "The same few WORDS here"), ("c", "quite another text about something else"), (None, None), ("z", "")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "c"), (None, "z"), ("z", "z")}
