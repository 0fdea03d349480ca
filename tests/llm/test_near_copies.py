"""The dedup stage on planted near copies."""

from __future__ import annotations

import random

import corpus_pipeline
from chronogrid.llm.near_copies import _exact_groups

COLUMNS = "doc_id long, text string, lang string, source string"


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], COLUMNS)
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect())


def planted(rng, words, changes, number):
    out = []
    while len(out) < number:
        a = [f"w{rng.randrange(20_000)}" for _ in range(words)]
        b = list(a)
        for k in rng.sample(range(words), changes):
            b[k] = "other"
        out.append((a, b))
    return out


def test_near_copies_at_four_fifths_go(spark):
    rng = random.Random(8)
    pairs = [p for n, c in ((60, 1), (100, 1), (400, 4), (1000, 20)) for p in planted(rng, n, c, 120)]
    alike = [jaccard(a, b) >= 0.8 for a, b in pairs]
    rows = [(10 * i + k, " ".join(t)) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    ids = {i for _, i, _ in kept(spark, rows)}
    assert all(10 * i in ids for i in range(len(pairs)))
    left = sum(10 * i + 1 in ids for i, x in enumerate(alike) if x)
    assert sum(alike) > 300 and left <= 0.02 * sum(alike), (left, sum(alike))
    # below the similarity both stay
    assert all(10 * i + 1 in ids for i, x in enumerate(alike) if not x)


def test_texts_below_the_similarity_stay(spark):
    rng = random.Random(9)
    pairs = planted(rng, 200, 7, 40)
    assert all(0.6 < jaccard(a, b) < 0.8 for a, b in pairs)
    assert len(kept(spark, [(10 * i + k, " ".join(t)) for i, p in enumerate(pairs) for k, t in enumerate(p)])) == 80


def test_null_and_clashing_ids_lose_no_text(spark):
    rng = random.Random(10)
    a, b, c, d = (" ".join(f"w{rng.randrange(20_000)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (7, b), (7, c), (None, d), (3, d), (3, d), (None, d + " and one more")]
    want = sorted([(True, 0, a), (False, 7, b), (False, 7, c), (False, 3, d)])
    assert kept(spark, rows) == kept(spark, rows[::-1]) == want
    assert kept(spark, [(1, None), (2, ""), (None, " ")]) == [(False, 1, None)]
    assert kept(spark, []) == []


def test_large_groups_of_edited_copies_are_one(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(20_000)}" for _ in range(300)]
    rows = [(i, " ".join([*base[: i % 290], f"edit{i}", *base[i % 290 + 1 :]])) for i in range(400)]
    assert [i for _, i, _ in kept(spark, rows)] == [0]


def test_large_components_are_compared_in_slices_like_all_pairs(spark):
    rng = random.Random(12)
    rows, sets = [], {}
    for component in range(3):
        heads = [rng.sample(range(10**12), 60) for _ in range(3)]
        heads[1][:46], heads[2][:46] = heads[0][:46], heads[1][:46]
        for i in range(60):
            own = list(heads[rng.randrange(3)])
            for k in rng.sample(range(60), rng.randrange(12)):
                own[k] = rng.randrange(10**12)
            sets[1000 * component + i] = set(own)
            rows.append((component, 1000 * component + i, sorted(own)))
    want = {n: n for n in sets}

    def root(n):
        while want[n] != n:
            n = want[n]
        return n

    for x in sets:
        for y in sets:
            if x < y and x // 1000 == y // 1000 and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                want[b] = a
    want = {n: root(n) for n in sets if root(n) != n}
    held = spark.createDataFrame(rows, "component long, node long, set array<long>")
    assert 30 < len(want) < len(sets) - 6
    for slice_ in (100, 700, 10**6):
        got = {r["node"]: r["group"] for r in _exact_groups(held, slice_).collect()}
        assert got == want, slice_


def test_scripts_without_spaces(spark):
    rng = random.Random(13)
    han = [chr(0x4E00 + k) for k in range(2000)]
    a = "".join(rng.choice(han) for _ in range(800))
    b = a[:400] + "\u3042" + a[401:]
    c = "".join(rng.choice(han) for _ in range(800))
    assert [i for _, i, _ in kept(spark, [(1, a), (2, b), (3, c), (4, c + "\u3042")])] == [1, 3]


def test_texts_without_words_and_equal_sets_are_one(spark):
    assert kept(spark, [(1, "\n"), (2, "\t"), (3, ""), (4, "A b"), (5, "a  B\n")]) == [(False, 1, "\n"), (False, 4, "A b")]


def test_buckets_grow_with_the_nodes():
    from chronogrid.llm.near_copies import AGREE, samples_for

    for nodes, bits in ((0, 14), (10**5, 15), (10**9, 28)):
        tables, sampled = samples_for(nodes).shape
        assert sampled == bits and 1 - (1 - AGREE**sampled) ** tables >= 0.995


def test_divided_buckets_give_the_same_groups(spark, monkeypatch):
    from chronogrid.llm import near_copies

    rng = random.Random(14)
    base = [f"w{rng.randrange(20_000)}" for _ in range(200)]
    rows = [(i, " ".join([*base[: 7 * i % 190], f"edit{i}", *base[7 * i % 190 + 1 :]])) for i in range(120)] + [(1000 + i, f"another text number {i} of its own kind") for i in range(50)]
    want = kept(spark, rows)
    monkeypatch.setattr(near_copies._groups, "__defaults__", (10,))
    assert kept(spark, rows) == want and len(want) == 51
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", 0)
    assert kept(spark, rows) == want


def test_pivot_tables_of_buckets_discard_and_lose_no_link(monkeypatch):
    import numpy as np
    import pandas as pd

    from chronogrid.llm import near_copies

    rng = np.random.default_rng(15)
    rows = []
    for bucket, size in enumerate((1, 2, 3, 5, 9, 17, 32, 33, 150, 400)):
        heads = rng.integers(0, 2, (1 + size // 6, near_copies.BITS), dtype=np.uint8)
        for k in range(size):
            one = heads[rng.integers(len(heads))].copy()
            one[rng.choice(near_copies.BITS, rng.integers(0, 60 if bucket < 9 else 36), replace=False)] ^= 1  # a group's members are up to 118 bits apart
            rows.append((bucket, 0, 0, 1000 * bucket + k, *map(int, np.packbits(one).view("<i8"))))
    rows = pd.DataFrame(rows, columns=["bucket", "i", "j", "node", *near_copies.WORDS])
    bits = rows[list(near_copies.WORDS)].to_numpy(np.int64).view(np.uint64)
    bucket, node, want, pairs = rows["bucket"].to_numpy(), rows["node"].to_numpy(), set(), 0
    for b in range(10):
        at = np.flatnonzero(bucket == b)
        near = np.bitwise_count(bits[at][:, None] ^ bits[at][None]).sum(axis=2) <= near_copies.MAX_BITS
        pairs += len(at) * (len(at) - 1) // 2
        first = np.arange(len(at))
        for _ in at:
            first = np.where(near, first[None], len(at)).min(axis=1)
        want |= {(int(node[at[k]]), int(node[at[f]])) for k, f in enumerate(first) if k != f}
    told, compared = near_copies._apart, []
    monkeypatch.setattr(near_copies, "_apart", lambda x, y: compared.append(len(x)) or told(x, y))
    for cut in (len(rows), 7):  # batches end anywhere
        compared.clear()
        got = pd.concat(near_copies._links(rows.iloc[k : k + cut] for k in range(0, len(rows), cut)))
        assert set(map(tuple, got.to_numpy().tolist())) == want and len(want) > 300
        assert sum(compared) < pairs / 2
