"""The seeds of decontamination: rarest n-grams, as many as no leak can do without, and common n-grams in linear time."""

from __future__ import annotations

import random
import time

import numpy as np

from chronogrid.llm.decontaminate import MATCH, THRESHOLD, align, find_leaks, leaks_in, load_items


def test_common_ngrams_are_no_seeds_where_others_suffice():
    rng = random.Random(1)
    common = "the end of all things".split()
    rows = [(i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(30)), *common, *(f"w{rng.randrange(10**6)}" for _ in range(30))])) for i in range(5)] + [(9, " ".join(common * 6)), (10, "a b c d e f")]
    items = load_items(rows)
    documents = np.bincount(np.repeat(np.arange(len(items.grams)), np.diff(items.first)))
    items.choose_seeds(documents, THRESHOLD)
    for k, words in enumerate(items.words):
        own = items.seed[items.item == k]
        m = len(words)
        assert (~own).sum() == (max(0, int(np.ceil(round(0.2 * m - 2, 9))) - 1) if m > 10 else 0)
    held = {tuple(items.words[i][p : p + 3]) for i, p, s in zip(items.item, items.place, items.seed, strict=True) if s and i < 5}
    assert tuple(items.vocabulary[w] for w in common[:3]) not in held


def edited(rng, words, every):
    out = []
    for i, w in enumerate(words):
        if i % every == every - 1:
            kind = rng.randrange(3)
            out += [["other"], [], [w, "more"]][kind]
        else:
            out.append(w)
    return out


def test_edited_copies_are_found_among_common_words(spark):
    """Small vocabularies make most n-grams common; what alignment with everything finds is found."""
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((12, 20, 45, 90))))) for i in range(12)]
    docs = []
    for n in range(90):
        words = [rng.choice(vocabulary) for _ in range(60)]
        if n % 3:
            words[20:20] = edited(rng, items[n % 12][1].split(), rng.choice((4, 5, 6, 9)))
        docs.append((n, " ".join(words)))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    held, want = load_items(items), {}
    for d, text in docs:
        codes = held.codes(text)
        for k, words in enumerate(held.words):
            score = align(words, codes)[0]
            if score >= THRESHOLD * MATCH * len(words):
                want[d, held.ids[k]] = score
    assert set(want) == set(got) and len(want) > 30


def test_a_common_ngram_takes_linear_time():
    took = []
    for n in (1000, 4000):
        items = load_items([(i, f"one of the x{i} y{i} z{i} u{i} v{i} q{i} r{i} s{i}") for i in range(n)])
        start = time.time()
        assert leaks_in(" and ".join(["one of the"] * n), items) == []
        took.append(time.time() - start)
    assert took[1] < 12 * took[0] + 1


def test_a_leak_beside_many_common_ngrams():
    items = load_items([(i, f"one of the x{i} y{i} z{i} u{i} v{i} q{i} r{i} s{i}") for i in range(50)])
    text = " and ".join(["one of the"] * 300) + " x7 y7 z7 u7 v7 q7 wrong s7 " + "one of the " * 20
    assert [x[0] for x in leaks_in(text, items)] == [7]
