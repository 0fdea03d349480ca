"""The corpus operators against brute force, exact round trips, held-out accuracy and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from chronogrid.llm import queries as llm
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a"), (4, "same words here now"), (5, "same words here now"), (6, "é ß 漢字 " * 40), (7, "12 34 !?"), (8, "long text of words " * 3000), (8, "long text of words " * 3000)]


def documents(spark, rows=None):
    rows = ODD if rows is None else rows
    full = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def run(spark, name):
    return llm.queries()[name](spark, SF).toPandas()


def test_urls_match_oracle(spark):
    got = run(spark, "op6_bloom_cascade_urls")
    want = connect(SF).execute(llm.oracle_sql()["op6_bloom_cascade_urls"]).fetchdf()
    assert list(got.columns) == list(want.columns) and difference(got, want) is None


def brute_repeats(rows, width=100):
    """(doc, bytes, removed, spans, digest) by a plain scan for windows that started earlier."""
    seen, out = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for at in range(len(b) - width + 1):
            part = b[at : at + width]
            if part in seen:
                gone[at : at + width] = b"\1" * width
            seen.add(part)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(spark, docs):
    got = run(spark, "op7_hash_suffix_sort")
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got[cols].values.tolist())) == brute_repeats(zip(docs.doc_id, docs.text, strict=True))


def test_repeats_in_long_runs_and_odd_texts(spark):
    from chronogrid.llm.suffix_dedup import remove_repeats

    rng = random.Random(5)
    part = "".join(rng.choice("abcdé ") for _ in range(150))
    rows = ODD[:-2] + [(10, "x" * 5000), (11, "ab" * 700 + part), (12, part + "tail" + part), (13, "y" + "x" * 100)]
    got = remove_repeats(documents(spark, rows).select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats(rows)


def colliding_texts():
    """Two texts whose polynomial hashes modulo 2^64 agree: Thue-Morse order of two blocks, and the blocks swapped. Both
    blocks begin with the same bytes of a very small hash, so that each text is one run."""
    import numpy as np

    from chronogrid.llm.suffix_dedup import GRAM, Text, _mixed

    noise = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8)
    at = int(_mixed(Text(noise).all_hashes(GRAM)).argmin())
    filler = noise[at : at + 36].tobytes().decode()
    blocks = [filler + "".join(random.Random(5).choices("ABCDEFGH", k=30)), filler + "".join(random.Random(6).choices("ABCDEFGH", k=30))]
    order = [i.bit_count() & 1 for i in range(2048)]
    return "".join(blocks[b] for b in order), "".join(blocks[1 - b] for b in order)


@pytest.mark.parametrize("hot_bytes", [0, 2000, 1 << 16])
def test_repeats_are_verified_at_every_heat(spark, hot_bytes):
    from chronogrid.llm.suffix_dedup import remove_repeats

    rng = random.Random(hot_bytes)
    line = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = [*colliding_texts(), "x" * 30_000, "x" * 150, "abc" * 9000, "ab" * 2000 + line, None, ""]
    texts += ["".join(rng.choice("klmno ") for _ in range(rng.randint(0, 200))) + line + str(k) for k in range(120)]
    rows = list(enumerate(texts))
    got = remove_repeats(documents(spark, rows).select("doc_id", "text").repartition(7), hot_bytes=hot_bytes)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == brute_repeats(rows)


def test_repeats_in_texts_over_a_piece(spark):
    from chronogrid.llm.suffix_dedup import PIECE, remove_repeats

    rng = random.Random(8)
    long_ = "".join(rng.choice("abcdefghijklmnop \u00e9") for _ in range(PIECE + 5000))
    rows = [(3, long_), (5, long_[PIECE - 3000 : PIECE + 200]), (7, "z" * (PIECE + 3)), (9, "q" + long_[4000:20_000])]
    got = remove_repeats(documents(spark, rows).select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(tuple(r) for r in got.collect()) == brute_repeats(rows)


def test_repeats_with_text_ids_clashes_and_no_rows(spark):
    from chronogrid.llm.suffix_dedup import remove_repeats

    rng = random.Random(4)
    part = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [("b", part, "u"), ("a", part, "s"), (None, "t" + part, "x"), ("a", part, "s")]
    got = remove_repeats(spark.createDataFrame(rows, "_cut string, text string, uid string"), id_col="_cut")
    assert sorted((str(r["_cut"]), r["n_removed"]) for r in got.collect()) == [("None", 0), ("a", 300), ("a", 300), ("b", 300)]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_components(rows):
    import xxhash

    prints = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, f"{prints[i]:016x}", root(i)) for i in ids)


def test_simhash_matches_brute_force(spark, docs):
    got = run(spark, "op8_simhash_pivots")
    assert sorted(map(tuple, got.values.tolist())) == brute_components(zip(docs.doc_id, docs.text, strict=True))


def test_simhash_splits_hot_buckets_exactly(spark):
    from chronogrid.llm.common import connected_components
    from chronogrid.llm.simhash import link_fingerprints

    rng = random.Random(1)
    bits = sorted({rng.getrandbits(16) for _ in range(600)})
    prints = spark.createDataFrame([(b, i) for i, b in enumerate(bits)], "bits long, node long")
    got = {r["node"]: r["component"] for r in connected_components(link_fingerprints(prints, bucket_rows=20)).collect()}
    groups = defaultdict(set)
    parent = list(range(len(bits)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for i in range(len(bits)):
        groups[root(i)].add(i)
    assert {i: got.get(i, i) for i in range(len(bits))} == {i: min(g) for g in groups.values() for i in g}


def test_shards_hold_equal_bytes(spark, docs):
    got = run(spark, "op5_sampled_splitter_shards")
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    size = {i: len((t or "").encode()) + 8 for i, t in zip(docs.doc_id, docs.text, strict=True)}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all(size[r.doc_id] == r.size and crc[r.doc_id] == r.text_crc32 for r in got.itertuples())
    part = sum(size.values()) / 24
    assert all(abs(s - part) <= max(size.values()) for s in got.groupby("shard")["size"].sum())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_mix_meets_targets_and_reruns_agree(spark):
    got, again = run(spark, "op10_hypergeometric_mix"), run(spark, "op10_hypergeometric_mix")
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert ((got.taken <= 2 * got["size"]) & (got.taken >= 0)).all()
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), source_size=("source_size", "first"), largest=("size", "max"))
    assert abs(by.target.sum() - 1.5 * by.source_size.sum()) < 1 and (by.target <= 2 * by.source_size + 1e-6).all()
    # whole documents: a source misses its target by less than its largest document
    assert ((by.taken - by.target).abs() < by.largest).all()


def test_media_round_trip(spark, docs):
    got = run(spark, "op9_signature_media").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        b = (t or "").encode()
        padded = b + bytes(-len(b) % 64 if b else 64)
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(b), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes > len(padded)


def test_language_on_held_out_rows(spark, docs):
    got = run(spark, "op3_kneser_ney_language").merge(docs[["doc_id", "lang"]], on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    part = got[got.held_out & got.lang.notna()]
    assert (part.lang == part.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()


def test_quality_on_held_out_rows(spark):
    got = run(spark, "op4_positive_unlabelled_quality")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    part = got[got.held_out].merge(labels, on="doc_id")
    good, bad = part[part.quality == 1].score, part[part.quality == 0].score
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.8
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_leaks_of_edited_passages(spark):
    from chronogrid.llm.decontaminate import drop_leaking, find_leaks

    rng = random.Random(3)
    item = [f"w{rng.randrange(900)}" for _ in range(50)]
    edited = [w if k % 9 else "other" for k, w in enumerate(item)]
    noise = [f"n{rng.randrange(900)}" for _ in range(400)]
    rows = [(20, " ".join(noise + item + noise)), (21, " ".join(noise + edited)), (22, " ".join(noise)), *ODD]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(documents(spark, rows), bench).collect()) == [(20, 1), (21, 1)]
    assert drop_leaking(documents(spark, rows), bench).count() == len(rows) - 2


def test_pages_give_text(spark):
    got = run(spark, "op1_consensus_host_paths")
    assert (got.n_chars == got.text.map(len)).all() and (got.n_chars > 0).mean() > 0.8
    assert not got.text.str.contains(r"<\w+[^>]*>", regex=True).any()


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_and_empty_tables(spark, rows):
    from chronogrid.llm.lang_id import identify
    from chronogrid.llm.media import encode_text_media
    from chronogrid.llm.mixing import mix
    from chronogrid.llm.quality import classify
    from chronogrid.llm.sharding import shard_by_bytes
    from chronogrid.llm.simhash import simhash_components

    df = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    clash = df.selectExpr("*", "1 AS size", "'x' AS shard", "0 AS score", "1 AS component_id", "2 AS key")
    for out in (
        identify(clash),
        encode_text_media(df.select("doc_id", "text")),
        mix(clash),
        classify(df.select("doc_id", "text"), labels.distinct()),
        shard_by_bytes(clash),
        simhash_components(clash),
    ):
        assert out.count() == len(rows)


def brute_entropies(train, texts):
    """Interpolated Kneser-Ney by plain dictionaries: {language: [cross-entropy]}."""
    import math
    from collections import Counter

    from chronogrid.llm.lang_id import FLOOR, _codes

    out = {}
    for lang in sorted({x for x, _ in train}):
        grams = Counter()
        for x, t in train:
            if x == lang:
                c = [int(i) for i in _codes(t)]
                grams.update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
        by = {4: grams}
        for order in (3, 2, 1):
            by[order] = Counter(g[1:] for g in by[order + 1])
        cut, total, kinds = {}, defaultdict(int), defaultdict(int)
        for order, seen in by.items():
            once, twice = sum(n == 1 for n in seen.values()), sum(n == 2 for n in seen.values())
            cut[order] = min(0.95, max(0.1, once / (once + 2 * twice))) if once and twice else 0.75
            for g, n in seen.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1

        def prob(g):
            if not g:
                return math.exp(FLOOR)
            if not total[g[:-1]]:
                return prob(g[1:])
            d = cut[len(g)]
            return (max(by[len(g)][g] - d, 0) + d * kinds[g[:-1]] * prob(g[1:])) / total[g[:-1]]

        out[lang] = []
        for t in texts:
            c = [int(i) for i in _codes(t)]
            each = [math.log(prob(tuple(c[i : i + 4]))) for i in range(len(c) - 3)]
            out[lang].append(-sum(each) / len(each))
    return out


def test_language_models_match_brute_force_in_any_slices(spark, docs, monkeypatch):
    from chronogrid.llm import lang_id
    from chronogrid.llm.lang_id import fit, predict

    train = [(x, t) for x, t in zip(docs.lang, docs.text, strict=True) if isinstance(x, str) and t][:60]
    texts = [t for t in docs.text[60:90] if t and any(c.isalpha() for c in t)] + ["Привет как дела " * 9, "𐐀𐐁 漢字 the"]
    want = brute_entropies(train, texts)
    rows = spark.createDataFrame(train, "lang string, text string")
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lang_id, "LEFT_OUT", 1 << 40)
    for slice_bytes in (1 << 26, 1 << 17):
        model = fit(rows, slice_bytes=slice_bytes)
        assert (model.slices > 1) == (slice_bytes < 1 << 20)
        got = {r["doc_id"]: r for r in predict(asked, model).collect()}
        for i in range(len(texts)):
            best = min(want, key=lambda k: want[k][i])
            assert got[i]["cross_entropy"] == pytest.approx(want[best][i], abs=1e-4)
            assert got[i]["lang_pred"] == best
        assert not any(r["rejected"] for r in got.values())  # nothing was left out to calibrate with


@pytest.mark.parametrize("every", [4, 5, 6, 7])
def test_leaks_with_a_word_replaced_every_few(spark, every):
    from chronogrid.llm.decontaminate import find_leaks

    rng = random.Random(every)
    item = [f"w{k}" for k in rng.sample(range(900), 40)]
    replaced = [w if k % every < every - 1 else "other" for k, w in enumerate(item)]
    inserted = [x for k, w in enumerate(item) for x in ([w, "other"] if k % 2 else [w])]
    noise = [f"n{rng.randrange(900)}" for _ in range(100)]
    rows = [(20, " ".join(noise + replaced + noise)), (21, " ".join(noise + inserted)), (22, " ".join(noise))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.doc_id for r in find_leaks(documents(spark, rows), bench).collect()) == [20, 21]


def test_slots_with_very_long_texts(spark):
    from chronogrid.llm.sharding import shard_by_bytes

    rng = random.Random(6)
    rows = [(i, f"t{i} " + "x" * rng.randrange(300)) for i in range(3000)] + [(9000 + i, f"long{i} " * 40_000) for i in range(7)]
    docs = documents(spark, rows)
    for df, n in ((docs, len(rows)), (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), None)):
        got = shard_by_bytes(df).toPandas()
        assert len(got) == (n or df.count())
        part = got["size"].sum() / 24
        assert all(abs(s - part) <= got["size"].max() for s in got.groupby("shard")["size"].sum())
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_ranges_are_counted_with_their_splitters(spark):
    from chronogrid.llm.sharding import _range_of, plan_ranges
    from pyspark.sql import functions as F

    rng = random.Random(4)
    # sizes fall off steeply, so a range's largest key stays overfull time after time
    sizes = [max(8, int(1e9 / 1.6**i)) for i in range(40)] + [100] * 3000
    rows = [(i if i < 40 else rng.randrange(1 << 40), i, s) for i, s in enumerate(sizes)]
    keys = spark.createDataFrame(rows, "h long, d long, size long")
    splitters, counts, size, n = plan_ranges(keys, 24, 16, 128 << 20, 16384)
    placed = keys.groupBy(_range_of(F.col("h"), F.col("d"), splitters).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.count_distinct("h", "d").alias("k"))
    ranges = max(24 * 16, -(-size // (128 << 20)))
    for r in placed.collect():
        assert counts[r["r"]] == (r["b"], r["n"])
        assert r["k"] == 1 or r["b"] <= 3 * size / ranges and r["n"] <= 3 * n / ranges


def test_limits_come_from_all_training_texts(spark):
    from chronogrid.llm.lang_id import MARGIN, fit, predict

    rng = random.Random(12)
    words = {lang: ["".join(chr(low + rng.randrange(n)) for _ in range(4)) for _ in range(w)] for lang, low, n, w in (("xx", 97, 26, 50), ("zz", 0x4E00, 3000, 3000))}
    rows = [(lang, " ".join(rng.choice(words[lang]) for _ in range(30))) for lang, n in (("xx", 12_000), ("zz", 900)) for _ in range(n)]
    train = spark.createDataFrame(rows, "lang string, text string")
    model = fit(train)
    seen = predict(train, model).filter("lang = 'zz'").toPandas()
    assert len(seen) == 900 and (seen.lang_pred == "zz").all() and not seen.rejected.any()
    # the limit is that of texts which the model has not counted: above nearly all that it has
    assert seen.cross_entropy.quantile(0.9) < model.limits[model.langs.index("zz")] - MARGIN < seen.cross_entropy.max() + MARGIN


def test_language_of_texts_over_a_piece(spark):
    import numpy as np

    from chronogrid.llm.lang_id import PIECE, _codes, _grams, _text_grams

    rng = random.Random(2)
    text = "".join(rng.choice("abc d.e f\u00e9\u03a3 ") for _ in range(PIECE + 9000))
    for t in (text, "x" * (PIECE + 7), "12 " * PIECE, "\u6f22" * (2 * PIECE + 1), ". a" + text):
        parts = [g for _, g in _text_grams([t])]
        assert np.array_equal(np.concatenate(parts) if parts else np.zeros(0, np.uint64), _grams(_codes(t)))
    assert [i for i, _ in _text_grams([None, "", "a"])] == [2]


def _with_crc(b, table, bits):
    crc = 0
    for x in b:
        crc = (crc << 8 & (1 << bits) - 1) ^ table[crc >> bits - 8 ^ x]
    return crc


def planted_media():
    """One valid medium for each validator, and the bytes after which a validator that is too short would stop."""
    import io
    import struct
    import zipfile

    from chronogrid.llm.media import FLAC_CRC, OGG_CRC, to_wav

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9) + b"\xff\xda" + struct.pack(">H", 8) + bytes(6) + b"ab\xff\x00cd\xff\xd0ef" + b"\xff\xd9"
    webp = b"RIFF" + struct.pack("<I", 4 + 8 + 10) + b"WEBPVP8 " + struct.pack("<I", 10) + bytes(10)
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + struct.pack("<iiHHIIiiII", 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    body = b"%PDF-1.4\n1 0 obj <<>> endobj\n"
    pdf = body + b"xref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF\n" % len(body)
    pdf += b"2 0 obj <<>> endobj\nxref\n0 1\ntrailer <<>>\nstartxref\n%d\n%%%%EOF\n" % (len(pdf) + 20)
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.txt", "hello")
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("inner.zip", inner.getvalue())
        z.comment = b"note"
    frames = b""
    for k in range(3):
        frame = b"\xff\xf8\xc9\x18" + bytes([k]) + b"frame data %d" % k
        frames += frame + struct.pack(">H", _with_crc(frame, FLAC_CRC, 16))
    flac = b"fLaC" + b"\x80\0\0\x22" + bytes(34) + frames

    def page(flags, serial, number, data):
        head = b"OggS\0" + bytes([flags]) + bytes(8) + struct.pack("<II", serial, number)
        tail = b"\x01" + bytes([len(data)]) + data
        return head + struct.pack("<I", _with_crc(head + bytes(4) + tail, OGG_CRC, 32)) + tail

    ogg = page(2, 1, 0, b"one") + page(2, 2, 0, b"two") + page(4, 1, 1, b"end one") + page(4, 2, 1, b"end two")
    return {
        "image/png": png, "image/gif": gif, "image/jpeg": jpeg, "image/webp": webp, "image/bmp": bmp, "application/pdf": pdf,
        "application/zip": outer.getvalue(), "audio/flac": flac, "audio/ogg": ogg, "audio/wav": to_wav(b"samples!"),
    }


def test_sniffing_corrects_and_carves(spark):
    from chronogrid.llm.media import sniff_media

    media = planted_media()
    rows = [(i, b, k if i % 2 else "text/plain") for i, (k, b) in enumerate(media.items())]
    joined, places = b"junk PK\x03\x04 BM ", []
    for kind, b in media.items():
        places.append((len(joined), len(b), kind))
        joined += b + b" between "
    rows += [(100, joined, "text/plain"), (101, None, None), (102, b"", "text/plain"), (103, media["image/png"][:-1], "image/png"), (104, media["audio/ogg"].replace(b"one", b"onf", 1), "x")]
    df = spark.createDataFrame(rows, "id long, content binary, kind string").selectExpr("*", "1 AS _seen", "2 AS _declared", "3 AS media")
    got = {r["id"]: r for r in sniff_media(df, declared_col="kind").collect()}
    for i, kind in enumerate(media):
        assert (got[i]["true_type"], got[i]["media"], got[i]["type_corrected"]) == (kind, [], i % 2 == 0)
    assert [(m["at"], m["length"], m["type"]) for m in got[100]["media"]] == places
    assert all(m["sha256"] == hashlib.sha256(joined[m["at"] : m["at"] + m["length"]]).hexdigest() for m in got[100]["media"])
    assert got[100]["true_type"] == "text/plain" and got[101]["true_type"] is None and got[102]["media"] == []
    assert got[103]["true_type"] == "image/png" and not got[103]["type_corrected"] and got[104]["media"] == []
    assert sniff_media(df.limit(0)).count() == 0


def test_short_items_and_unspaced_scripts_leak(spark):
    from chronogrid.llm.decontaminate import find_leaks

    han = "昨日の夜私たちは古い町を長い間散歩して広場の小さな喫茶店でお茶を飲みました"
    bench = spark.createDataFrame([(1, "two words"), (2, han), (3, "?!"), (4, None)], "item_id long, text string")
    rows = [(10, "here are two words, whole"), (11, "words two"), (12, "前の文。" + han + "。次の文"), (13, "前の文。次の文"), (14, None)]
    got = find_leaks(documents(spark, rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(10, 1), (12, 2)]


def test_leaks_agree_with_alignment_of_everything(spark, docs):
    from chronogrid.llm.decontaminate import MATCH, THRESHOLD, align, find_leaks, load_items

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    items = load_items(list(zip(bench.item_id, bench.text, strict=True)))
    part = docs[:120]
    want = set()
    for i, t in zip(part.doc_id, part.text, strict=True):
        codes = items.codes(t)
        want |= {(i, item) for item, words in zip(items.ids, items.words, strict=True) if align(words, codes)[0] >= THRESHOLD * MATCH * len(words)}
    got = find_leaks(spark.createDataFrame(part[["doc_id", "text"]]), spark.createDataFrame(bench)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_clashing_names_in_every_operator(spark):
    from chronogrid.llm.lang_id import identify
    from chronogrid.llm.media import encode_text_media
    from chronogrid.llm.mixing import mix, mixed_documents
    from chronogrid.llm.near_copies import keep_one_of_copies
    from chronogrid.llm.quality import classify
    from chronogrid.llm.sharding import shard_by_bytes
    from chronogrid.llm.simhash import simhash_components
    from chronogrid.llm.url_filter import judge_urls

    names = "_seen _m _k _at _x _good _luck _declared _sums _sumse mix_block_src mix_key mix_size name src key block pos size bits h d node uid id id2 h2 n rank slot best a b u v hot open".split()
    df = documents(spark).selectExpr("*", *[f"1 AS {n}" for n in names])
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    outs = [identify(df), encode_text_media(df), mix(df), classify(df, labels), shard_by_bytes(df), simhash_components(df), judge_urls(df.withColumnRenamed("source", "url"), spark.createDataFrame([("h", "/", "block")], "host string, path string, verdict string"))]
    assert [out.count() for out in outs] == [len(ODD)] * len(outs)
    assert mixed_documents(df).columns == df.columns and keep_one_of_copies(df).columns == df.columns
    assert keep_one_of_copies(df.limit(0)).count() == mixed_documents(df.limit(0)).count() == 0


def test_media_are_made_a_few_values_at_a_time(spark):
    import pyarrow as pa

    from chronogrid.llm.media import PIECE_BYTES, PIECE_ROWS, encode_text_media, in_pieces

    for values in ([], [None], ["x" * 9000] * 1000, [None, *["y"] * 1999], [b"z" * (PIECE_BYTES + 1)] * 3):
        pieces = list(in_pieces([pa.array(values, pa.binary() if b"z" in [(v or b"")[:1] for v in values] else pa.string())] * 2))
        assert [v for p in pieces for v in p] == values * 2
        assert all(len(p) <= PIECE_ROWS and (len(p) == 1 or sum(len(v or "") for v in p) <= PIECE_BYTES) for p in pieces)
    df = spark.range(5000).selectExpr("id", "repeat('ab', int(id % 50)) AS text").coalesce(1)
    out = encode_text_media(df, with_media=True)
    assert out.filter("n_bytes <> 2 * (id % 50) or length(media) <> media_bytes or payload_bytes <> 64 * greatest(ceil(n_bytes / 64), 1)").count() == 0 and out.count() == 5000
