"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm.common import table


def op1_consensus_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_seeded_alignment_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.lang_id import identify

    out = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op4_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.quality import classify

    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op5_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op6_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH rules(host, path, verdict) AS (VALUES {rules}),
parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
""".format(rules=", ".join(str(r) for r in URL_RULES))


def op7_hash_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_signature_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.media import encode_text_media

    return encode_text_media(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The payload's bytes one by one; the header of its WAV; the check of its last 64 bytes, by bits.
STORED_CTES = """
raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT *, octet_length(b) AS n, CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END AS pad FROM raw),
padded AS (SELECT doc_id, b, n, n + pad AS m, b || unhex(repeat('00', pad)) AS p FROM sized),
stored AS (
  SELECT doc_id, b, n, m, p, regexp_extract_all(hex(p), '..') AS hexes,
         unhex('52494646' || {riff} || '57415645' || '666d7420' || '10000000' || '0100' || '0100' || '401f0000' || '401f0000' || '0100' || '0800' || '64617461' || {data}) || p AS media
  FROM padded)
""".format(**{k: "printf('%02x%02x%02x%02x', " + ", ".join(f"(({x}) >> {s}) & 255" for s in (0, 8, 16, 24)) + ")" for k, x in {"riff": "m + 36", "data": "m"}.items()})

#: No text of the tables holds a whole medium, so embedded is 0.
OP9_SQL = f"""
WITH {STORED_CTES},
bytes AS (SELECT doc_id, m, unnest(range(m)) AS i, CAST('0x' || unnest(hexes) AS INT) AS x FROM stored),
turned AS (SELECT *, (x >= 128) <> lag(x >= 128) OVER (PARTITION BY doc_id ORDER BY i) AS crossed FROM bytes),
frames AS (SELECT doc_id, i * 8 // m AS frame, min(x) AS lo, max(x) AS hi FROM bytes GROUP BY 1, 2),
envelopes AS (SELECT doc_id, string_agg(lo || '-' || hi, ',' ORDER BY frame) AS envelope FROM frames GROUP BY doc_id),
sums AS (
  SELECT doc_id, {" || ',' || ".join(f"count(*) FILTER (x // 16 = {k})" for k in range(16))} AS counts,
         sum(x) AS level, sum(x * x) AS energy, count(*) FILTER (crossed) AS crossings, list(x ORDER BY i) FILTER (i >= m - 64) AS tail
  FROM turned GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_bytes, s.m AS payload_bytes, sha256(s.p) AS payload_sha256,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(t.tail, lambda x: x::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS tail_crc32,
       s.m + 44 AS media_bytes, sha256(s.media) AS media_sha256,
       'wav8:' || s.m || ':' || t.counts || ':' || t.level || ':' || t.energy || ':' || t.crossings || ':' || e.envelope AS feature,
       'audio/wav' AS media_type, 0::BIGINT AS embedded
FROM stored s JOIN sums t ON t.doc_id = s.doc_id JOIN envelopes e ON e.doc_id = s.doc_id
"""


def media_carved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored media under types that are often wrong, with the text and a second medium behind them, or behind the text alone: types
    corrected and media carved."""
    from chronogrid.llm.media import encode_text_media, sniff_media

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    stored = encode_text_media(docs, with_media=True)
    content = F.when(F.col("doc_id") % 2 == 0, F.concat("media", "raw", "media")).otherwise(F.concat("raw", "media"))
    declared = F.when(F.col("doc_id") % 3 == 0, "image/png").when(F.col("doc_id") % 3 == 1, "audio/wav")
    out = sniff_media(stored.select("doc_id", content.alias("content"), declared.alias("declared")), declared_col="declared")
    told = [F.array_join(F.col(f"media.{k}").cast("array<string>"), ",").alias(name) for k, name in {"at": "offsets", "length": "lengths", "type": "types", "sha256": "sha256s"}.items()]
    return out.select("doc_id", "true_type", "type_corrected", *told)


CARVED_SQL = f"""
WITH {STORED_CTES},
placed AS (
  SELECT doc_id, doc_id % 2 = 0 OR n = 0 AS leads, CASE WHEN doc_id % 2 = 0 THEN 44 + m + n WHEN n > 0 THEN n END AS place, m + 44 AS size,
         sha256(media) AS hash, CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'audio/wav' END AS declared
  FROM stored)
SELECT doc_id, CASE WHEN leads THEN 'audio/wav' ELSE declared END AS true_type, leads AND declared IS DISTINCT FROM 'audio/wav' AS type_corrected,
       coalesce(place::VARCHAR, '') AS offsets, CASE WHEN place IS NULL THEN '' ELSE size::VARCHAR END AS lengths,
       CASE WHEN place IS NULL THEN '' ELSE 'audio/wav' END AS types, CASE WHEN place IS NULL THEN '' ELSE hash END AS sha256s
FROM placed
"""


def op10_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "mix_shards")


def op11_prefix_trie_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 by its bits: all other functions are the engine's own.
OP11_SQL = """
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) AS t),
seqs AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS seq FROM placed GROUP BY conv_id),
plan AS (
  SELECT conv_id, seq, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
             lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h
  FROM seqs),
rebuilt AS (
  SELECT p.conv_id, list_concat(coalesce(b.seq[1:p.h], []), p.seq[p.h + 1:]) AS seq
  FROM plan p LEFT JOIN seqs b ON b.conv_id = p.base),
paths AS (SELECT conv_id, len(seq) AS size, unnest(range(0, len(seq) + 1)) AS depth, seq FROM rebuilt),
keyed AS (SELECT conv_id, size, depth, seq[1:depth] AS key, seq[1:depth - 1] AS parent_key, length(seq[depth].text) AS n FROM paths),
nodes AS (
  SELECT key, depth, any_value(parent_key) AS parent_key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(n), 0) AS own,
         sha256(coalesce(string_agg(CASE WHEN size = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM keyed GROUP BY key, depth),
kids AS (SELECT parent_key AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
told AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.key = n.key AND k.depth = n.depth),
sums AS (
  SELECT k.key, k.depth, sum(CASE WHEN t.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(t.own) AS saved_tokens
  FROM told t JOIN keyed k ON k.conv_id = t.conv_id AND k.depth <= t.depth GROUP BY 1, 2)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, t.ends_sha256
FROM told t JOIN sums s ON s.key = t.key AND s.depth = t.depth
LEFT JOIN told p ON t.depth > 0 AND p.depth = t.depth - 1 AND p.key = t.parent_key
"""


def op12_deduplicated_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.token_alignment import align_tokenizers

    return align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronogrid.llm.odd_sketch import similar_sets

    return similar_sets(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Links of sets by the shingles that they share, and what is reached by them.
OP13_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
cut AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
  FROM split),
docs AS (SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(10))) AS k, s FROM cut),
sets AS (SELECT k, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS least FROM docs WHERE n > 0 GROUP BY k),
items AS (SELECT k, n, least, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.least AS a, b.least AS b
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.least < b.least AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.least, b.least, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT least, least FROM sets UNION SELECT r.a, s.b FROM reach r JOIN sides s ON s.a = r.b),
found AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, d.n AS n_shingles, coalesce(f.component, d.doc_id) AS component_id, d.doc_id = coalesce(f.component, d.doc_id) AS kept
FROM docs d LEFT JOIN sets s ON s.k = d.k LEFT JOIN found f ON f.a = s.least
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_consensus_host_paths, op2_seeded_alignment_leaks, op3_kneser_ney_language, op4_positive_unlabelled_quality, op5_sampled_splitter_shards, op6_bloom_cascade_urls, op7_hash_suffix_sort, op8_simhash_pivots, op9_signature_media, op10_hypergeometric_mix, op11_prefix_trie_contraction, op12_deduplicated_alignment, op13_odd_sketch_minhash, media_carved)}


def oracle_sql() -> dict[str, str]:
    return {"op6_bloom_cascade_urls": OP6_SQL, "op9_signature_media": OP9_SQL, "op11_prefix_trie_contraction": OP11_SQL, "op13_odd_sketch_minhash": OP13_SQL, "media_carved": CARVED_SQL}
