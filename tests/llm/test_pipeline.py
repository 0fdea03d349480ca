"""The pipeline's stages, each on its own input, over small planted documents."""

from __future__ import annotations

import corpus_pipeline
from chronogrid.llm.common import table

SF = "/root/testdata/sf0.001"


FOREIGN = {
    1: "Привет, как у вас дела сегодня? Мы вчера долго гуляли по старому городу и потом пили чай. " * 3,
    2: "Wczoraj wieczorem poszliśmy na długi spacer przez stare miasto, a potem piliśmy herbatę w małej kawiarni przy rynku. " * 3,
    3: "Eilen illalla kävelimme pitkään vanhassa kaupungissa ja joimme sitten teetä pienessä kahvilassa torin laidalla. " * 3,
    4: "qzxv kwpj zzqx vvkj xqwz jkvx qqzw pxvk zjqx wvkq " * 6,
    5: "昨日の夜、私たちは古い町を長い間散歩して、それから広場の小さな喫茶店でお茶を飲みました。" * 4,
}


def test_language_stage_rejects_planted_foreign_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    planted = spark.createDataFrame([(-i, t, None, "src0", len(t)) for i, t in FOREIGN.items()], docs.schema)
    kept = corpus_pipeline.keep_known_language(spark, docs.unionAll(planted), "/root/testdata/sf0.01").cache()
    assert kept.filter("doc_id < 0").count() == 0
    assert kept.filter("doc_id >= 0").count() >= 0.99 * docs.count()


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    known = corpus_pipeline.keep_known_language(spark, docs, SF)
    assert known.columns == columns and 0.8 * before < known.count() <= before
    twice = docs.unionAll(docs)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, twice, SF)
    assert kept.columns == columns and 0 < kept.count() < before
    clean = corpus_pipeline.drop_benchmark_leaks(spark, docs, SF)
    leak = table(spark, SF, "benchmark").selectExpr("item_id + 1000000 AS doc_id", "text", "'en' AS lang", "'src0' AS source", "1L AS n_chars")
    assert clean.columns == columns and corpus_pipeline.drop_benchmark_leaks(spark, leak, SF).count() == 0
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    shards = corpus_pipeline.assign_shards(spark, mixed, SF)
    assert shards.count() == mixed.count()


def test_stages_on_empty_and_odd_tables(spark):
    docs = table(spark, SF, "documents")
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "?!", None, "s", 2), (3, "same short text", "en", "s", 3), (3, "same short text", "en", "s", 3), (3, "another text", None, "s", 3)]
    for df in (docs.limit(0), spark.createDataFrame(odd, docs.schema)):
        df = df.selectExpr("*", "1 AS rank", "2 AS component", "3 AS size_", "4 AS taken_")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            rows = out.collect()
            if name != "sharding":
                assert out.columns == df.columns
            if df.isEmpty():
                assert rows == []
    kept = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(odd, docs.schema), SF).collect()
    assert sorted(str(r["text"]) for r in kept) == ["", "?!", "another text", "same short text"]
