"""The corpus queries that SQL can express, on given and on odd tables, and operators on ids that are texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronogrid.llm import queries as llm
from chronogrid.llm.decontaminate import find_leaks
from chronogrid.llm.sharding import shard_by_bytes
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\t", "A b", "a B", "a b c d", "A b c d a b c d", "x" * 64, "é" * 32, " a b c d", "one two three four five six seven", "One two three four five six seven eight", "BM RIFF %PDF- GIF89a"]


@pytest.mark.parametrize("name", ["op9_signature_media", "op13_odd_sketch_minhash", "media_carved"])
@pytest.mark.parametrize("kind", ["given", "odd", "empty"])
def test_matches_oracle(spark, tmp_path, name, kind):
    folder = SF
    if kind != "given":
        texts = ODD + ODD[4:9] if kind == "odd" else []
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in" / "documents.parquet"))
        folder = str(tmp_path / "in")
    got = llm.queries()[name](spark, folder).toPandas()
    want = connect(SF if kind == "given" else str(tmp_path)).execute(llm.oracle_sql()[name]).fetchdf()
    assert difference(got, want) is None


def test_item_ids_of_texts(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q-7", words), ("q-8", "other words of another item in a row here and there"), (None, words), ("q-9", None)], "item_id string, text string")
    got = [(r["doc_id"], r["item_id"], r["start_word"]) for r in find_leaks(docs, items).collect()]
    assert got == [(1, "q-7", 1)]
    numbered = items.filter("item_id is not null").select(F.substring("item_id", 3, 9).cast("int").alias("item_id"), "text")
    assert [(r["item_id"], r["similarity"]) for r in find_leaks(docs, numbered).collect()] == [(7, 1.0)]
    assert find_leaks(docs, items.limit(0)).schema["item_id"].dataType.simpleString() == "string"


def test_shards_of_text_ids(spark):
    rows = [(f"d{i}", "text " * (i % 7)) for i in range(300)] + [(None, "a"), (None, None), ("d1", "text ")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = shard_by_bytes(df, n_shards=5).toPandas()
    assert len(got) == len(rows)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 2 * got["size"].max()
    again = shard_by_bytes(df.repartition(7), n_shards=5).toPandas()
    key = ["doc_id", "text", "shard", "slot"]
    assert got[key].sort_values(key).astype(str).values.tolist() == again[key].sort_values(key).astype(str).values.tolist()
