"""The corpus pipeline: five operators, each over all that the one before it kept.

Every stage's rows are written to the shared folder as Parquet and read again as the next one's documents, so a lost
executor costs at most the stage it was in. All stages but the last return the columns of ``documents``.

Null or empty texts have no language and go at the first stage; repeated rows of one text are one group at the second;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm.common import table
from chronogrid.llm.decontaminate import drop_leaking
from chronogrid.llm.lang_id import identify
from chronogrid.llm.mixing import mixed_documents
from chronogrid.llm.near_copies import keep_one_of_copies
from chronogrid.llm.sharding import shard_by_bytes
from chronogrid.shared import materialise, release

#: The language model learns from the labelled languages, rejection needs language models: no SQL form.
ORACLE_SQL: str | None = None


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text one of the language models accepts."""
    return identify(docs).filter(~F.col("rejected")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of texts linked by Jaccard similarity >= 0.8 of 5-word shingles one document."""
    return keep_one_of_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of a test item."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights: a document is a row for every time it is taken."""
    return mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix with its shard and its slot there."""
    return shard_by_bytes(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        release(before)  # what is kept is written: the stage before is not read again
    return docs
