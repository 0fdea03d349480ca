"""Chunking and searching texts and records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_chars(docs: DataFrame, n: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, body): chunks of n characters, the first of n + 1; a text of one character has none."""
    size = F.length(text_col)
    chunks = F.when(size > 1, F.sequence(F.lit(0), F.floor((size - 2) / n).cast("int")))
    start = F.when(F.col("chunk") == 0, 1).otherwise(F.col("chunk") * n + 2)
    width = F.when(F.col("chunk") == 0, n + 1).otherwise(n)
    return docs.select(id_col, text_col, F.explode(chunks).alias("chunk")).select(id_col, "chunk", F.col(text_col).substr(start, width).alias("body"))


def relevance(query: str, value: Column) -> Column:
    """Length of the query over that of a value which contains it, without regard to case; else 0."""
    return F.when(F.contains(F.lower(value), F.lit(query.lower())), len(query) / F.length(value)).otherwise(0.0)


def search_relevance(df: DataFrame, fields: list[str], query: str, id_col: str, compounding: bool = False) -> DataFrame:
    """Rows of which a field contains the query, best first, with the sum of the fields' relevance; compounding multiplies the
    relevance of the fields that have any."""
    each = [F.coalesce(relevance(query, F.col(f)), F.lit(0.0)) for f in fields]
    total = sum(each, F.lit(0.0))
    if compounding:
        product = F.lit(1.0)
        for x in each:
            product = product * F.when(x > 0, x).otherwise(1.0)
        total = F.when(total > 0, product).otherwise(0.0)
    return df.select(id_col, *fields, total.alias("score")).filter("score > 0").orderBy(F.desc("score"), id_col)


def smart_lookup(df: DataFrame, fields: list[str], query: str, id_col: str) -> DataFrame:
    """The one best row, whole, with its rank: an equal value beats one that contains the query, an earlier field a later one, a
    smaller id the rest. Without a match there is no row."""
    rank = F.lit(None).cast("int")
    for i, f in reversed(list(enumerate(fields))):
        rank = F.when(F.contains(F.lower(f), F.lit(query.lower())), len(fields) + i).otherwise(rank)
    for i, f in reversed(list(enumerate(fields))):
        rank = F.when(F.lower(f) == query.lower(), i).otherwise(rank)
    rest = [c for c in df.columns if c != id_col]
    best = df.select(F.struct(rank.alias("rank"), id_col, *rest).alias("m")).filter("m.rank is not null").agg(F.min("m").alias("m"))
    return best.filter("m is not null").select(f"m.{id_col}", "m.rank", *[f"m.{c}" for c in rest])


def chunk_lines(docs: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, body): chunks of n lines, the first of n + 1."""
    lines = F.split(text_col, "\n", -1)
    count = F.size(lines)
    chunks = F.sequence(F.lit(0), F.greatest(F.floor((count - 2) / n), F.lit(0)).cast("int"))
    start = F.when(F.col("chunk") == 0, 1).otherwise(F.col("chunk") * n + 2)
    width = F.when(F.col("chunk") == 0, n + 1).otherwise(n)
    held = docs.filter(F.col(text_col).isNotNull()).select(id_col, lines.alias("lines"), F.explode(chunks).alias("chunk"))
    return held.select(id_col, "chunk", F.array_join(F.slice("lines", start, width), "\n").alias("body"))


def chunk_markdown(docs: DataFrame, budget: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, body): lines packed in order while a chunk stays within the budget; a list's lines stay together while they
    fit in one, and a longer line is a chunk of its own. Blank texts have no chunk."""

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: markdown_chunks(t or "", budget))

    return docs.select(id_col, F.posexplode(pack(text_col)).alias("chunk", "body"))


BULLET = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")


def markdown_chunks(text: str, budget: int) -> list[str]:
    blocks: list[list[str]] = []
    for line in text.split("\n"):
        if blocks and BULLET.match(line) and BULLET.match(blocks[-1][-1]) and len("\n".join([*blocks[-1], line])) <= budget:
            blocks[-1].append(line)
        else:
            blocks.append([line])
    out, held = [], ""
    for block in blocks:
        body = "\n".join(block)
        if held and len(held) + 1 + len(body) > budget:
            out.append(held)
            held = body
        else:
            held = f"{held}\n{body}" if held else body
    return [x for x in [*out, held] if x.strip()]


def has_keys(text: Column, keys: list[str], how: str = "all") -> Column:
    """Whether a JSON object has all, or any, of the keys."""
    found = F.coalesce(F.map_keys(F.from_json(text, "map<string,string>")), F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, keys))
    return F.forall(wanted, lambda k: F.array_contains(found, k)) if how == "all" else F.arrays_overlap(found, wanted)
