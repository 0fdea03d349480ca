"""Row-numbered frames, sheets of cells and keyed lists: the dataframe algebra, as joins and groupings on row_idx."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogrid.functions.expressions import checked

NAME = re.compile(r"\b([ab])\$([A-Za-z_]\w*)")


def operate_frames(a: DataFrame, b: DataFrame, equations: dict[str, str]) -> DataFrame:
    """Rows of both frames side by side by row_idx, with a column for each equation over ``a$name`` and ``b$name``, where missing
    values are 0: arithmetic and the functions that expressions.checked lists. Anything else in it is a ValueError."""
    columns = {"a": set(a.columns), "b": set(b.columns)}
    for text in equations.values():
        for side, name in NAME.findall(text):
            if name not in columns[side]:
                raise ValueError(f"{side} has no column {name}")
        if re.search(r"\$", NAME.sub("", text)):
            raise ValueError(f"unknown name in {text}")
    left = a.select("row_idx", *[F.col(c).cast("double").alias(f"a__{c}") for c in a.columns if c != "row_idx"])
    right = b.select("row_idx", *[F.col(c).cast("double").alias(f"b__{c}") for c in b.columns if c != "row_idx"])
    both = left.join(right, "row_idx", "full").fillna(0.0)
    return both.select("row_idx", *[checked(NAME.sub(r"\1__\2", text), set(both.columns) - {"row_idx"}).alias(name) for name, text in equations.items()])


def merge_frames(a: DataFrame, b: DataFrame, equations: dict[str, str]) -> DataFrame:
    """a's rows with the equations' columns added or replaced, then the rows that only b has."""
    done = operate_frames(a, b, equations)
    keep = [c for c in a.columns if c not in equations]
    return done.join(a.select(*keep), "row_idx", "left").select(*keep, *equations)


def frame_to_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(row_idx, name, value): every value of the columns, nulls left out."""
    return df.select("row_idx", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("row_idx", columns, "name", "value").filter("value is not null")


def long_to_frame(long: DataFrame, columns: list[str]) -> DataFrame:
    return long.groupBy("row_idx").pivot("name", columns).agg(F.first("value"))


def frame_profile(df: DataFrame, cells: str = "cells") -> DataFrame:
    """One row: rows, the most cells of a row, and whether the first row holds no number (or nothing), so that it is a header."""
    first = F.min_by(F.coalesce(F.forall(cells, lambda x: x.try_cast("double").isNull()), F.lit(True)), "row_idx")
    return df.agg(F.count("*").alias("n_rows"), F.max(F.size(cells)).alias("n_columns"), first.alias("has_header"))


def select_row(df: DataFrame, i: int) -> DataFrame:
    return df.filter(F.col("row_idx") == i)


def set_row(df: DataFrame, i: int, values: dict[str, object]) -> DataFrame:
    """The row i replaced, or added where there is none; columns without a value are null in it."""
    spark = df.sparkSession
    new = spark.range(1).select(F.lit(i).cast(df.schema["row_idx"].dataType).alias("row_idx"), *[F.lit(values.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns if c != "row_idx"])
    return df.filter(F.col("row_idx") != i).unionByName(new)


def set_column(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """The column replaced by values (row_idx, value), null where there is none; rows that are null throughout are dropped."""
    rest = [c for c in df.columns if c not in ("row_idx", name)]
    both = df.select("row_idx", *rest).join(values.select("row_idx", F.col("value").alias(name)), "row_idx", "full")
    return both.filter(F.coalesce(*[F.col(c).cast("string") for c in (*rest, name)]).isNotNull())


def range_select(cells: DataFrame, sheet: str, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """The cells (sheet, r, c, v) of a rectangle, both ends included."""
    return cells.filter((F.col("sheet") == sheet) & F.col("r").between(*rows) & F.col("c").between(*columns))


def range_series(cells: DataFrame, sheet: str, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """A rectangle as chart series (c, name, values): a column each, named by its top cell, the rest in row order."""
    held = range_select(cells, sheet, rows, columns)
    below = F.filter(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["r"] > rows[0])
    return held.groupBy("c").agg(F.max(F.when(F.col("r") == rows[0], F.col("v"))).alias("name"), F.transform(below, lambda x: x["v"]).alias("values"))


def coerce_cells(df: DataFrame, value: str = "v") -> DataFrame:
    """df with kind (empty, formula, number, text) and number."""
    v = F.col(value)
    number = F.trim(v).try_cast("double")
    kind = F.when(v.isNull() | (F.trim(v) == ""), "empty").when(F.startswith(v, F.lit("=")), "formula").when(number.isNotNull(), "number").otherwise("text")
    return df.withColumn("kind", kind).withColumn("number", F.when(F.col("kind") == "number", number))


def condition(column: Column, **spec) -> Column:
    """The predicate of a filter: eq, geq, greater, leq, less, range and not_range (lo, hi), on a value, or with the prefix
    ``cardinality_`` on the size of an array. All must hold; a null value meets none."""
    tests = {
        "eq": lambda c, v: c == v, "geq": lambda c, v: c >= v, "greater": lambda c, v: c > v, "leq": lambda c, v: c <= v,
        "less": lambda c, v: c < v, "range": lambda c, v: c.between(*v), "not_range": lambda c, v: ~c.between(*v),
    }
    out = F.lit(True)
    for name, wanted in spec.items():
        on = F.size(column) if name.startswith("cardinality_") else column
        out = out & tests[name.removeprefix("cardinality_")](on, wanted)
    return out


def filter_elements(df: DataFrame, column: str, in_set: DataFrame | None = None, index_in: list[int] | None = None, index_not_in: list[int] | None = None, **spec) -> DataFrame:
    """Rows that meet every condition; in_set: one column of allowed values; indexes: row_idx."""
    out = df.filter(condition(F.col(column), **spec))
    if index_in is not None:
        out = out.filter(F.col("row_idx").isin(index_in))
    if index_not_in is not None:
        out = out.filter(~F.col("row_idx").isin(index_not_in))
    if in_set is not None:
        out = out.join(in_set.select(F.col(in_set.columns[0]).alias(column)), column, "left_semi").select(*df.columns)
    return out


def rows_at_indexes(df: DataFrame, indexes: DataFrame) -> DataFrame:
    """The rows of listed indexes (row_idx), each once."""
    return df.join(indexes.select("row_idx"), "row_idx", "left_semi")


def grouped_lists(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, name, values): for each key and other column its values in row order; nulls stay out."""
    names = [c for c in df.columns if c not in (key, order)]
    long = df.select(key, order, *[F.col(c).cast("string").alias(c) for c in names]).unpivot([key, order], names, "name", "value")
    return long.groupBy(key, "name").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(order, "value")))), lambda x: x["value"]).alias("values"))


def csv_horizontal(df: DataFrame, key: str, order: str) -> DataFrame:
    """The transposed form: (name, values) for every column but the first, a value for each row, in row order."""
    names = [c for c in df.columns if c not in (key, order)]
    long = df.select(order, key, *[F.col(c).cast("string").alias(c) for c in names]).unpivot([order, key], names, "name", "value")
    return long.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, key, "value"))), lambda x: F.struct(x[key].alias("key"), x["value"].alias("value"))).alias("values"))


def year_columns(df: DataFrame, keys: list[str], bc_prefix: str = "bc_", ad_prefix: str = "ad_") -> DataFrame:
    """(keys, x, y): wide year columns as a long series, years before Christ negative; blanks are dropped."""
    form = re.compile(rf"(?:{re.escape(bc_prefix)}|{re.escape(ad_prefix)})\d+$", re.IGNORECASE)
    years = [c for c in df.columns if form.match(c)]
    long = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in years]).unpivot(keys, years, "name", "v")
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    before = F.startswith(F.lower("name"), F.lit(bc_prefix.lower()))
    return long.select(*keys, F.when(before, -number).otherwise(number).alias("x"), F.trim("v").try_cast("double").alias("y")).filter("y is not null")


def nested_series(df: DataFrame, text: str = "json", scalar: float = 1.0) -> DataFrame:
    """(zone, yr, target) from texts ``{zone: {"population": {year: number}}}``; broken texts and non-numbers are left out."""
    held = df.select(F.explode(F.from_json(text, "map<string,struct<population:map<string,string>>>")).alias("zone", "o"))
    long = held.select("zone", F.explode("o.population").alias("yr", "v"))
    return long.select("zone", F.col("yr").try_cast("int").alias("yr"), (F.col("v").try_cast("double") * scalar).alias("target")).filter("yr is not null and target is not null")


def merge_distinct(a: DataFrame, b: DataFrame, keys: list[str], values: str) -> DataFrame:
    """(keys, values): the distinct elements of both sides' arrays, a's first."""
    left = a.groupBy(*keys).agg(F.array_sort(F.collect_set(values)).alias("va"))
    right = b.groupBy(*keys).agg(F.array_sort(F.collect_set(values)).alias("vb"))
    none = F.array().cast(left.schema["va"].dataType)
    return left.join(right, keys, "full").select(*keys, F.array_union(F.coalesce("va", none), F.coalesce("vb", none)).alias(values))


def distinct_elements(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key's elements once; null counts as an element."""
    return df.select(*keys, value).distinct()


def merge_records(a: DataFrame, b: DataFrame, keys: list[str], value: str, overwrite: bool = False, must_differ: bool = False) -> DataFrame:
    """Records of both sides: values of both are added, or b's taken; with ``must_differ`` equal values are taken once."""
    both = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys, "full")
    together = F.col("vb") if overwrite else F.col("va") + F.col("vb")
    if must_differ:
        together = F.when(F.col("va") == F.col("vb"), F.col("va")).otherwise(together)
    met = F.col("va").isNotNull() & F.col("vb").isNotNull()
    return both.select(*keys, F.when(met, together).otherwise(F.coalesce("va", "vb")).alias(value))


def hybrid_refresh(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old records with the new record's values where it has any; new keys are left out."""
    names = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in names if c in new.columns])
    value = lambda c: F.coalesce(f"new_{c}", c).alias(c) if c in new.columns else F.col(c)
    return old.join(fresh, keys, "left").select(*keys, *map(value, names))


def worker_job_summary(jobs: DataFrame) -> DataFrame:
    """(worker, status, n, elapsed, last_done): jobs and their summed time by state; the last job that was done. jobs: (worker,
    job_id, status, started, ended)."""
    done = jobs.filter(F.col("status") == "done").groupBy("worker").agg(F.max_by("job_id", F.struct("ended", "job_id")).alias("last_done"))
    spent = F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    return jobs.groupBy("worker", "status").agg(F.count("*").alias("n"), F.sum(spent).alias("elapsed")).join(done, "worker", "left")


