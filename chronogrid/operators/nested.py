"""Values within values, to any depth: JSON objects level by level, and typed arrays and maps by their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructType

from chronogrid.shared import materialise


def walk(df: DataFrame, text_col: str, id_col: str, exclude: list[str] | None = None, max_depth: int = 1000) -> DataFrame:
    """(id, path array, kind, value): every key of every JSON object within an object, at any depth, with its value as JSON text.

    kind is object, array, string, boolean, null or number. Arrays are values, their elements aren't walked. Keys to
    exclude are left out with all that lies under them. Texts that aren't objects, and unreadable ones, have no rows. There is a
    pass over what is left for each level of the deepest object, whatever the number of rows.
    """
    spark = df.sparkSession
    text = F.trim(F.col(text_col))
    level = df.select(F.col(id_col).alias("id"), F.array().cast("array<string>").alias("path"), text.alias("value")).filter(F.startswith("value", F.lit("{")))
    first = F.substring("value", 1, 1)
    kinds = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    found = None
    for _ in range(max_depth):
        step = spark.sql("SELECT t.id, array_append(t.path, k.key) AS path, k.key AS key, to_json(k.value) AS value FROM {level} AS t, LATERAL variant_explode(try_parse_json(t.value)) AS k", level=level)
        if exclude:
            step = step.filter(~F.col("key").isin(exclude))
        step = materialise(step.select("id", "path", kinds.alias("kind"), "value"))
        found = step if found is None else found.unionAll(step)
        level = step.filter("kind = 'object'").select("id", "path", "value")
        if level.isEmpty():
            return found.withColumnRenamed("id", id_col)
    raise RuntimeError(f"objects lie deeper than {max_depth}")


def json_paths(df: DataFrame, text_col: str, id_col: str, objects_only: bool = False, exclude: list[str] | None = None) -> DataFrame:
    """(id, path, depth): the keys of a JSON object at every depth, with dots between them; only those of objects on request."""
    held = walk(df, text_col, id_col, exclude)
    if objects_only:
        held = held.filter("kind = 'object'")
    return held.select(id_col, F.array_join("path", ".").alias("path"), F.size("path").alias("depth"))


def json_depth(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, depth): how many objects lie within one another; 0 for texts that are no object."""
    deepest = walk(df, text_col, id_col).groupBy(id_col).agg(F.max(F.size("path")).alias("depth"))
    return df.select(id_col).distinct().join(deepest, id_col, "left").select(id_col, F.coalesce("depth", F.lit(0)).alias("depth"))


def value_at(text: Column, path: str) -> Column:
    """The value at a dotted path, as text (JSON for objects and arrays); null where there is none."""
    for step in path.split("."):
        text = F.try_element_at(F.from_json(text, "map<string,string>"), F.lit(step))
    return text


def flatten_sum(df: DataFrame, text_col: str = "json") -> DataFrame:
    """(leaf, total): the numbers of JSON objects at every depth by their innermost name, equal names added over all rows.
    Texts that read as numbers count as such."""
    leaves = walk(df.withColumn("row_of_text", F.lit(0)), text_col, "row_of_text").filter("kind in ('number', 'string')")
    number = F.trim(F.when(F.col("kind") == "string", F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")).otherwise(F.col("value"))).try_cast("double")
    held = leaves.select(F.element_at("path", -1).alias("leaf"), number.alias("v")).filter("v is not null")
    return held.groupBy("leaf").agg(F.sum("v").alias("total"))


def leaves(column: Column, kind: DataType) -> Column:
    """The innermost values of arrays, maps and structs, in order, as one array; null containers have none."""
    if isinstance(kind, ArrayType):
        inner = column if not isinstance(kind.elementType, (ArrayType, MapType, StructType)) else F.flatten(F.transform(column, lambda x: leaves(x, kind.elementType)))
    elif isinstance(kind, MapType):
        return leaves(F.map_values(column), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        inner = F.when(column.isNotNull(), F.concat(*[leaves(column[f.name], f.dataType) for f in kind.fields]))
    else:
        return F.array(column)
    return F.coalesce(inner, F.array().cast(ArrayType(leaf_type(kind))))


def leaf_type(kind: DataType) -> DataType:
    if isinstance(kind, ArrayType):
        return leaf_type(kind.elementType)
    if isinstance(kind, MapType):
        return leaf_type(kind.valueType)
    return leaf_type(kind.fields[0].dataType) if isinstance(kind, StructType) else kind


def cardinality(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, n): the innermost elements of arrays and maps of any depth; null is 0."""
    return df.select(*keys, F.size(leaves(F.col(column), df.schema[column].dataType)).alias("n"))


def filter_substring(df: DataFrame, column: str, part: str) -> DataFrame:
    """df with only those texts of nested arrays, flattened, that contain the part; empty rows go."""
    kept = F.filter(leaves(F.col(column), df.schema[column].dataType), lambda x: F.contains(x, F.lit(part)))
    return df.withColumn(column, kept).filter(F.size(column) > 0)


def nested_extrema(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, low, high, total, mean) of the numbers of nested arrays and maps; rows without a number have no row."""
    held = df.select(*keys, F.explode(leaves(F.col(column), df.schema[column].dataType)).alias("v"))
    number = F.col("v").cast("double")
    return held.filter("v is not null").groupBy(*keys).agg(F.min(number).alias("low"), F.max(number).alias("high"), F.sum(number).alias("total"), F.avg(number).alias("mean"))


def cleaned(column: Column, kind: DataType, remove_falsey: bool = False) -> Column:
    """Nested arrays and maps without their null values, or also without those that are empty, 0 or false. What is left empty by
    that stays as an empty array or map."""
    if isinstance(kind, MapType):
        inner = F.transform_values(column, lambda _, v: cleaned(v, kind.valueType, remove_falsey))
        return F.map_filter(inner, lambda _, v: kept(v, kind.valueType, remove_falsey))
    if isinstance(kind, ArrayType):
        inner = F.transform(column, lambda v: cleaned(v, kind.elementType, remove_falsey))
        return F.filter(inner, lambda v: kept(v, kind.elementType, remove_falsey))
    return column


def kept(value: Column, kind: DataType, remove_falsey: bool) -> Column:
    there = value.isNotNull()
    if not remove_falsey:
        return there
    if isinstance(kind, StringType):
        return there & ~value.isin("", "0", "0.0", "false", "NaN")
    if isinstance(kind, NumericType):
        return there & (value != 0) & ~F.isnan(value.cast("double"))
    return there & value if isinstance(kind, BooleanType) else there


def clean(df: DataFrame, column: str, remove_falsey: bool = False) -> DataFrame:
    """A map or array, however deep, without its null values, or also without those that are empty, 0 or false."""
    return df.withColumn(column, cleaned(F.col(column), df.schema[column].dataType, remove_falsey))
