"""Connected components and pointer doubling, for tables of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.shared import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected edges (a long, b long); component is the smallest node reachable.

    Alternates large-star and small-star; each round is a grouping and a join on the node, and is written to the
    shared folder. Nodes without an edge to another node are not in the result. Null ends are ignored.
    """
    pairs = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").dropna().distinct()
    )
    sign = None
    for _ in range(max_rounds):
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionAll(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        pairs = materialise(small.distinct())
        row = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row["n"], row["x"]) == sign:
            break
        sign = (row["n"], row["x"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def least_on_cycles(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, low) where low is the least id on id's cycle. links: (id, ptr), every id on a cycle of one ptr each.

    A round looks twice as far as the one before; when a round lowers nothing, every window of that length tells the same
    as the next one, and so as its whole cycle.
    """
    held = materialise(links.select("id", "ptr", F.col("id").alias("low")))
    for _ in range(max_rounds):
        ahead = held.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("other"))
        held = materialise(held.join(ahead, "ptr").select("id", F.col("next").alias("ptr"), F.least("low", "other").alias("low"), (F.col("other") < F.col("low")).alias("changed")))
        if held.filter("changed").isEmpty():
            return held.select("id", "low")
    raise RuntimeError(f"cycles of over 2^{max_rounds} links")


def steps_to_end(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, end, steps) from every id along ptr to the id whose ptr is null. links: (id, ptr), without cycles. Log-many joins
    in the longest way."""
    held = materialise(links.select("id", "ptr", F.coalesce("ptr", "id").alias("end"), F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    for _ in range(max_rounds):
        if held.filter("ptr is not null").isEmpty():
            return held.select("id", "end", "steps")
        ahead = held.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("end").alias("last"), F.col("steps").alias("more"))
        told = held.join(ahead, "ptr", "left")
        held = materialise(told.select("id", F.col("next").alias("ptr"), F.coalesce("last", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    raise RuntimeError(f"ways of over 2^{max_rounds} links")
