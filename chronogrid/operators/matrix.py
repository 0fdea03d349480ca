"""Large matrices as (i, j, v) and weighted graphs as (src, dst, cost)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogrid.shared import materialise


def matrix_add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    return a.unionAll(b.select("i", "j", (F.col("v") * sign).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def matrix_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matrix_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("p"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("q"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("v"))


def matrix_augment(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """b to the right of a, which is ``width`` columns wide."""
    return a.select("i", "j", "v").unionAll(b.select("i", (F.col("j") + width).alias("j"), "v"))


def shortest_costs(edges: DataFrame, source: int, max_rounds: int = 1000) -> DataFrame:
    """(node, cost, before) of all nodes reachable from source over undirected edges; before is the smallest neighbour on a
    cheapest way, null for the source.

    Each round relaxes the edges of the nodes that the last one made cheaper and writes those that get cheaper again; costs
    found so far are compacted when eight rounds have been added.
    """
    both = materialise(edges.select("src", "dst", "cost").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")))
    kind = edges.schema["src"].dataType.simpleString()
    fresh = edges.sparkSession.createDataFrame([(source, 0.0, None)], f"node {kind}, cost double, before {kind}")
    parts = [fresh]

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node").agg(F.min(F.struct("cost", "before")).alias("m")).select("node", "m.cost", "m.before")

    def known() -> DataFrame:
        return best(reduce(DataFrame.unionAll, parts))

    for _ in range(max_rounds):
        step = fresh.select(F.col("node").alias("src"), F.col("cost").alias("sofar")).join(both, "src")
        step = best(step.select(F.col("dst").alias("node"), (F.col("sofar") + F.col("cost")).alias("cost"), F.col("src").alias("before")))
        old = known().select("node", F.struct("cost", "before").alias("old"))
        better = F.col("old").isNull() | (F.col("cost") < F.col("old.cost")) | ((F.col("cost") == F.col("old.cost")) & (F.col("before") < F.col("old.before")))
        improved = materialise(step.join(old, "node", "left").filter(better).select("node", "cost", "before", F.coalesce(F.col("cost") < F.col("old.cost"), F.lit(True)).alias("cheaper")))
        if improved.isEmpty():
            return known()
        parts.append(improved.select("node", "cost", "before"))
        if len(parts) > 8:
            parts[:] = [materialise(known())]
        fresh = improved.filter("cheaper").select("node", "cost", "before")
    raise RuntimeError(f"costs did not settle in {max_rounds} rounds")


def shortest_path(edges: DataFrame, source: int, target: int, max_rounds: int = 1000) -> DataFrame:
    """(step, node, cost): the nodes of a cheapest way from source to target; of equal ones that through smaller nodes, seen from
    the target. No row if there is none. The way back takes as many joins as its length has binary digits."""
    costs = materialise(shortest_costs(edges, source, max_rounds))
    # each round the table of ways back is joined with itself and reaches twice as far, and so do the nodes found
    jumps = costs.select("node", F.col("before").alias("to")).filter("to is not null")
    found = materialise(costs.filter(F.col("node") == target).select("node", F.lit(0).cast("long").alias("back")))
    far = 1
    while True:
        new = materialise(found.join(jumps, "node").select(F.col("to").alias("node"), (F.col("back") + far).alias("back")))
        if new.isEmpty():
            break
        found = found.unionAll(new)
        ahead = jumps.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jumps = materialise(jumps.join(ahead, "to").select("node", F.col("further").alias("to")))
        far *= 2
    whole = found.agg(F.max("back").alias("length"))
    way = found.join(costs.select("node", "cost"), "node").crossJoin(whole)  # one row
    return way.select((F.col("length") - F.col("back")).cast("int").alias("step"), "node", "cost")
