"""Classes of cells as regions: nearest seeds, connected parts, border rings, interior points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronogrid.graph import connected_components, least_on_cycles, steps_to_end
from chronogrid.shared import materialise

#: A cell's four sides: its neighbour's offset, and the side as a unit edge with the cell on its right.
SIDES = ((-1, 0, (0, 0, 1, 0)), (1, 0, (1, 1, 0, 1)), (0, -1, (0, 1, 0, 0)), (0, 1, (1, 0, 1, 1)))


def _envelope(rows: list[int], gaps: list[int]) -> tuple[list[int], list[int]]:
    """Of parabolas gap + (x - row)^2, by row, those that are lowest somewhere: their places in the list and from which x on.
    Where two are equal the lower row's is the lowest."""
    held, start, tops = [], [], []
    for i, (q, f) in enumerate(zip(rows, gaps, strict=True)):
        top, at = f + q * q, None
        while held:
            at = (top - tops[-1]) // (2 * (q - rows[held[-1]])) + 1
            if len(held) > 1 and at <= start[-1]:
                held.pop(), start.pop(), tops.pop()
                continue
            break
        held.append(i)
        start.append(-(1 << 62) if at is None else at)
        tops.append(top)
    return held, start


def _columns(keys: list[str], left: bool):
    """Rows come sorted by (keys, c, r): of each column the nearest source of every row that asks, with what either carries. ``left``:
    rows without a source carry their own as the source's."""
    by = [*keys, "c"]

    def solve(c: int, rows: np.ndarray, sc: np.ndarray, told: np.ndarray) -> np.ndarray:
        """The places of the sources in the column."""
        own = np.flatnonzero(told)
        held, start = _envelope(rows[own].tolist(), ((sc[own].astype(np.int64) - c) ** 2).tolist())
        return own[np.array(held)[np.searchsorted(start, rows[~told], "right") - 1]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def given() -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True)
            r, c, sc = pdf["r"].to_numpy(), pdf["c"].to_numpy(), pdf["sc"].to_numpy(dtype=float, na_value=np.nan)
            told, new = ~np.isnan(sc), np.zeros(len(pdf), dtype=bool)
            for k in by:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            cuts = np.r_[0, np.flatnonzero(new), len(pdf)]
            src = np.full(len(pdf), -1, dtype=np.int64)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if told[lo:hi].any() and not told[lo:hi].all():
                    src[lo + np.flatnonzero(~told[lo:hi])] = lo + solve(int(c[lo]), r[lo:hi], sc[lo:hi], told[lo:hi])
            found = np.flatnonzero(~told & (src >= 0))
            if left:
                found = np.flatnonzero(~told)
                src = np.where(src < 0, np.arange(len(pdf)), src)
            src, at = src[found], np.where(told, sc, c).astype(np.int64)
            out = pdf.iloc[found].reset_index(drop=True)
            out["sr"], out["sc"], out["sv"] = r[src], at[src], pdf["v"].take(src).to_numpy()
            out["d2"] = (out["r"] - out["sr"]) ** 2 + (out["c"] - out["sc"]) ** 2
            return out[[*keys, "r", "c", "v", "sr", "sc", "sv", "d2"]]

        for pdf in batches:
            if pdf.empty:
                continue
            last = (pdf[by] == pdf[by].iloc[-1]).all(axis=1).to_numpy()
            if not last.all() or (held and (held[-1][by].iloc[-1] != pdf[by].iloc[-1]).any()):
                held.append(pdf[~last])
                yield given()
                held = []
            held.append(pdf[last])
        if held:
            yield given()

    return run


def _parts(df: DataFrame) -> int:
    """Parts for a grid's rows or columns: the session's, or sixteen a core. Cells are so few bytes in a shuffle that the engine would join
    their parts until a task sorts millions of them."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)


def _nearest(asked: DataFrame, seeds: DataFrame, keys: list[str], left: bool = False) -> DataFrame:
    """Each row asked (keys, r, c, v) with sr, sc, sv and d2 of nearest_seeds(), sv being that seed's v; ``left``: without one the row's own v."""
    place = [F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")]
    rows = asked.select(*keys, *place, "v")
    bounds = rows.groupBy(*keys).agg(F.min("c").alias("c0"), F.max("c").alias("c1"))
    line = Window.partitionBy(*keys, "r").orderBy("sc", "v")
    n = _parts(asked)
    # a seed that repeats is nearest to no column, or to those of one side
    own = seeds.select(*keys, *place, "v").withColumnRenamed("c", "sc").repartition(n, *keys, "r")
    own = own.select("*", (F.shiftright(F.lag("sc").over(line) + F.col("sc"), 1) + 1).alias("lo"), F.shiftright(F.col("sc") + F.lead("sc").over(line), 1).alias("hi"))
    own = own.join(bounds, keys) if keys else own.crossJoin(F.broadcast(bounds))  # one row of bounds
    own = own.withColumn("lo", F.greatest("lo", "c0")).withColumn("hi", F.least("hi", "c1")).filter("lo <= hi")
    sources = own.select(*keys, "r", F.explode(F.sequence("lo", "hi")).alias("c"), "sc", "v")
    both = sources.unionByName(rows.withColumn("sc", F.lit(None).cast("long")))
    kinds = "".join(f"{k} {asked.schema[k].dataType.simpleString()}, " for k in keys)
    kind = asked.schema["v"].dataType.simpleString()
    dealt = both.repartition(n, *keys, "c").sortWithinPartitions(*keys, "c", "r")
    return dealt.mapInPandas(_columns(keys, left), f"{kinds}r long, c long, v {kind}, sr long, sc long, sv {kind}, d2 long")


def nearest_seeds(asked: DataFrame, seeds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """asked (keys, r, c) with sr, sc and d2 of the nearest seed (keys, r, c) by the exact straight distance: the lowest row,
    then column, of equally near ones. Without a seed there is no row.

    The transform is separable. In a row the neighbouring seeds bound the columns that a seed is nearest to; those columns are
    its rows then. In a column the squared gaps to those are parabolas, and their lower envelope tells the nearest of each cell.
    Rows are as many as the grid's cells between the seeds' rows and the asked columns (for each key), whatever lies in them; the
    largest group is one row of seeds, or one column.
    """
    keys = keys or []
    none = F.lit(0).alias("v")
    return _nearest(asked.select(*keys, "r", "c").distinct().select("*", none), seeds.select(*keys, "r", "c", none), keys).drop("v", "sv")


def nearest_seed_fill(cells: DataFrame, bins: list[int], ignored: list[int]) -> DataFrame:
    """cells (r, c, zone), a class each: cells of the ``bins`` classes take the class of the nearest cell of a class that is neither a
    bin nor ignored; all others stay, and are not dealt. Without such a cell they stay too."""
    open_ = F.col("zone").isin(bins)
    valued = cells.select("r", "c", F.col("zone").alias("v"), "zone")
    near = _nearest(valued.filter(open_), valued.filter(~open_ & ~F.col("zone").isin(ignored)), [], left=True)
    kinds = {n: cells.schema[n].dataType for n in "rc"}
    filled = near.select(*[F.col(n).cast(kinds[n]).alias(n) for n in "rc"], F.col("sv").alias("zone"))
    return cells.filter(~F.coalesce(open_, F.lit(False))).select("r", "c", "zone").unionAll(filled)


def _sides(cells: DataFrame, overlapping: bool = False) -> DataFrame:
    """(the cells' columns, o): those sides o of cells that lie against another class or nothing."""
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.lit(v).alias(n) for n, v in zip(("a", "b", "p", "q"), e, strict=True)]) for i, j, e in SIDES])
    asks = cells.select("*", F.explode(sides).alias("o")).withColumn("nr", F.col("r") + F.col("o.i")).withColumn("nc", F.col("c") + F.col("o.j"))
    there = cells.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("zone").alias("other"))
    if overlapping:
        there = there.withColumn("zone", F.col("other"))
        return asks.join(there, ["nr", "nc", "zone"], "left").filter("other is null").drop("nr", "nc", "other")
    return asks.join(there, ["nr", "nc"], "left").filter("other is null or other <> zone").drop("nr", "nc", "other")


def _border(cells: DataFrame, overlapping: bool) -> DataFrame:
    """Cells with a side against another class or nothing: a cell's neighbours are told along its row, then along its column."""
    keys, n, held = ["zone"] if overlapping else [], _parts(cells), cells.select("r", "c", "zone").withColumn("edge", F.lit(False))
    for along, over in ("rc", "cr"):
        line = Window.partitionBy(*keys, along).orderBy(over)
        edge = F.col("edge")
        for d in (-1, 1):
            beside = line.rangeBetween(d, d)
            low, high = F.min("zone").over(beside), F.max("zone").over(beside)
            edge = edge | low.isNull() | F.coalesce((low != F.col("zone")) | (high != F.col("zone")), F.lit(False))
        held = held.repartition(n, *keys, along).withColumn("edge", edge)
    return held.filter("edge").select("zone", "r", "c")


def directed_edges(cells: DataFrame) -> DataFrame:
    """(zone, x1, y1, x2, y2): the unit sides of each class's cells against another class or nothing, with the class on the
    right of the way. Cells meet their four neighbours by one equi join."""
    return _sides(cells.select("r", "c", "zone")).select("zone", (F.col("c") + F.col("o.a")).alias("x1"), (F.col("r") + F.col("o.b")).alias("y1"), (F.col("c") + F.col("o.p")).alias("x2"), (F.col("r") + F.col("o.q")).alias("y2"))


def cell_parts(cells: DataFrame) -> DataFrame:
    """cells (r, c, zone) with part: cells of a class that hang together by their sides have the same, row << 32 plus column of
    the first of them by row and column.

    Runs of cells along a row are found by windows; runs above one another hang together where two cells do, and the runs are
    labelled. Nothing is grouped by class, and a row of a class is the largest window.
    """
    line = Window.partitionBy("zone", "r").orderBy("c")
    first = F.when(F.coalesce(F.col("c") - F.lag("c").over(line) > 1, F.lit(True)), F.col("c"))
    runs = cells.select("r", "c", "zone").distinct().withColumn("first", first)
    runs = runs.withColumn("run", F.shiftleft(F.col("r").cast("long"), 32) + F.max("first").over(line)).drop("first")
    # classes may share a cell, so a run is numbered together with its class
    numbers = materialise(runs.select("zone", "run").distinct().withColumn("id", F.monotonically_increasing_id()))
    held = materialise(runs.join(numbers, ["zone", "run"]))
    above = held.select((F.col("r") + 1).alias("r"), "c", "zone", F.col("id").alias("b"))
    links = held.join(above, ["r", "c", "zone"]).select(F.col("id").alias("a"), "b").distinct()
    parts = numbers.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left")
    parts = parts.select("id", "run", F.coalesce("component", "id").alias("component"))
    first = parts.groupBy("component").agg(F.min("run").alias("part"))
    return held.join(parts.join(first, "component").select("id", "part"), "id").select("r", "c", "zone", "part")


def largest_parts(cells: DataFrame) -> DataFrame:
    """Of every class's cells (r, c, zone) those of its part with the most cells, the first one of equally large parts."""
    told = materialise(cell_parts(cells))
    sizes = told.groupBy("zone", "part").agg(F.count("*").alias("n"))
    best = sizes.groupBy("zone").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("part"))
    return told.join(best, ["zone", "part"], "left_semi").select("r", "c", "zone")


def interior_pole(cells: DataFrame, largest: bool = True, overlapping: bool = False) -> DataFrame:
    """(zone, r, c, d2): of each class's largest part (or of all its cells) the cell farthest from the class's border cells,
    those with a side against another class or nothing; the first by row, then column, of equally far ones.

    Where a cell has one class, the nearest border cell of any class is as near as that of its own, since a straight way to
    another class's border crosses the own border before; so one transform serves all classes. ``overlapping`` classes have
    one each, within the columns of their own cells.
    """
    border = _border(cells, overlapping).withColumn("v", F.col("zone"))
    asked = (largest_parts(cells) if largest else cells).select("zone", "r", "c", F.col("zone").alias("v"))
    far = _nearest(asked, border, ["zone"]) if overlapping else _nearest(asked, border, []).withColumnRenamed("v", "zone")
    best = far.groupBy("zone").agg(F.max(F.struct("d2", (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("m"))
    kinds = {n: cells.schema[n].dataType for n in "rc"}
    return best.select("zone", *[(-F.col(f"m.{n}")).cast(kinds[n]).alias(n) for n in "rc"], F.col("m.d2").alias("d2"))


def region_rings(cells: DataFrame) -> DataFrame:
    """(zone, part, ring, seq, x, y): the closed border rings of each class's cells (r, c, zone), by unit points, part by part.

    Parts hang together by sides and are numbered by their first cell. Ring 0 is a part's outer border, with the part on
    the right of the way; further rings are its holes, which go the other way. A ring starts at its first side by row and
    column, and its last point is its first. At a corner where two cells of a class meet, the way stays with its cell.

    A side's successor is one of at most two others. Rings are found and their sides put in order by pointer doubling: as many
    joins as the longest ring's length has binary digits, whatever number of sides a class has.
    """
    told = _sides(cell_parts(cells)).select(
        "zone", "part", (F.col("c") + F.col("o.a")).cast("long").alias("x"), (F.col("r") + F.col("o.b")).cast("long").alias("y"), (F.col("o.p") - F.col("o.a")).alias("dx"), (F.col("o.q") - F.col("o.b")).alias("dy")
    )
    # from east clockwise, so that a turn to the right is one more
    heading = F.when(F.col("dx") == 1, 0).when(F.col("dy") == 1, 1).when(F.col("dx") == -1, 2).otherwise(3)
    told = told.withColumn("to", heading)
    held = materialise(told.withColumn("id", F.monotonically_increasing_id()))
    onward = held.select("zone", "part", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("to").alias("turned"), F.col("id").alias("next"))
    ways = held.select("zone", "part", "id", "to", (F.col("x") + F.col("dx")).alias("nx"), (F.col("y") + F.col("dy")).alias("ny")).join(onward, ["zone", "part", "nx", "ny"])
    turn = F.pmod(F.col("turned") - F.col("to") - 1, F.lit(4))  # right, straight on, (back,) left
    links = materialise(ways.groupBy("id").agg(F.min_by("next", turn).alias("ptr")))
    # a ring is told by its first side by row, column and heading, which the ring's number stands for
    order = held.select("id", F.struct("y", "x", "to").alias("at"))
    rings = materialise(least_on_cycles(links))
    first = order.join(rings, "id").groupBy("low").agg(F.min_by("id", "at").alias("first"))
    cut = links.join(first.select(F.col("first").alias("id"), F.lit(True).alias("ends")), "id", "left").select("id", F.when(F.col("ends").isNull(), F.col("ptr")).alias("ptr"))
    steps = held.join(steps_to_end(cut).withColumnRenamed("end", "first"), "id")
    cross = F.col("x") * (F.col("y") + F.col("dy")) - (F.col("x") + F.col("dx")) * F.col("y")
    steps = materialise(steps.select("zone", "part", "first", "x", "y", "steps", cross.alias("cross"), F.struct("y", "x", "to").alias("at")))
    shapes = steps.groupBy("zone", "part", "first").agg(F.count("*").alias("n"), F.sum("cross").alias("area"), F.min("at").alias("at"))
    within = Window.partitionBy("zone", "part").orderBy((F.col("area") < 0).cast("int"), "at")
    shapes = shapes.withColumn("ring", F.row_number().over(within) - 1)
    parts = shapes.select("zone", "part").distinct().withColumn("number", F.row_number().over(Window.partitionBy("zone").orderBy("part")) - 1)
    numbered = steps.join(shapes.select("first", "n", "ring"), "first").join(parts, ["zone", "part"])
    # the first side starts the ring, and its start ends it
    seq = F.explode(F.when(F.col("steps") == 0, F.array(F.lit(0).cast("long"), F.col("n"))).otherwise(F.array(F.col("n") - F.col("steps"))))
    out = numbered.select("zone", F.col("number").alias("part"), "ring", seq.alias("seq"), "x", "y")
    return out.select("zone", *[F.col(c).cast("int").alias(c) for c in ("part", "ring", "seq", "x", "y")])
