"""The year files of pipe_urban_union: two that share years of a city, with every figure in them."""

from __future__ import annotations

import datetime
import glob
import os
from collections import Counter

import pytest

from chronogrid.operators import tables
from chronogrid.plans import jobs
from chronogrid.sources.views import oracle
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def early(tmp_path_factory):
    """The tables with orders before Christ and before the files' first column, and shipments of years that both files have."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path_factory.mktemp("early")
    years = {"orders": ("o_orderdate", (1796, 1990, 1992, 1994, 1996)), "lineitem": ("l_shipdate", (1992, 1993, 1994, 1997))}
    for path in glob.glob(f"{SF}/*.parquet"):
        name, table = os.path.basename(path), pq.read_table(path)
        if name[:-8] in years:
            column, held = years[name[:-8]]
            dates = pa.array([datetime.datetime(held[i % len(held)], 5, 1) for i in range(len(table))]).cast(table.schema.field(column).type)
            table = table.set_column(table.schema.get_field_index(column), table.schema.field(column), dates)
        pq.write_table(table, folder / name)
    return str(folder)


def _long(spark, folder):
    return tables.year_columns(jobs._year_files(spark, folder), ["file", "series_id", "line"]).collect()


def test_two_files_share_cities_and_years(spark):
    of = {i: {(r["series_id"], r["x"]) for r in _long(spark, SF) if r["file"] == i} for i in (0, 1)}
    assert of[0] and of[1] and of[0] & of[1]
    # the pooled figure is neither file's own
    con = connect(SF)
    pooled = con.execute(oracle(f"SELECT series_id, y FROM ({jobs.POOLED}) WHERE x = 1990")).fetchall()
    own = Counter(con.execute(oracle(f"SELECT series_id, y FROM ({jobs.URBAN}) WHERE x = 1990")).fetchall())
    assert any((i, y) not in own for i, y in pooled)


@pytest.mark.parametrize("repeated", [False, True])
def test_files_hold_every_figure(spark, early, tmp_path, repeated):
    folder = early
    if repeated:
        import pyarrow as pa
        import pyarrow.parquet as pq

        folder = str(tmp_path)
        for path in glob.glob(f"{early}/*.parquet"):
            table = pq.read_table(path)
            if path.endswith("/customer.parquet"):
                # cities that stand in two nations, so with two figures a year
                other = table.slice(0, 30)
                nation = table.column("c_nationkey").slice(1, 30)
                table = pa.concat_tables([table, other.set_column(table.schema.get_field_index("c_nationkey"), table.schema.field("c_nationkey"), nation)])
            pq.write_table(table, f"{folder}/{os.path.basename(path)}")
    want = Counter(connect(folder).execute(oracle(f"SELECT series_id, x, y FROM ({jobs.URBAN})")).fetchall())
    got = Counter((r["series_id"], r["x"], r["y"]) for r in _long(spark, folder))
    assert got == want and min(x for _, x, _ in got) < 0


def test_figures_of_both_files_are_pooled(spark, early):
    got = jobs.pipe_urban_union(spark, early).toPandas()
    want = connect(early).execute(jobs.ORACLES["pipe_urban_union"]).fetchdf()
    assert difference(got, want) is None
