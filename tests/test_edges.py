"""Every query with an oracle over empty tables, and over tables with nulls in every column, repeated rows and ties."""

from __future__ import annotations

import glob
import os

import pytest

from chronogrid.plans import registry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
#: Keys that the derived tables take for granted, as a warehouse would: never null here.
KEYS = {"l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "o_orderkey", "o_custkey", "o_orderdate", "c_custkey", "c_nationkey", "s_suppkey", "s_nationkey", "p_partkey", "p_size", "n_nationkey", "n_regionkey", "event_id", "user_id", "ts", "doc_id", "page_id"}
KEYED = {"region", "nation", "customer", "supplier", "part", "events", "pages", "documents"}
#: Oracles whose form does not hold at an edge, and what the operator does there.
OTHERWISE = {
    ("odd", "cardinality"): "null parts count 0", ("odd", "clean"): "null sizes are dropped", ("odd", "fx_string"): "joined texts are null",
    ("odd", "geometry_events"): "a null source is passed over in the id", ("odd", "html_table_cells"): "a null name makes no row of the page",
    ("odd", "parse_census_table"): "as html_table_cells", ("odd", "pipe_census_text"): "a country without a name has no towns", ("odd", "most_populous_match"): "a null query matches nothing",
    ("odd", "populstat_fields"): "a null value has no names", ("odd", "read_csv_grouped"): "a column of nulls has an empty list",
    ("odd", "read_entity_log"): "a null line is left out", ("odd", "ridge_fit"): "rows with a null label are left out too",
    ("empty", "ridge_fit"): "all 0", ("empty", "condition_number"): "0", ("empty", "drop_high_vif"): "nothing is dropped",
}


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """Folders of the tables without rows, and of few rows beside copies of them with nulls and without."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = {k: tmp_path_factory.mktemp(k) for k in ("empty", "odd")}
    for path in glob.glob(f"{SF}/*.parquet"):
        name, table = os.path.basename(path), pq.read_table(path)
        pq.write_table(table.slice(0, 0), out["empty"] / name)
        few, holes = table.slice(0, 400), table.slice(0, 40)
        for i, field in enumerate(holes.schema):
            if field.name not in KEYS:
                holes = holes.set_column(i, field, pa.nulls(len(holes), field.type))
        # rows repeat where no column names them; else the rows with nulls stand for those without
        parts = [few.slice(40), holes] if name.split(".")[0] in KEYED else [few, holes, few.slice(5, 20)]
        pq.write_table(pa.concat_tables(parts), out["odd"] / name)
    return {k: str(v) for k, v in out.items()}


@pytest.mark.parametrize("kind", ["empty", "odd"])
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_edges(spark, folders, kind, name):
    got = registry.queries()[name](spark, folders[kind]).toPandas()
    if name in registry.oracle_sql() and (kind, name) not in OTHERWISE:
        want = connect(folders[kind]).execute(registry.oracle_sql()[name]).fetchdf()
        assert difference(got, want) is None
