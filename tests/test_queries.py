"""Every query against its SQL on the smallest tables."""

import math
import os
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from veldt import queries as core
from veldt import queries_more, queries_operators  # noqa: F401  (register more)
from veldt.functions import order


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return c


def rows(df):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return str(v) if isinstance(v, (str, bool)) or not hasattr(v, "__float__") else float(v)

    cols = sorted(df.columns)
    return sorted((tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, duck, sf, name):
    got = core.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("length", [1000, 1 << 20])
@pytest.mark.parametrize("name", ["j_replicate_pairs", "j_union_map"])
def test_runs_same_as_sql_on_odd_intervals(spark, tmp_path, monkeypatch, name, length):
    """Quantities in quarters, null quantities and parts, in one and in several stretches; no interval twice, so the SQL's order leaves nothing open."""
    monkeypatch.setattr(order, "STRETCH", length)
    rng, found = random.Random(3), {}
    for i in range(400):
        part, size = rng.randrange(100), None if rng.random() < 0.1 else rng.randrange(4, 240) / 4
        found[i % 3, part, size and round(size)] = (part, i % 3, rng.randrange(1, 8), size, rng.randrange(9) / 100)
    lines = [*found.values(), (None, 0, 1, 5.0, 0.5), (None, 1, 3, None, 0.5), (None, 41, 1, 5.0, 0.5)]
    c = duckdb.connect()
    c.execute("create table lineitem (l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double, l_tax double)")
    c.executemany("insert into lineitem values (?, ?, ?, ?, ?)", lines)
    c.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    got, want = rows(core.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(c.sql(core.SQL[name]).df())
    assert want and got == want


@pytest.mark.parametrize("name", ["j_replicate_pairs", "j_union_map"])
def test_runs_same_as_sql_at_both_ends_of_long(spark, tmp_path, name):
    """Starts so far apart that their difference is no long; no interval twice."""
    far = (1 << 63) // 37 - 200
    lines = [(side * far + i // 6, i % 2, 1 + i // 2 % 3, 20.0 + i, i / 100) for side in (-1, 1) for i in range(24)]
    c = duckdb.connect()
    c.execute("create table lineitem (l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double, l_tax double)")
    c.executemany("insert into lineitem values (?, ?, ?, ?, ?)", lines)
    c.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    got, want = core.QUERIES[name](spark, str(tmp_path)).collect(), c.execute(core.SQL[name]).fetchall()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["q_group_summary_with_null_groups", "w_bh_pooled", "w_merge_runs", "j_overlap_half_open", "m_moderated", "v_nearest"])
def test_same_rows_however_partitioned(spark, sf, name, monkeypatch):
    want = rows(core.QUERIES[name](spark, sf).toPandas())
    read = core.t
    for n in (1, 3, 17):
        monkeypatch.setattr(core, "t", lambda s, f, x, n=n: read(s, f, x).repartition(n))
        assert rows(core.QUERIES[name](spark, sf).toPandas()) == want


def test_headline_filters_reach_the_scan(spark, sf):
    plan = core.q_plan_revenue_by_segment(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
