"""Every registered query against its SQL, and what its plan must not hold."""

import re

import pytest
from oracle import compare, connect

from brushwork.operators import profile, ranks
from brushwork.plans import oracle_sql, queries
from brushwork.plans.data import load


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, sf, name):
    result = compare(spark, con, sf, name)
    assert result["status"] in ("ok", "rows-only"), result["status"]
    if name not in ("drift",):
        assert result["rows"] > 0


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["cx", "cy", "zmax", "top", "mean_intensity", "n"]
    assert entry.queries().keys() >= entry.oracle_sql().keys()


LAZY = ["top_cells", "pyramid_levels", "density_2d", "crossfilter_hist", "lasso_hist", "soft_hist", "soft_lasso", "cube_soft", "hillshade",
        "local_origin", "zoom_quarter", "highlight", "rate_series", "lens_mole", "stack_shares", "profile", "similarity_fit", "timebox"]


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join_and_no_python(spark, sf, name):
    df = queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan


def scan_filters(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line[line.index("PushedFilters:"):] for line in text.splitlines() if "PushedFilters:" in line]


def test_ranges_reach_the_scan(spark, sf):
    for name, needle in (("map_window", "GreaterThanOrEqual(l_extendedprice,30000.0)"), ("lasso_hist", "GreaterThanOrEqual(l_extendedprice,"),
                         ("js_filter", "LessThan(value,20.0)")):
        assert any(needle in f for f in scan_filters(queries()[name](spark, sf))), name


def test_a_threshold_from_the_data_reaches_the_scan(spark, sf):
    df = profile.highlight(load(spark, sf, "lineitem"), "l_extendedprice")
    assert any("GreaterThan(l_extendedprice,ScalarSubquery" in f for f in scan_filters(df))


def test_a_brush_on_cells_reaches_the_scan(spark, sf):
    df = queries()["crossfilter_hist"](spark, sf)
    assert any("GreaterThanOrEqual(l_quantity," in f for f in scan_filters(df))


def test_scans_read_only_needed_columns(spark, sf):
    text = queries()["density_2d"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in text


def test_a_dashboard_scans_its_rows_once(spark, sf):
    plan = queries()["crossfilter_hist"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_lowest_rows_are_not_sorted_whole(spark, sf):
    """Most of the first 3000 rows come by a threshold; a sort sees the rows near it alone."""
    rows = load(spark, sf, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    low = ranks.lowest(rows, rows.columns, 3001, edge_rows=200)
    plan = low._jdf.queryExecution().optimizedPlan().toString()
    assert [int(n) <= 200 for n in re.findall(r"GlobalLimit (\d+)", plan)] == [True] and low.count() == 3001


def test_sql_semantics_keeps_the_sign_of_zero(spark, con, tmp_path):
    """Values around zero at every remainder of the id, compared as text: -0 is not 0 there."""
    con.execute(f"""COPY (SELECT event_id + 84 * v AS event_id, ts, user_id, event_type, CAST([-0.0, 0.0, 0.3, 0.5, 2.5] AS DOUBLE[])[v + 1] AS value, props
        FROM (FROM events WHERE event_id < 84) e, (SELECT unnest(range(5)) AS v) t) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE OR REPLACE TEMP VIEW zeros AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    cur = con.execute(oracle_sql()["sql_semantics"].replace("FROM events)", "FROM zeros)", 1))
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    got = queries()["sql_semantics"](spark, str(tmp_path)).select(*names).collect()
    assert len(want) == 420 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
