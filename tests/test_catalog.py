"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

from check import TABLES, compare
from conftest import FOLDER

SAMPLE = ("src_01", "src_07", "fil_14", "fil_17", "joi_07", "joi_09", "agg_06", "agg_13", "win_03", "win_10", "win_14", "win_17",
          "win_23", "top_04", "set_04", "fun_01", "fun_19", "mrg_03", "str_04", "str_06", "sig_03", "sig_06", "dis_04", "dis_06",
          "fyr_07", "war_07", "bkt_03", "bkt_05", "bkt_14", "udx_03", "udx_04")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    from barograph import catalog

    ok, note, _ = compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], FOLDER)
    assert ok, note


@pytest.mark.parametrize("name", ["bkt_03_industry", "bkt_03_overfit", "bkt_08_series", "bkt_11_all", "bkt_13_total"])
def test_whole_evaluations_match_sql(spark, con, name):
    from barograph import catalog

    ok, note, _ = compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], FOLDER)
    assert ok, note


def test_all_configurations_have_a_row(spark):
    from barograph import catalog
    from barograph.catalog.ledgers import CONFIGS
    from barograph.plans import backtests as B

    assert [c.id for c in CONFIGS] == [c.id for c in B.PAIR_CONFIGS]
    assert [(c.no_overlap, c.dedup) for c in CONFIGS] == [(c.no_overlap, c.dedup) for c in B.PAIR_CONFIGS]
    got = catalog.queries()["bkt_11_all"](spark, FOLDER).collect()
    assert {r["config"] for r in got} == {c.id for c in (*B.PAIR_CONFIGS, *B.FACTOR_CONFIGS)} and len(got) == 21


def test_every_query_has_sql_or_reason():
    from barograph import catalog

    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"dis_05", "agg_17", "bkt_12"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["symbol", "date", "score", "name", "industry"]


@pytest.mark.parametrize("name", ["win_09", "sig_04", "sig_05", "joi_07", "fyr_02", "war_07", "str_06", "agg_13"])
def test_plan_stays_native(spark, name):
    """No Python stage and no cartesian or nested-loop product of tables."""
    from barograph import catalog

    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Arrow", "Pandas", "CartesianProduct"):
        assert word not in plan
