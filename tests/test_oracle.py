"""Registered queries against their SQL at the smallest scale, with hot keys split.

``TAPELOOM_ALL=1`` runs every query; the default is a cross-section.
"""

import glob
import os

import duckdb
import pytest
from check_oracle import compare, rows_of

from tapeloom.plans import ORACLES, QUERIES
from tapeloom.session import BLOCK_ROWS_CONF

SOME = """evaluation_report prediction_match lag_diff bollinger_bands ema rolling_correlation triple_barrier purged_folds news_sequence
    calendar_events clean_trades tail_risk stress_scenarios threshold_table pareto_front shadow_accuracy population_stability kolmogorov_smirnov
    cusum correlation_edges entity_graph_features logistic_score strategy_expression stream_regimes stream_truth_join""".split()
NAMES = sorted(ORACLES) if os.environ.get("TAPELOOM_ALL") else SOME


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, duck, name):
    spark.conf.set(BLOCK_ROWS_CONF, "60")
    try:
        df = QUERIES[name](spark, folder)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)
    cur = duck.execute(ORACLES[name])
    assert compare(got, rows_of([d[0] for d in cur.description], cur.fetchall())) is None


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
