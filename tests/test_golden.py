"""Small literal cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import formula as FM
from tapeloom.functions import scalar as S
from tapeloom.operators import audits as A
from tapeloom.operators import classify as C
from tapeloom.operators import thresholds as TH
from tapeloom.operators import joins as J
from tapeloom.operators import labels as L
from tapeloom.operators import matching as M
from tapeloom.operators import quality as Q
from tapeloom.operators import risk as R


def test_one_trade_two_predictions(spark):
    log = spark.createDataFrame(
        [(5, "OPEN", 1, "EURUSD", 0, 0.0), (60, "CLOSE", 1, "EURUSD", 0, 10.0)],
        "event_time long, action string, ticket long, symbol string, order_type int, profit double",
    )
    trades = M.pair_open_close(log, "ticket", "event_time", ["symbol", "order_type"]).withColumns(
        {"direction": F.lit(1), "decision_id": F.lit(None).cast("long")}
    )
    preds = spark.createDataFrame(
        [(1, 0, "EURUSD", 1, 0.9), (2, 86400, "EURUSD", 1, 0.1)], "pred_id long, timestamp long, symbol string, direction int, probability double"
    ).withColumn("decision_id", F.lit(None).cast("long"))
    matched = M.match_predictions(preds, trades, 60)
    counts = C.confusion(matched, trades).first()
    assert (counts["matched_events"], counts["accuracy"], counts["precision"], counts["recall"]) == (1, 0.5, 0.5, 1.0)
    won = matched.filter("is_match")
    p = R.grouped(won, [], R.profit_columns(F.col("profit")) | R.ratio_columns(F.col("profit"))).first()
    assert p["profit_factor"] == float("inf")
    assert (p["expectancy"], p["expected_return"], p["downside_risk"], p["risk_reward"]) == (10, 10, 0, 10)
    assert (p["sharpe_ratio"], p["sortino_ratio"]) == (0, 0)
    tail = R.tail_risk(won, [], "profit").first()
    assert (tail["var_95"], tail["es_95"], tail["cvar"]) == (10, 10, 10)
    a = C.auc(M.score_vector(matched, trades)).first()
    assert (a["roc_auc"], a["pr_auc"]) == (1.0, 1.0)
    assert a["brier_score"] == pytest.approx(0.01)


def test_contested_ticket_goes_to_the_earliest_prediction(spark):
    trades = spark.createDataFrame(
        [(7, "X", 1, 100, 200, 1.0, 0, None), (8, "X", 1, 130, 300, 2.0, 0, None)],
        "ticket long, symbol string, direction int, open_time long, close_time long, profit double, order_type int, decision_id long",
    )
    preds = spark.createDataFrame(
        [(1, 90, "X", 1, 0.5, None), (2, 95, "X", 1, 0.5, None), (3, 120, "X", 1, 0.5, None)],
        "pred_id long, timestamp long, symbol string, direction int, probability double, decision_id long",
    )
    got = {r["pred_id"]: r["ticket"] for r in M.match_predictions(preds, trades, 60).collect()}
    assert got == {1: 7, 2: None, 3: 8}


def test_close_consumes_the_latest_open(spark):
    rows = [(1, "OPEN", 1), (2, "OPEN", 1), (3, "CLOSE", 1), (4, "CLOSE", 1), (5, "OPEN", 1), (6, "CLOSE", 1)]
    log = spark.createDataFrame([(t, a, k, float(t)) for t, a, k in rows], "event_time long, action string, ticket long, profit double")
    got = sorted((r["open_time"], r["close_time"]) for r in M.pair_open_close(log, "ticket", "event_time", []).collect())
    assert got == [(2, 3), (5, 6)]


def test_model_audit(spark):
    d = spark.createDataFrame(
        [(1, "buy", 0.8, 0, 1), (1, "shadow", 0.3, 1, 0), (2, "sell", 0.2, 0, 1), (2, "shadow", 0.7, 1, 0)],
        "decision_id long, action string, probability double, model_idx int, chosen int",
    )
    t = spark.createDataFrame([(1, 10.0), (2, -5.0)], "decision_id long, profit double")
    got = {(r["model_idx"], r["role"]): r for r in A.model_audit(d, t).collect()}
    assert got[0, "chosen"]["profit"] == 5.0 and got[0, "chosen"]["win_rate"] == 0.5
    assert got[1, "shadow"]["profit"] == -5.0


def test_shadow_accuracy(spark):
    d = spark.createDataFrame([(1, "shadow", 0, 0.4), (2, "buy", 0, 0.7)], "decision_id long, action string, executed_model_idx int, probability double")
    t = spark.createDataFrame([(1, 10.0), (2, -5.0)], "decision_id long, profit double")
    assert A.shadow_accuracy(d, t).first()[0] == 1.0


def test_entity_graph(spark):
    v = [("SYM", "symbol", None), ("COMP", "entity", None), ("SEC", "sector", None), ("A1", "article", 0.1)]
    e = [("SYM", "COMP"), ("COMP", "SEC"), ("A1", "COMP")]

    def run():
        return J.entity_paths(spark.createDataFrame(v, "id string, type string, sentiment double"), spark.createDataFrame(e, "src string, dst string")).first()

    one = run()
    assert (one["graph_article_count"], one["graph_sentiment"]) == (1, pytest.approx(0.1))
    v += [("COMP2", "entity", None), ("A2", "article", 0.6)]
    e += [("COMP2", "SEC"), ("A2", "COMP2")]
    two = run()
    assert (two["graph_article_count"], two["graph_sentiment"]) == (2, pytest.approx(0.35))


@pytest.mark.parametrize(
    "rows, broken",
    [
        ([(1, 1, 0), (2, None, 1)], "event_time not null"),
        ([(1, 1, 0), (2, 2, 24)], "hour in 0..23"),
        ([(1, 2, 1), (2, 1, 0)], "event_time increasing"),
    ],
)
def test_expectations(spark, rows, broken):
    df = spark.createDataFrame(rows, "src long, event_time long, hour int")
    assert {r["rule"] for r in Q.expectations(df, ["src"]).collect() if r["failed"]} == {broken}


def test_calendar_picks_the_first_event_with_the_largest_impact(spark):
    cal = spark.createDataFrame([(100, 2.0, 3), (130, 2.0, 5), (400, 0.0, 9), (131, 1.0, 6)], "time long, impact double, id long")
    rows = spark.createDataFrame([(t, t) for t in (39, 40, 110, 160, 161, 190, 191, 192, 340, 460, 461)], "rid long, t long")
    got = {r["t"]: (r["event_flag"], r["event_impact"], r["calendar_event_id"]) for r in J.calendar_join(rows, cal, "t", "rid", 60).collect()}
    events = [(100, 2.0, 3), (130, 2.0, 5), (131, 1.0, 6), (400, 0.0, 9)]
    for t, have in got.items():
        flag, impact, ident = 0.0, 0.0, 0
        for et, imp, i in events:
            if abs(t - et) <= 60:
                flag = 1.0
                if imp > impact:
                    impact, ident = imp, i
        assert have == (flag, impact, ident), t


def test_triple_barrier_against_a_loop(spark, small_blocks):
    rng = np.random.default_rng(0)
    price = np.round(100 + rng.normal(0, 1, 60).cumsum(), 2)
    df = spark.createDataFrame([("s", i, float(p), 0.8) for i, p in enumerate(price)], "symbol string, t long, price double, spread double")
    got = {r["t"]: r for r in L.triple_barrier(df, ["symbol"], ["t"], "price", "spread", 6, 1.0, 1.0).collect()}
    for i, p in enumerate(price):
        ahead = price[i + 1 : i + 7]
        tp = next((j + 1 for j, v in enumerate(ahead) if v >= p + 0.8), len(ahead) + 1)
        sl = next((j + 1 for j, v in enumerate(ahead) if v <= p - 0.8), len(ahead) + 1)
        assert (got[i]["tp_time"], got[i]["sl_time"]) == (tp, sl)
        assert got[i]["meta_label"] == float(tp <= sl and tp <= len(ahead))


def test_formula_rejects_anything_not_listed():
    with pytest.raises(ValueError):
        FM.formula_column("__import__('os')", ["a"])
    with pytest.raises(ValueError):
        FM.formula_column("a.b", ["a"])


def test_candidate_thinning_matches_even_spacing(spark):
    df = spark.createDataFrame([(i / 2000.0,) for i in range(2000)], "p double")
    got = sorted(r[0] for r in TH.threshold_candidates(df, "p", most=512).collect())
    full = np.unique(np.concatenate([np.arange(2000) / 2000.0, [0.0, 0.5, 1.0]]))
    want = full[np.linspace(0, len(full) - 1, 512, dtype=int)]
    assert got == pytest.approx(sorted(want))


def test_json_vector_and_fills(spark):
    df = spark.createDataFrame([("[1, 2]",), ("bad",), ("[1, null, 3, 4]",)], "t string")
    assert [r[0] for r in df.select(S.json_vector("t", 3)).collect()] == [[1, 2, 0], [0, 0, 0], [1, 0, 3]]


def test_quarantine_reasons(spark):
    rows = [
        (1, "1", "2024.01.01 00:00", "open", "5", "EUR", "1", "2.0"),
        (2, "1", "2024.01.01 00:00", "open", "5", "EUR", "1", "2.0"),
        (3, "3", "2024.01.01 00:00", "close", "", "EUR", "1", "2.0"),
        (4, "4", "2024.01.01 00:00", "close", "6", "EUR", "-1", "2.0"),
        (5, "5", "2024.01.01 00:00", "hold", "6", "EUR", "1", "2.0"),
        (6, "6", "soon", "close", "6", "EUR", "1", "2.0"),
    ]
    df = spark.createDataFrame(rows, "src long, event_id string, event_time string, action string, ticket string, symbol string, lots string, price string")
    clean, bad = Q.clean_trades(df, "src")
    assert [r["src"] for r in clean.collect()] == [1]
    assert {r["src"]: r["reject_reason"] for r in bad.collect()} == {
        2: "duplicate event_id", 3: "missing ticket or action", 4: "negative lots or no price", 6: "row does not fit the trade schema"
    }


def test_incremental_mark_and_schema_checked_append(spark, tmp_path):
    from tapeloom.sources import writers as Wr

    df = spark.range(10).withColumnRenamed("id", "event_id")
    mark = str(tmp_path / "mark")
    assert Wr.newer_than_mark(df, mark).count() == 10
    Wr.store_mark(df.filter("event_id < 4"), mark)
    assert Wr.newer_than_mark(df, mark).count() == 6
    with pytest.raises(ValueError):
        Wr.append_checked(df, spark.range(1).schema, str(tmp_path / "t"))
