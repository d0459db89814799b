import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, distribution, nullmodels, signals, splits, temporal
from tidemark.schema import PanelError


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("symbol", "timestamp").select(*columns).collect()]


def test_universe(spark, bars, day):
    df = bars({"A": [1.0] * 5, "B": [1.0] * 2})
    spans = spark.createDataFrame([("A", day(1), day(2)), ("A", day(2), day(2)), ("A", day(4), None)], "symbol string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    got = temporal.universe_membership(df, spans)
    assert [r[0] == "in_universe" for r in rows(got, temporal.STATUS)] == [False, True, True, False, True, False, False]
    assert {r[0] for r in rows(temporal.universe_membership(df, None), temporal.STATUS)} == {"no_universe_data"}
    for bad in ([("A", day(2), day(1))], [("A", None, day(1))]):
        with pytest.raises(PanelError):
            temporal.universe_membership(df, spark.createDataFrame(bad, spans.schema))


def test_identity(spark, bars, day):
    df = bars({"A": [1.0] * 3, "B": [1.0]})
    spans = spark.createDataFrame([("P2", "A", day(1), None), ("P1", "A", day(1), day(1)), ("P0", "A", day(2), None)], "permanent_id string, symbol string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    assert rows(temporal.resolve_identity(df, spans), "permanent_id") == [("A",), ("P1",), ("P2",), ("B",)]
    assert rows(temporal.resolve_identity(df, None), "permanent_id")[-1] == ("B",)


def test_as_of(spark, bars, day):
    df = bars({"A": [1.0] * 6, "B": [1.0]})
    facts = spark.createDataFrame([("A", day(1), 10.0, 1), ("A", day(3), None, 2), ("A", day(4), 7.0, 3), ("A", day(4), 8.0, 4), ("Z", day(0), 5.0, 5)], "symbol string, available_at timestamp_ntz, v double, seq int")
    got = temporal.as_of(df, facts, ["v"], sequence="seq")
    assert rows(got, "v") == [(None,), (10.0,), (10.0,), (None,), (8.0,), (8.0,), (None,)]
    assert got.columns == [*df.columns, "v"]
    assert temporal.as_of_coverage(got, ["v", "w"])["columns"] == {"v": {"present": True, "matched": 4, "unmatched": 3}, "w": {"present": False}}
    assert rows(temporal.as_of(df, facts, ["v"], keep_time=True), "available_at")[1] == (day(1),)
    assert rows(temporal.as_of(df, facts.drop("available_at"), ["v"], fail_open=True), "v") == [(None,)] * 7
    for broken in (lambda: temporal.as_of(df, facts, []), lambda: temporal.as_of(df, facts.drop("available_at"), ["v"]), lambda: temporal.as_of(df, facts.withColumn("available_at", F.lit(None).cast("timestamp_ntz")), ["v"])):
        with pytest.raises(PanelError):
            broken()


def test_distribution(spark, day):
    values = [0.0, 1.0, 2.0, 3.0, 4.0, None, float("nan"), float("inf")]
    df = spark.createDataFrame([("A" if i < 4 else "B", day(20 * i), v) for i, v in enumerate(values)], "symbol string, timestamp timestamp_ntz, x double")
    got = distribution.distribution(df, "x", extreme=3.0).first()
    assert (got["n_total"], got["n_valid"], got["n_null"], got["n_non_finite"], got["n_extreme"]) == (8, 5, 1, 2, 1)
    assert (got["p01"], got["p50"], got["mean"], got["null_pct"]) == pytest.approx((0.04, 2.0, 2.0, 12.5))
    assert distribution.by_symbol(df, "x").count() == 2
    assert {r["level"] for r in distribution.grouping_sets(df, "x").collect()} == {"all", "symbol", "month"}
    single = distribution.distribution(df.limit(1), "x").first()
    assert single["std"] is None
    nulls = {r["column_name"]: r for r in distribution.null_matrix(df, ["x"], F.col("symbol") == "B").collect()}
    assert nulls["x"]["null_count"] == 1 and nulls["x"]["eligible_null_fraction"] == 0.25
    assert distribution.null_matrix(df.where("false"), ["x"]).first()["null_fraction"] == 0.0


def test_split(bars):
    df = bars({"A": [1.0] * 20, "B": [1.0] * 20}).select("symbol", "timestamp")
    assigned, b = splits.temporal_split(df, max_horizon=3, embargo=5)
    assert (b.train_end, b.validation_end) == (12, 16)
    got = [r[0] for r in assigned.where("symbol = 'A'").orderBy("timestamp").select("split").collect()]
    assert got == ["train"] * 7 + ["embargoed"] * 2 + ["purged"] * 3 + ["validation"] * 4 + ["test"] * 4
    splits.assert_split(df, assigned, b)
    summary = splits.split_summary(df, b)
    assert summary["purged"] == 3 and summary["embargoed"] == 2 and summary["parts"]["test"]["timestamps"] == 4
    with pytest.raises(PanelError):
        splits.assert_split(df, assigned.withColumn("split", F.when(F.col("split") == "purged", "train").otherwise(F.col("split"))), b)
    default = splits.boundaries(20, max_horizon=3)
    assert default.embargo == 3  # every row within the embargo is then already purged
    for broken in (dict(n=2, max_horizon=1), dict(n=9, max_horizon=0), dict(n=9, max_horizon=1, train_fraction=0.9)):
        with pytest.raises(PanelError):
            splits.boundaries(**broken)


def test_backtest_by_hand(bars):
    df = bars({"A": [100.0, 110, 121]}).withColumn("weight", F.lit(1.0))
    got = backtest.run_backtest(df, cost_model=backtest.CostModel(slippage_bps=100))
    curve = got.periods.orderBy("timestamp").collect()
    assert [r["gross_return"] for r in curve] == pytest.approx([0.1, 0.1])
    assert [r["cost"] for r in curve] == pytest.approx([0.01, 0.0])
    assert [r["equity"] for r in curve] == pytest.approx([1.09, 1.09 * 1.1])
    assert got.metrics["total_return"] == pytest.approx(1.09 * 1.1 - 1) and got.metrics["n_periods"] == 2
    assert got.metrics["sortino"] == 0.0 and got.metrics["annual_turnover"] == pytest.approx(126)


def test_turnover_skips_rows_without_outcome(bars):
    df = bars({"A": [100.0, 100, 100, 100]}).withColumn("weight", F.when(F.col("volume") == 1001, 5.0).otherwise(1.0))
    scored = backtest.with_outcome(df).withColumn("forward_return", F.when(F.col("volume") != 1001, F.col("forward_return")))
    assert [r[0] for r in backtest.realised(scored).orderBy("timestamp").select("turnover").collect()] == [1.0, 0.0]


def test_drawdown_starts_at_first_equity(bars):
    df = bars({"A": [100.0, 50, 75]}).withColumn("weight", F.lit(1.0))
    got = backtest.run_backtest(df)
    assert got.metrics["max_drawdown"] == 0.0 and got.metrics["total_return"] == pytest.approx(-0.25)
    ruin = backtest.run_backtest(bars({"A": [100.0, 50, 25]}).withColumn("weight", F.lit(4.0)))
    assert ruin.metrics["cagr"] == -1.0 or math.isfinite(ruin.metrics["cagr"])
    with pytest.raises(PanelError):
        backtest.run_backtest(bars({"A": [1.0]}).withColumn("weight", F.lit(1.0)))
    with pytest.raises(PanelError):
        backtest.run_backtest(df.withColumn("weight", F.lit(float("nan"))))


def test_costs(tmp_path):
    path = tmp_path / "costs.yaml"
    path.write_text("commission_bps: 1\nslippage_bps_daily: 5\nslippage_bps_stress_5x: 25\n")
    assert backtest.load_costs(str(path)).rate == pytest.approx(0.0006)
    assert backtest.load_costs(str(path), "5x").rate == pytest.approx(0.0026)
    for stress in ("2x", "9x"):
        with pytest.raises(PanelError):
            backtest.load_costs(str(path), stress)


def test_battery(bars):
    price, closes = 100.0, []
    for i in range(60):
        price *= (1.03, 0.98, 1.05, 0.97, 1.04, 0.96)[i % 6]
        closes.append(price)
    df = bars({"A": closes, "B": closes[::-1]}).withColumn("weight", F.lit(1.0))
    got = nullmodels.run_battery(df, seed=3, cost_model=backtest.CostModel(slippage_bps=5))
    assert got.future_leak_detected and set(got.metrics) == set(nullmodels.VARIANTS)
    totals = [got.metrics[v]["total_return"] for v in ("baseline", "cost_stress_2x", "cost_stress_5x")]
    assert totals == sorted(totals, reverse=True)
    again = nullmodels.run_battery(df.repartition(7), seed=3, cost_model=backtest.CostModel(slippage_bps=5))
    assert again.metrics["random_weights"]["sharpe"] == pytest.approx(got.metrics["random_weights"]["sharpe"])


def test_shuffle_is_a_permutation(bars):
    df = bars({"A": [1.0] * 30, "B": [1.0] * 30}).withColumn("weight", F.col("volume").cast("double"))
    got = nullmodels.shuffled_weights(df, 1)
    assert sorted(r["weight"] for r in got.collect()) == sorted(r["weight"] for r in df.collect())
    assert rows(got, "weight") != rows(df, "weight") and rows(got, "weight") == rows(nullmodels.shuffled_weights(df.repartition(5), 1), "weight")
    assert rows(nullmodels.shifted_weights(df, 2), "weight")[:3] == [(0.0,), (0.0,), (1000.0,)]
    for broken in (lambda: nullmodels.shifted_weights(df, 0), lambda: nullmodels.random_weights(df, 1, 1.0, 0.0)):
        with pytest.raises(PanelError):
            broken()


MESSAGE = dict(schema_version="1.1.0", signal_id="s", valid_until="2024-01-02T00:00:00Z", mode="paper", rebalance_type="target_weight", backtest_run_id="r", data_declaration_id="d", approval_required=True, approval_status="approved", targets=[dict(symbol="A", target_weight=0.5)], metadata=dict(target_gross_exposure=0.5, target_net_exposure=-0.2))


@pytest.mark.parametrize(
    "change,limits,reason",
    [
        ({}, {}, None),
        ({"signal_id": ""}, {}, "missing_signal_id"),
        ({"valid_until": None}, {}, "missing_valid_until"),
        ({"schema_version": "x"}, {}, "invalid_schema_version"),
        ({"schema_version": "2.0"}, {}, "unsupported_schema_major"),
        ({"valid_until": "2023-12-31T00:00:00Z"}, {}, "expired"),
        ({"valid_until": "2024-01-01T00:00:00Z"}, {}, None),
        ({"mode": "live"}, {}, "mode_mismatch"),
        ({"mode": "live"}, {"mode": "live"}, "live_not_allowed"),
        ({"mode": "live"}, {"mode": "live", "allow_live": True}, None),
        ({}, {"max_gross": 0.4}, "gross_exposure"),
        ({}, {"max_net": 0.1}, "net_exposure"),
        ({"approval_status": "pending"}, {}, "approval_missing"),
        ({"approval_status": "pending", "rebalance_type": "reduce_only"}, {}, None),
    ],
)
def test_signals(spark, change, limits, reason):
    import json

    raw = spark.createDataFrame([(json.dumps(MESSAGE | change),)], "value string")
    parsed = signals.parse(raw)
    now = F.expr("timestamp'2024-01-01 00:00:00'")
    assert signals.validate(parsed, now, signals.Limits(**limits)).first()["rejection_reason"] == reason


def test_orders_positions_boot(spark):
    import json

    parsed = signals.parse(spark.createDataFrame([(json.dumps(MESSAGE),)], "value string"))
    assert signals.orders(parsed).first()["client_order_id"] == "s:A"
    held = spark.createDataFrame([("A", 10.0, 5.0)], "symbol string, qty double, avg_price double")
    wanted = spark.createDataFrame([("A",), ("B",)], "symbol string")
    assert {r[0]: r[1] for r in signals.position_weights(wanted, held, F.lit(100.0)).collect()} == {"A": 0.5, "B": 0.0}
    assert signals.position_weights(wanted, held, F.lit(0.0)).agg(F.max("current_weight")).first()[0] == 0.0
    signals.check_boot("paper", False, False)
    signals.check_boot("live", True, True)
    for flags in ((False, True), (True, False)):
        with pytest.raises(PanelError):
            signals.check_boot("live", *flags)


def test_an_embargo_below_the_horizon_is_refused(bars):
    df = bars({"A": [1.0] * 20}).select("symbol", "timestamp")
    for embargo in (0, 2, True, 2.5):
        with pytest.raises(PanelError):
            splits.temporal_split(df, max_horizon=3, embargo=embargo)
    assigned, b = splits.temporal_split(df, max_horizon=3)
    with pytest.raises(PanelError):
        splits.assert_split(df, assigned, splits.Boundaries(b.n, b.train_end, b.validation_end, 3, 1))


def test_stress_is_on_slippage_alone(bars, tmp_path):
    path = tmp_path / "costs.yaml"
    path.write_text("commission_bps: 4\nslippage_bps_daily: 5\nslippage_bps_stress_2x: 11\nslippage_bps_stress_5x: 30\n")
    assert backtest.CostModel(4, 5).stressed(2) == backtest.CostModel(4, 10)
    df = bars({"A": [100.0, 101, 99, 104, 103]}).withColumn("weight", F.when(F.col("volume") % 2 == 0, 1.0).otherwise(-1.0))
    for stress, want in ((None, [9, 14, 29]), (backtest.load_stress(str(path)), [9, 15, 34])):
        rows = nullmodels.traded(df, seed=1, cost_model=backtest.load_costs(str(path)), stress=stress).groupBy("variant").agg((F.sum("cost") / F.sum("turnover") * 1e4).alias("bps")).collect()
        got = {r["variant"]: r["bps"] for r in rows}
        assert [got[v] for v in ("baseline", "cost_stress_2x", "cost_stress_5x")] == pytest.approx(want) and got["random_weights"] == pytest.approx(9)
    report = nullmodels.run_battery(df, seed=5, cost_model=backtest.CostModel())
    assert (report.seed, report.metrics["random_weights"]["seed"], report.metrics["shuffled_weights"]["seed"]) == (5, 5, 6)


def test_results_hold_no_forbidden_names(bars):
    from tidemark.plans.dataset import research_dataset

    df = bars({"A": [1.0, 2.0]})
    for name in ("y", "side", "qty", "quantity", "label", "target"):
        with pytest.raises(PanelError):
            research_dataset(df.withColumn(name, F.lit(1)), df.select("symbol", "timestamp", F.lit(1.0).alias("f")), feature_columns=["f"])
    assert set(backtest.FORBIDDEN) == {"signal", "alpha", "prediction", "target", "order", "trade"}
