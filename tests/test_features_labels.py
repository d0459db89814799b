import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import features, labels
from tidemark.schema import PanelError


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "timestamp").collect()]


def test_returns(bars):
    df = bars({"A": [100.0, 110, 99], "B": [50.0, 25]}).withColumns({"d": features.daily_return(), "l": features.log_return()})
    assert column(df, "d") == pytest.approx([None, 0.1, -0.1, None, -0.5], abs=1e-12)
    assert column(df, "l")[1] == pytest.approx(math.log(1.1))


def test_windows_need_all_values(bars):
    closes = [100.0 * (1.01 if i % 2 else 0.99) ** i for i in range(25)]
    made = features.with_features(bars({"A": closes}), "set")
    got = made.orderBy("timestamp").collect()
    assert [r["rolling_vol_20d"] is None for r in got] == [True] * 20 + [False] * 5
    assert [r["sma_5d"] is None for r in got] == [True] * 4 + [False] * 21
    assert got[6]["sma_5d"] == pytest.approx(sum(closes[2:7]) / 5)
    q = 1 - 2 / 6
    weights = [q ** (9 - i) for i in range(10)]
    assert got[9]["ema_5d"] == pytest.approx(sum(w * c for w, c in zip(weights, closes)) / sum(weights))
    assert got[3]["ema_5d"] is None and got[0]["feature_set_id"] == "set"
    for broken in (lambda: features.sma(0), lambda: features.rolling_volatility(1), lambda: features.sma(True)):
        with pytest.raises(PanelError):
            broken()


def test_one_exchange_for_all_windows(bars):
    df = bars({"A": [1.0, 2.0]})
    df = df.withColumns({"daily_return": features.daily_return(), "log_return": features.log_return()})
    df = df.withColumns({"v": features.rolling_volatility(20), "s": features.sma(5), "u": features.rolling_volume(20)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 1e4), min_size=26, max_size=30), st.integers(21, 25), st.floats(1, 1e4))
def test_the_future_never_matters(bars, closes, cut, other):
    """Changing rows after the cut leaves features up to it as they were."""
    changed = closes[:cut] + [other] * (len(closes) - cut)
    one, two = (features.with_features(bars({"A": c})).orderBy("timestamp").limit(cut).drop("open", "high", "low", "close", "vwap").collect() for c in (closes, changed))
    assert one == two


def test_labels_and_reasons(bars):
    df = bars({"A": [100.0, 110, 120, 132]})
    made = labels.with_labels(df, 2)
    assert column(made, "label_forward_return_2d") == pytest.approx([0.2, 0.2, None, None])
    assert column(made, labels.REASON) == [None, None, "insufficient_future_rows", "insufficient_future_rows"]
    holes = df.withColumn("close", F.when(F.col("close") != 110.0, F.col("close")))
    made = labels.with_labels(holes, 1, strict=False)
    assert column(made, labels.REASON) == ["future_price_null", "source_price_null", None, "insufficient_future_rows"]
    labels.assert_ledger(made, "label_forward_return_1d")
    with pytest.raises(PanelError):
        labels.assert_ledger(made.withColumn(labels.REASON, F.lit("x")), "label_forward_return_1d")
    got = {r[labels.REASON]: r["n"] for r in labels.count_by(made, labels.REASON).collect()}
    assert got == {"future_price_null": 1, "source_price_null": 1, "insufficient_future_rows": 1, "UNSPECIFIED": 1}
    summary = labels.label_summary(made, "label_forward_return_1d").first()
    assert (summary["n_rows"], summary["n_labelled"], summary["n_null"]) == (4, 1, 3)


def test_label_names_and_inputs(bars):
    assert labels.label_name(5) == "label_forward_return_5d" and labels.label_name(1, " y ") == "y"
    for h, name in ((0, None), (True, None), (1, " "), (1, "close")):
        with pytest.raises(PanelError):
            labels.label_name(h, name)
    df = bars({"A": [1.0, 2.0]})
    for broken in (df.withColumn("label_x", F.lit(1)), df.withColumn("signal", F.lit(1)), df.withColumn("close", F.lit(0.0)), df.withColumn("close", F.lit(float("inf")))):
        with pytest.raises(PanelError):
            labels.with_labels(broken, 1)


@pytest.mark.parametrize("n", [1, 2, 5, 20])
def test_exponential_means_equal_pandas(spark, day, n):
    """Over several blocks, with values missing at the start, at a block's end and in between, for two symbols at once."""
    import random

    import pandas as pd

    r, series = random.Random(n), {}
    for symbol, length in (("A", 900), ("B", 7)):
        series[symbol] = [None if r.random() < 0.1 or (i in (0, 399, 400, 38, 39)) else r.uniform(1, 200) for i in range(length)]
    rows = [(s, day(i), x) for s, values in series.items() for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, close double").repartition(5)
    got = {(x["symbol"], x["timestamp"]): x[f"ema_{n}d"] for x in features.with_ema(df, (n,)).collect()}
    for s, values in series.items():
        want = pd.Series(values, dtype=float).ewm(span=n, adjust=True, min_periods=n).mean()
        for i, (x, w) in enumerate(zip(values, want)):
            assert got[s, day(i)] == (None if x is None or pd.isna(w) else pytest.approx(w, rel=1e-12))


def test_reserved_names(bars):
    for name in ("target", "weight", "qty", "target_null_reason"):
        with pytest.raises(PanelError):
            labels.label_name(1, name)
    for column in ("side", "quantity", "label", "target_x"):
        with pytest.raises(PanelError):
            labels.with_labels(bars({"A": [1.0, 2.0]}).withColumn(column, F.lit(1)), 1)


def test_feature_sets_of_a_file(spark, bars, tmp_path):
    path = str(tmp_path / "bars.parquet")
    bars({"A": [100.0 + i for i in range(30)], "B": [1.0] * 30}).write.parquet(path)
    known = features.build_pit_feature_set(spark, path, " a ", as_of="2024-01-25")
    whole = features.build_feature_set(spark, path, "A")
    assert known.count() == 25 and whole.count() == 30 and known.select("feature_set_id").distinct().count() == 1
    key = lambda df: {(r["timestamp"], r["sma_20d"], r["ema_20d"]) for r in df.collect()}
    assert key(known) <= key(whole)
    for broken in (lambda: features.build_feature_set(spark, path, "C"), lambda: features.build_feature_set(spark, str(tmp_path / "none"), "A")):
        with pytest.raises(PanelError):
            broken()
