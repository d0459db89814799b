"""Vector backtest of given weights with linear costs.

``periods`` serves any number of variants at once: the columns in ``by`` name a variant, and every window
and aggregate is partitioned by them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SYMBOL, TIMESTAMP, PanelError, check, forbid, require

# The slippage field of each stress level, and names that results must not hold.
STRESS_FIELDS = {"none": "slippage_bps_daily", "2x": "slippage_bps_stress_2x", "5x": "slippage_bps_stress_5x"}
FORBIDDEN = ("alpha", "order", "prediction", "signal", "target", "trade")


@dataclass(frozen=True)
class CostModel:
    """Basis points charged on turnover."""

    commission_bps: float = 0.0
    slippage_bps: float = 0.0

    @property
    def rate(self) -> float:
        return (self.commission_bps + self.slippage_bps) / 10_000.0

    def stressed(self, factor: float) -> CostModel:
        """Slippage times ``factor``; commissions are agreed on and stay."""
        return CostModel(self.commission_bps, self.slippage_bps * factor)


def load_costs(path: str, stress: str = "none") -> CostModel:
    import yaml

    if stress not in STRESS_FIELDS:
        raise PanelError(f"stress must be one of {list(STRESS_FIELDS)}")
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    if not isinstance(found, dict) or STRESS_FIELDS[stress] not in found:
        raise PanelError(f"{path} lacks {STRESS_FIELDS[stress]}")
    return CostModel(float(found.get("commission_bps", 0.0)), float(found[STRESS_FIELDS[stress]]))


def load_stress(path: str) -> dict[str, CostModel]:
    """The costs of the two stress levels as the file states them, by variant of the null battery."""
    return {f"cost_stress_{level}": load_costs(path, level) for level in STRESS_FIELDS if level != "none"}


def with_outcome(df: DataFrame, horizon: int = 1, price: str = "close", name: str = "forward_return") -> DataFrame:
    """price[t+h] / price[t] - 1 per symbol; null where unknown or the price is zero."""
    w = Window.partitionBy(SYMBOL).orderBy(TIMESTAMP)
    return df.withColumn(name, F.try_divide(F.lead(price, horizon).over(w), F.col(price)) - 1)


def realised(scored: DataFrame, *, weight: str = "weight", outcome: str = "forward_return", cost_rate: str | float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows with a known outcome, with pnl, turnover against the previous such row (the first enters from flat) and cost."""
    known = scored.where(F.col(outcome).isNotNull())
    w = Window.partitionBy(*by, SYMBOL).orderBy(TIMESTAMP)
    rate = F.col(cost_rate) if isinstance(cost_rate, str) else F.lit(float(cost_rate))
    known = known.withColumns({"pnl": F.col(weight) * F.col(outcome), "turnover": F.abs(F.col(weight) - F.lag(weight, 1, 0.0).over(w))})
    return known.withColumn("cost", F.col("turnover") * rate)


def periods(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per time: gross_return, cost, turnover, net_return, equity and drawdown.

    The equity windows run over one row per time and variant, after all bars are summed.
    """
    sums = rows.groupBy(*by, TIMESTAMP).agg(F.sum("pnl").alias("gross_return"), F.sum("cost").alias("cost"), F.sum("turnover").alias("turnover"))
    net = sums.withColumn("net_return", F.col("gross_return") - F.col("cost"))
    w = Window.partitionBy(*by).orderBy(TIMESTAMP).rowsBetween(Window.unboundedPreceding, 0)
    curve = net.withColumn("equity", F.product(1 + F.col("net_return")).over(w))
    peak = F.max("equity").over(w)
    return curve.withColumn("drawdown", F.when(peak > 0, F.least(F.lit(0.0), F.try_divide(F.col("equity"), peak) - 1)).otherwise(0.0))


def metrics(curve: DataFrame, by: Sequence[str] = (), periods_per_year: int = 252) -> DataFrame:
    """sharpe, sortino, max_drawdown, annual_turnover, total_return, cagr, n_periods of each variant."""
    r, n = F.col("net_return"), F.count(F.lit(1))
    year = math.sqrt(periods_per_year)
    growth = F.max_by("equity", TIMESTAMP)
    downside = F.sqrt(F.sum(F.when(r < 0, r * r).otherwise(0.0)) / n)
    return curve.groupBy(*by).agg(
        F.coalesce(F.when(n >= 2, F.try_divide(F.avg(r), F.stddev_samp(r)) * year), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.try_divide(F.avg(r), downside) * year, F.lit(0.0)).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        (F.avg("turnover") * periods_per_year).alias("annual_turnover"),
        (growth - 1).alias("total_return"),
        F.when(growth > 0, F.pow(F.when(growth > 0, growth), F.lit(float(periods_per_year)) / n) - 1).otherwise(-1.0).alias("cagr"),
        n.alias("n_periods"),
    )


@dataclass(frozen=True)
class BacktestResult:
    periods: DataFrame
    metrics: dict


def run_backtest(df: DataFrame, *, weight_col: str = "weight", horizon: int = 1, cost_model: CostModel | None = None, as_of=None, periods_per_year: int = 252, price: str = "close") -> BacktestResult:
    """Validate, score and summarise. Periods overlap for horizons over 1 and are not rescaled."""
    if horizon < 1 or periods_per_year < 1:
        raise PanelError("horizon and periods_per_year must be at least 1")
    require(df, [SYMBOL, TIMESTAMP, price, weight_col], "backtest input")
    check(df, what="backtest input", weights=[weight_col])
    if as_of is not None:
        from ..sources.bars import assert_no_lookahead

        assert_no_lookahead(df, as_of)
    rows = realised(with_outcome(df, horizon, price), weight=weight_col, cost_rate=(cost_model or CostModel()).rate)
    curve = periods(rows)
    forbid(curve, FORBIDDEN, what="backtest result")
    got = metrics(curve, periods_per_year=periods_per_year).first()
    if got is None or not got["n_periods"]:
        raise PanelError("no row has a known outcome")
    return BacktestResult(curve, got.asDict())
