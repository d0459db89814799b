"""Null models: what a weight series must beat, and a trap that must explode.

Random draws are keyed hashes of (seed, symbol, timestamp): equal on any cluster, for any partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, SYMBOL, TIMESTAMP, PanelError
from .backtest import CostModel, metrics, periods, with_outcome

# The variants, and the factors of slippage in the two stress levels.
VARIANTS = ("baseline", "random_weights", "shuffled_weights", "shifted_weights", "future_leak", "cost_stress_2x", "cost_stress_5x")
STRESS = {"cost_stress_2x": 2.0, "cost_stress_5x": 5.0}


def keyed_uniform(seed: int, *columns: Column) -> Column:
    """Uniform in [0, 1): the first 32 bits of md5(seed|columns)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


def _key(time_format: str = "yyyy-MM-dd HH:mm:ss") -> tuple[Column, Column]:
    return F.col(SYMBOL), F.date_format(TIMESTAMP, time_format)


def random_weights(df: DataFrame, seed: int, low: float = -1.0, high: float = 1.0, name: str = "weight") -> DataFrame:
    if high < low:
        raise PanelError("high lies below low")
    return df.withColumn(name, F.lit(low) + (high - low) * keyed_uniform(seed, *_key()))


def _numbered(df: DataFrame, digest: str, name: str) -> DataFrame:
    """Row numbers in order of a hexadecimal digest, without a single-task window.

    The first three digits deal rows evenly into 4096 ranges; each is numbered apart and shifted by the
    sizes of those before it.
    """
    ranged = df.withColumn("_p", F.substring(digest, 1, 3))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_p", before.alias("_before")))  # at most 4096 rows
    within = F.row_number().over(Window.partitionBy("_p").orderBy(digest, *KEY))
    return ranged.withColumn("_r", within).join(offsets, "_p").withColumn(name, F.col("_before") + F.col("_r")).drop("_p", "_r", "_before")


def shuffled_weights(df: DataFrame, seed: int, weight: str = "weight", name: str | None = None) -> DataFrame:
    """A seeded permutation of the weights over all rows and symbols, in place of them or under a name of its own."""
    drawn = lambda side: F.md5(F.concat_ws("|", F.lit(f"{seed}{side}"), *_key()))
    places = _numbered(df.withColumn("_h", drawn("a")), "_h", "_i").drop("_h")
    values = _numbered(df.select(*KEY, drawn("b").alias("_h"), F.col(weight).alias("_w")), "_h", "_i").select("_i", "_w")
    return places.join(values, "_i").withColumn(name or weight, F.col("_w")).drop("_i", "_w")


def _previous(weight: str, lag: int = 1) -> Column:
    return F.lag(weight, lag, 0.0).over(Window.partitionBy(SYMBOL).orderBy(TIMESTAMP))


def shifted_weights(df: DataFrame, lag: int = 1, weight: str = "weight") -> DataFrame:
    if lag < 1:
        raise PanelError("weights shift by at least one row")
    return df.withColumn(weight, F.coalesce(_previous(weight, lag), F.lit(0.0)))


def _leak(outcome: str) -> Column:
    return F.coalesce(F.signum(outcome), F.lit(0.0))


def leak_weights(df: DataFrame, outcome: str = "forward_return", weight: str = "weight") -> DataFrame:
    """The sign of the future: a correct engine must reward it absurdly."""
    return df.withColumn(weight, _leak(outcome))


def series(df: DataFrame, *, seed: int, horizon: int = 1, weight: str = "weight") -> DataFrame:
    """symbol, timestamp, forward_return, and the five weight series as columns: weight and four null models of it."""
    scored = with_outcome(df.select(*KEY, "close", F.col(weight).cast("double").alias("weight")), horizon).drop("close")
    scored = scored.withColumns({"shifted_weights": F.coalesce(_previous("weight"), F.lit(0.0)), "future_leak": _leak("forward_return")})
    return shuffled_weights(random_weights(scored, seed, name="random_weights"), seed + 1, name="shuffled_weights")


def traded(df: DataFrame, *, seed: int, cost_model: CostModel, stress: Mapping[str, CostModel] | None = None, horizon: int = 1, weight: str = "weight") -> DataFrame:
    """All seven variants as one long frame: variant, timestamp, pnl, turnover, cost of each bar with a known outcome.

    Turnover comes from windows over the wide frame, so rows are multiplied only below the sums by time.
    """
    stress = stress or {v: cost_model.stressed(k) for v, k in STRESS.items()}
    known = series(df, seed=seed, horizon=horizon, weight=weight).where("forward_return is not null")
    turns = {f"_turn_{c}": F.abs(F.col(c) - _previous(c)) for c in ("weight", "random_weights", "shuffled_weights", "shifted_weights", "future_leak")}
    known = known.withColumns(turns)

    def row(variant: str, column: str, costs: CostModel) -> Column:
        turn = F.col(f"_turn_{column}")
        return F.struct(F.lit(variant).alias("variant"), (F.col(column) * F.col("forward_return")).alias("pnl"), turn.alias("turnover"), (turn * F.lit(costs.rate)).alias("cost"))

    rows = [row("baseline", "weight", cost_model)]
    rows += [row(c, c, cost_model) for c in VARIANTS[1:5]]
    rows += [row(v, "weight", costs) for v, costs in stress.items()]
    return known.select(TIMESTAMP, F.inline(F.array(*rows))).select("variant", TIMESTAMP, "pnl", "turnover", "cost")


@dataclass(frozen=True)
class BatteryReport:
    metrics: dict
    future_leak_detected: bool
    random_near_zero: bool
    shuffled_near_zero: bool
    seed: int

    def as_dict(self) -> dict:
        flags = asdict(self)
        return flags.pop("metrics") | flags


def battery_metrics(df: DataFrame, *, periods_per_year: int = 252, **options) -> DataFrame:
    return metrics(periods(traded(df, **options), ["variant"]), ["variant"], periods_per_year)


def run_battery(df: DataFrame, *, seed: int, cost_model: CostModel, leak_sharpe: float = 3.0, noise_sharpe: float = 0.5, **options) -> BatteryReport:
    """One job for all variants. The draws' seeds are reported with them."""
    got = {r["variant"]: {k: v for k, v in r.asDict().items() if k != "variant"} for r in battery_metrics(df, seed=seed, cost_model=cost_model, **options).collect()}
    if not got:
        raise PanelError("no row has a known outcome")
    got["random_weights"]["seed"], got["shuffled_weights"]["seed"] = seed, seed + 1
    sharpe = {k: v["sharpe"] for k, v in got.items()}
    return BatteryReport(
        got,
        sharpe["future_leak"] >= leak_sharpe and sharpe["future_leak"] > sharpe["baseline"],
        abs(sharpe["random_weights"]) <= noise_sharpe,
        abs(sharpe["shuffled_weights"]) <= noise_sharpe,
        seed,
    )
