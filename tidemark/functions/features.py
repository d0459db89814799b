"""Rolling price features as column builders over shared windows per symbol."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import SYMBOL, TIMESTAMP, PanelError, require

TRADING_DAYS = 252
FEATURES = ("daily_return", "log_return", "rolling_vol_20d", "sma_5d", "sma_20d", "ema_5d", "ema_20d", "rolling_vol_volume_20d")
FORGET = 40.0  # a weight of exp(-40) is below what a double can tell


def by_symbol():
    return Window.partitionBy(SYMBOL).orderBy(TIMESTAMP)


def _rows(n: int):
    return by_symbol().rowsBetween(1 - n, 0)


def _window(n: int, least: int = 1) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < least:
        raise PanelError(f"window must be an integer of at least {least}")
    return n


def daily_return(price: str = "close") -> Column:
    return F.try_divide(F.col(price), F.lag(price).over(by_symbol())) - 1


def log_return(price: str = "close") -> Column:
    return F.ln(F.try_divide(F.col(price), F.lag(price).over(by_symbol())))


def _full(value: Column, column: str, n: int) -> Column:
    """Null until the last n rows all have a value."""
    return F.when(F.count(column).over(_rows(n)) >= n, value)


def rolling_volatility(n: int = 20, returns: str = "log_return") -> Column:
    _window(n, 2)
    return _full(F.stddev_samp(returns).over(_rows(n)) * math.sqrt(TRADING_DAYS), returns, n)


def sma(n: int, price: str = "close") -> Column:
    _window(n)
    return _full(F.avg(price).over(_rows(n)), price, n)


def rolling_volume(n: int = 20) -> Column:
    _window(n)
    return _full(F.avg(F.col("volume").cast("double")).over(_rows(n)), "volume", n)


def with_ema(df: DataFrame, spans: tuple[int, ...], price: str = "close") -> DataFrame:
    """Adds ema_{n}d: exponentially weighted means with weights normalised by their sum, null until n values.

    A row without a price has no mean of its own, but ages the weights of those before it.
    """
    for n in spans:
        df = _one_ema(df, _window(n), price)
    return df


def _one_ema(df: DataFrame, n: int, price: str) -> DataFrame:
    """Window functions alone, in constant memory and the partitioning by symbol that the other features have.

    A symbol's rows are cut into blocks as long as weights matter. Within a block, the weighted sum up to a
    row is a running sum of values scaled up by their place, scaled down again; all that matters from before is
    the sum at the end of the last block, which ages by the row's place.
    """
    whole = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    ready = (F.count(price).over(whole) >= n) & F.col(price).isNotNull()
    if n == 1:
        return df.withColumn(f"ema_{n}d", F.when(ready, F.col(price).cast("double")))
    keep = 1 - 2 / (n + 1)
    size = math.ceil(FORGET / -math.log(keep))
    made = df.withColumn("_row", F.row_number().over(by_symbol()) - 1)
    made = made.withColumns({"_block": F.floor(F.col("_row") / size), "_place": F.col("_row") % size})
    inside = Window.partitionBy(SYMBOL, "_block").orderBy(TIMESTAMP).rowsBetween(Window.unboundedPreceding, 0)
    up, down = F.pow(F.lit(1 / keep), F.col("_place")), F.pow(F.lit(keep), F.col("_place"))
    value = F.coalesce(F.col(price).cast("double"), F.lit(0.0))
    made = made.withColumns({"_sum": F.sum(value * up).over(inside) * down, "_weight": F.sum(F.when(F.col(price).isNotNull(), up).otherwise(0.0)).over(inside) * down})
    earlier = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(F.last(F.when(F.col("_place") == size - 1, F.col(c)), ignorenulls=True).over(earlier), F.lit(0.0)) * down * keep
    mean = F.try_divide(F.col("_sum") + carried("_sum"), F.col("_weight") + carried("_weight"))
    return made.withColumn(f"ema_{n}d", F.when(ready, mean)).drop("_row", "_block", "_place", "_sum", "_weight")


def with_features(bars: DataFrame, feature_set_id: Column | str | None = None) -> DataFrame:
    """All eight features; the window functions share one exchange by symbol."""
    require(bars, [SYMBOL, TIMESTAMP, "close", "volume"], "bars")
    out = bars.withColumns({"daily_return": daily_return(), "log_return": log_return()})
    out = out.withColumns({"rolling_vol_20d": rolling_volatility(20), "sma_5d": sma(5), "sma_20d": sma(20), "rolling_vol_volume_20d": rolling_volume(20)})
    out = with_ema(out, (5, 20)).select(*bars.columns, *FEATURES)
    if feature_set_id is None:
        return out
    return out.withColumn("feature_set_id", F.lit(feature_set_id) if isinstance(feature_set_id, str) else feature_set_id)


def build_pit_feature_set(spark: SparkSession, path: str, symbol: str, *, as_of) -> DataFrame:
    """One symbol's features from bars known by ``as_of``; the set's id names the last bar found."""
    from ..plans.fingerprints import feature_set_id
    from ..sources.bars import point_in_time, scan

    known = point_in_time(scan(spark, path), as_of=as_of, symbols=[symbol])
    last = known.agg(F.max(F.to_date(TIMESTAMP))).first()[0]
    return with_features(known, feature_set_id(path, symbol, last))


def build_feature_set(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """The same without a cutoff, over whatever bars the file holds: for comparison only, since it can look ahead."""
    from ..plans.fingerprints import feature_set_id

    try:
        raw = spark.read.parquet(path)
    except AnalysisException as e:
        raise PanelError(f"{path} cannot be read") from e
    own = raw.where(F.col(SYMBOL) == symbol.strip().upper())
    if own.isEmpty():
        raise PanelError(f"{path} has no rows of {symbol.strip().upper()}")
    return with_features(own, feature_set_id(path, symbol))
