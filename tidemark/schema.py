"""Panel schemas and fail-closed checks; each input is validated by one aggregate job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOL, TIMESTAMP = "symbol", "timestamp"
KEY = (SYMBOL, TIMESTAMP)

BARS = T.StructType(
    [T.StructField(SYMBOL, T.StringType()), T.StructField(TIMESTAMP, T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]
    + [T.StructField(c, T.LongType()) for c in ("volume", "trade_count")]
    + [T.StructField("vwap", T.DoubleType())]
)
BAR_COLUMNS = tuple(f.name for f in BARS.fields)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class PanelError(ValueError):
    """An input breaks a panel rule."""


def require(df: DataFrame, columns: Iterable[str], what: str = "frame") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise PanelError(f"{what} lacks columns {missing}")


def forbid(df: DataFrame, names: Iterable[str] = (), prefixes: Sequence[str] = (), what: str = "frame") -> None:
    names = {n.lower() for n in names}
    hits = sorted(c for c in df.columns if c.lower() in names or any(c.lower().startswith(p) for p in prefixes))
    if hits:
        raise PanelError(f"{what} holds forbidden columns {hits}")


def finite(c: Column) -> Column:
    """Neither NaN nor infinite; null for null."""
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def faults(df: DataFrame, *, key: Sequence[str] = KEY, prices: Sequence[str] = (), weights: Sequence[str] = ()) -> DataFrame:
    """One row that counts rows, duplicate keys and every broken rule; partial counts meet once, by key."""
    counts = {
        "blank_ids": F.count_if(F.col(key[0]).isNull() | (F.trim(key[0]) == "")),
        "null_times": F.count_if(F.col(key[-1]).isNull()),
        **{f"{c}_non_finite": F.count_if(~finite(F.col(c).cast("double"))) for c in (*prices, *weights)},
        **{f"{c}_at_or_below_zero": F.count_if(F.col(c) <= 0) for c in prices},
        **{f"{c}_values": F.count(c) for c in prices},
        **{f"{c}_null": F.count_if(F.col(c).isNull()) for c in weights},
    }
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *(v.alias(f"_{k}") for k, v in counts.items()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_key.agg(total("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("duplicate_keys"), *(total(f"_{k}").alias(k) for k in counts))


def check(df: DataFrame, *, what: str = "frame", key: Sequence[str] = KEY, prices: Sequence[str] = (), weights: Sequence[str] = (), allow_empty: bool = False) -> int:
    """Validate in one job and return the row count.

    Symbols must be non-blank strings; keys unique and non-null in the time; prices numeric, with at
    least one value, all finite and above zero; weights neither null nor NaN nor infinite.
    """
    require(df, [*key, *prices, *weights], what)
    for c in (*prices, *weights):
        if not isinstance(df.schema[c].dataType, NUMERIC):
            raise PanelError(f"{what}: {c} must be numeric")
    if not isinstance(df.schema[key[0]].dataType, T.StringType):
        raise PanelError(f"{what}: {key[0]} must be a string")
    got = faults(df, key=key, prices=prices, weights=weights).first().asDict()
    if not got["rows"]:
        if allow_empty:
            return 0
        raise PanelError(f"{what} is empty")
    broken = {"has blank ids": got["blank_ids"], "has null times": got["null_times"], f"has {got['duplicate_keys']} duplicate keys": got["duplicate_keys"]}
    for c in (*prices, *weights):
        broken[f"has non-finite {c}"] = got[f"{c}_non_finite"]
    for c in prices:
        broken |= {f"has {c} at or below zero": got[f"{c}_at_or_below_zero"], f"has no {c}": not got[f"{c}_values"]}
    for c in weights:
        broken[f"has null {c}"] = got[f"{c}_null"]
    if any(broken.values()):
        raise PanelError(f"{what} " + ", ".join(k for k, n in broken.items() if n))
    return got["rows"]


def duplicate_keys(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys that occur more than once, with their count; nulls compare equal."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def any_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns), F.lit(False))


def shared_symbols(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(SYMBOL).intersect(right.select(SYMBOL))


def missing_symbols(wanted: DataFrame, here: DataFrame) -> DataFrame:
    """Symbols of ``wanted`` that ``here`` lacks."""
    return wanted.select(SYMBOL).subtract(here.select(SYMBOL))


def disjoint_symbols(left: DataFrame, right: DataFrame) -> bool:
    return shared_symbols(left, right).isEmpty()
