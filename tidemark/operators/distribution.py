"""Distributions, null counts and category counts, one aggregate job each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SYMBOL, TIMESTAMP, finite

PERCENTILES = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def statistics(value: str, extreme: float | None = None) -> list[Column]:
    """n_total, n_valid, n_null, n_non_finite, null_pct, mean, std, min, max and percentiles; only finite values count as valid."""
    good = F.when(finite(F.col(value)), F.col(value))
    out = [
        F.count(F.lit(1)).alias("n_total"),
        F.count(good).alias("n_valid"),
        F.count_if(F.col(value).isNull()).alias("n_null"),
        F.count_if(~finite(F.col(value))).alias("n_non_finite"),
        F.coalesce(F.try_divide(100.0 * F.count_if(F.col(value).isNull()), F.count(F.lit(1))), F.lit(0.0)).alias("null_pct"),
        F.avg(good).alias("mean"),
        F.stddev_samp(good).alias("std"),
        F.min(good).alias("min"),
        F.max(good).alias("max"),
    ]
    levels = F.percentile(good, F.array(*(F.lit(p) for p in PERCENTILES.values())))
    out += [levels[i].alias(k) for i, k in enumerate(PERCENTILES)]
    if extreme is not None:
        out.append(F.count_if(finite(F.col(value)) & (F.abs(F.col(value)) > extreme)).alias("n_extreme"))
    return out


def distribution(df: DataFrame, value: str, by: Sequence[Column | str] = (), extreme: float | None = None) -> DataFrame:
    return df.groupBy(*by).agg(*statistics(value, extreme))


def by_symbol(df: DataFrame, value: str) -> DataFrame:
    return distribution(df, value, [SYMBOL])


def by_month(df: DataFrame, value: str) -> DataFrame:
    return distribution(df, value, [F.date_format(TIMESTAMP, "yyyy-MM").alias("month")])


def grouping_sets(df: DataFrame, value: str, extreme: float | None = None) -> DataFrame:
    """Whole, per symbol and per month in one pass: rows with null symbol and month are the whole."""
    keyed = df.withColumn("month", F.date_format(TIMESTAMP, "yyyy-MM"))
    sets = keyed.groupingSets([[], [F.col(SYMBOL)], [F.col("month")]], F.col(SYMBOL), F.col("month"))
    level = F.when(F.grouping(SYMBOL) == 0, "symbol").when(F.grouping("month") == 0, "month").otherwise("all")
    return sets.agg(level.alias("level"), *statistics(value, extreme))


def null_matrix(df: DataFrame, columns: Sequence[str], eligible: Column | None = None) -> DataFrame:
    """column_name, null_count, null_fraction, eligible_null_count, eligible_null_fraction; fractions of no rows are 0."""
    eligible = F.lit(True) if eligible is None else eligible
    if not columns:
        columns = []
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(eligible).alias("_e")]
    for i, c in enumerate(columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"_a{i}"), F.count_if(eligible & F.col(c).isNull()).alias(f"_b{i}")]
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"_a{i}").alias("null_count"), share(f"_a{i}", "_n").alias("null_fraction"), F.col(f"_b{i}").alias("eligible_null_count"), share(f"_b{i}", "_e").alias("eligible_null_fraction"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
