"""Scans of bar tables: projection, symbols, inclusive dates, and the point-in-time cutoff."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BAR_COLUMNS, KEY, SYMBOL, TIMESTAMP, PanelError, check, require


class LookaheadError(PanelError):
    """Rows lie beyond the cutoff."""


def as_date(value: str | dt.date, name: str = "date") -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(value) if len(value) == 10 else dt.datetime.fromisoformat(value).date()
    except (TypeError, ValueError) as e:
        raise PanelError(f"{name} must be an ISO date") from e


def tickers(symbols: Sequence[str] | str) -> list[str]:
    """Trimmed, upper-cased, without blanks or repeats, in the given order."""
    found = list(dict.fromkeys(s.strip().upper() for s in ([symbols] if isinstance(symbols, str) else symbols) if s.strip()))
    if not found:
        raise PanelError("symbols must name at least one symbol")
    return found


def between(start: str | dt.date | None = None, end: str | dt.date | None = None, as_of: str | dt.date | None = None, column: str = TIMESTAMP) -> Column:
    """Inclusive bounds on the date; a predicate that Parquet scans push down."""
    low = as_date(start, "start") if start is not None else None
    high = [as_date(x, n) for x, n in ((end, "end"), (as_of, "as_of")) if x is not None]
    if low and any(h < low for h in high):
        raise PanelError("start lies after end or as_of")
    day = F.to_date(column)
    test = F.lit(True)
    if low:
        test &= day >= F.lit(low)
    if high:
        test &= day <= F.lit(min(high))
    return test


def select_bars(bars: DataFrame, *, symbols: Sequence[str] | None = None, start=None, end=None, columns: Sequence[str] | None = None) -> DataFrame:
    """Projection by whitelist, membership, inclusive dates; ordered by (timestamp, symbol)."""
    if columns is not None:
        unknown = [c for c in columns if c not in BAR_COLUMNS]
        if not columns or unknown:
            raise PanelError(f"columns must be bar columns; got {unknown or 'none'}")
    out = bars.where(between(start, end))
    if symbols is not None:
        out = out.where(F.col(SYMBOL).isin(tickers(symbols)))
    out = out.orderBy(TIMESTAMP, SYMBOL)
    return out.select(*(columns or [c for c in bars.columns if c in BAR_COLUMNS]))


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def query_bars(spark: SparkSession, path: str, **options) -> DataFrame:
    return select_bars(scan(spark, path), **options)


def count_bars(bars: DataFrame) -> int:
    return bars.count()


def available_symbols(bars: DataFrame) -> DataFrame:
    return bars.select(SYMBOL).distinct().orderBy(SYMBOL)


def lookahead(df: DataFrame, as_of) -> DataFrame:
    """One row: the number of rows dated after the cutoff."""
    require(df, [TIMESTAMP])
    return df.agg(F.count_if(F.to_date(TIMESTAMP) > F.lit(as_date(as_of, "as_of"))).alias("violations"))


def assert_no_lookahead(df: DataFrame, as_of) -> DataFrame:
    n = lookahead(df, as_of).first()["violations"]
    if n:
        raise LookaheadError(f"{n} rows lie after {as_of}")
    return df


def point_in_time(bars: DataFrame, *, as_of, symbols: Sequence[str] | None = None, start=None, strict: bool = True) -> DataFrame:
    """Bars known at the inclusive cutoff, ordered by (symbol, timestamp).

    ``strict`` validates eagerly in one job. Otherwise the plan stays lazy and carries the gate: a row
    beyond the cutoff makes the query fail.
    """
    out = bars.where(between(start, as_of=as_of))
    if symbols is not None:
        out = out.where(F.col(SYMBOL).isin(tickers(symbols)))
    if strict:
        check(out, what="point-in-time bars")
        assert_no_lookahead(out, as_of)
    else:
        seen = F.to_date(TIMESTAMP) <= F.lit(as_date(as_of))
        out = out.where(F.coalesce(F.assert_true(seen, F.lit("row after the cutoff")).cast("boolean"), F.lit(True)))
    return out.orderBy(*KEY)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV (with header and inferred types) or Parquet, by suffix."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise PanelError(f"cannot read {path}: .csv or .parquet expected")


def read_spec(path: str, *, allow_list: bool = False):
    """A JSON or YAML object; for registries also a list, bare or under ``features``."""
    suffix = Path(path).suffix
    text = Path(path).read_text(encoding="utf-8")
    if suffix == ".json":
        found = json.loads(text)
    elif suffix in (".yaml", ".yml"):
        import yaml

        found = yaml.safe_load(text)
    else:
        raise PanelError(f"cannot read {path}: .json, .yaml or .yml expected")
    if allow_list:
        found = found.get("features") if isinstance(found, dict) else found
        if isinstance(found, list):
            return found
        raise PanelError(f"{path} must hold a list of definitions")
    if not isinstance(found, dict):
        raise PanelError(f"{path} must hold an object")
    return found


def concat_features(frames: Sequence[DataFrame], known: Sequence[str]) -> DataFrame:
    """Vertical concatenation of feature tables whose feature columns must agree."""
    if not frames:
        raise PanelError("no feature tables")
    picked = []
    for i, df in enumerate(frames):
        require(df, [*KEY, "feature_set_id"], f"feature table {i}")
        if df.isEmpty():
            raise PanelError(f"feature table {i} is empty")
        names = [c for c in df.columns if c in known]
        if not names or names != [c for c in frames[0].columns if c in known]:
            raise PanelError(f"feature table {i} has other features than the first")
        picked.append(df.select(*KEY, "feature_set_id", *names))
    out = picked[0]
    for df in picked[1:]:
        out = out.unionByName(df)
    return out


def read_features(spark: SparkSession, paths: Sequence[str], known: Sequence[str]) -> DataFrame:
    return concat_features([spark.read.parquet(p) for p in paths], known)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    require(df, [*KEY, "weight"], "weights")
    return df.select(*KEY, "weight")
