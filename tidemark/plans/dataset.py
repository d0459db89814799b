"""Dataset assembly: labels as the spine, features, identity, universe, references, cutoff and eligibility."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import temporal
from ..schema import KEY, SYMBOL, TIMESTAMP, PanelError, any_present, check, forbid, require
from ..sources.bars import between, tickers

ELIGIBLE, REASON, CUTOFF, HORIZON = "eligible", "eligibility_reason", "feature_cutoff", "max_label_horizon"
# Column names that a research dataset must not hold.
FORBIDDEN = ("alpha", "label", "order", "position", "prediction", "qty", "quantity", "side", "signal", "target", "trade", "weight", "y")


@dataclass
class Panel:
    """The inputs of one assembly; the optional tables default to absent."""

    labels: DataFrame
    label_columns: Sequence[str]
    features: DataFrame
    feature_columns: Sequence[str]
    universe: DataFrame | None = None
    identity: DataFrame | None = None
    reference: DataFrame | None = None
    reference_columns: Sequence[str] = ()
    horizons: dict[str, int] = field(default_factory=dict)
    lag_bars: int = 1
    synthetic_no_universe: bool = False
    label_zone: str | None = None
    feature_zone: str | None = None

    @property
    def zone_mismatch(self) -> bool:
        """Declared zones that differ: the features are then not joined, and nothing is converted."""
        return self.label_zone != self.feature_zone


def horizon_of(column: str, horizons: dict[str, int] | None = None) -> int:
    """Declared, else the number in a trailing _{n}d, else 1."""
    if horizons and column in horizons:
        return horizons[column]
    m = re.search(r"_(\d+)d$", column)
    return int(m[1]) if m else 1


def assemble_rows(panel: Panel, *, strict: bool = True) -> DataFrame:
    """One lazy plan; strict runs one validation job per input first.

    Columns: keys, features, labels, reference values, then permanent_id, universe_status,
    feature_cutoff, max_label_horizon, eligible and eligibility_reason.
    """
    if panel.lag_bars < 1:
        raise PanelError("features lag by at least one bar")
    if not panel.label_columns or not panel.feature_columns:
        raise PanelError("name at least one label and one feature")
    require(panel.labels, [*KEY, *panel.label_columns], "labels")
    require(panel.features, [*KEY, *panel.feature_columns], "features")
    if strict:
        check(panel.labels, what="labels")
        check(panel.features, what="features")
    spine = panel.labels.select(*KEY, *panel.label_columns)
    if panel.zone_mismatch:
        joined = spine.select("*", *(F.lit(None).cast(panel.features.schema[c].dataType).alias(c) for c in panel.feature_columns))
    else:
        joined = spine.join(panel.features.select(*KEY, *panel.feature_columns), list(KEY), "left")
    joined = temporal.resolve_identity(joined, panel.identity)
    joined = temporal.universe_membership(joined, panel.universe, strict=strict)
    if panel.reference_columns:
        joined = temporal.as_of(joined, panel.reference, panel.reference_columns, fail_open=True, strict=strict)
    cutoff = F.lag(TIMESTAMP, panel.lag_bars).over(Window.partitionBy(SYMBOL).orderBy(TIMESTAMP))
    joined = joined.withColumn(CUTOFF, cutoff).withColumn(HORIZON, F.lit(max(horizon_of(c, panel.horizons) for c in panel.label_columns)))
    status = F.col(temporal.STATUS)
    reason = F.when(F.col(CUTOFF).isNull(), "insufficient_feature_history")
    if not panel.synthetic_no_universe:
        reason = reason.when(status == "no_universe_data", "no_universe_data")
    reason = reason.when(status == "not_in_universe", "not_in_universe").when(~any_present(panel.label_columns), "all_labels_null").otherwise("eligible")
    joined = joined.withColumn(REASON, reason).withColumn(ELIGIBLE, F.col(REASON) == "eligible")
    return joined.select(*KEY, *panel.feature_columns, *panel.label_columns, *panel.reference_columns, temporal.PERMANENT, temporal.STATUS, CUTOFF, HORIZON, ELIGIBLE, REASON)


def research_dataset(bars: DataFrame, features: DataFrame, *, feature_columns: Sequence[str], symbols: Sequence[str] | None = None, start=None, end=None, as_of=None, strict: bool = True) -> DataFrame:
    """Bars inner-joined with features on (symbol, timestamp), inclusive filters on both sides first.

    Requested symbols must be in both inputs; an empty result and forbidden columns are errors.
    """
    require(bars, KEY, "bars")
    require(features, [*KEY, *feature_columns], "features")
    window = between(start, end, as_of)
    bars, features = bars.where(window), features.where(window)
    if symbols is not None:
        wanted = tickers(symbols)
        for what, df in (("bars", bars), ("features", features)):
            here = {r[0] for r in df.where(F.col(SYMBOL).isin(wanted)).select(SYMBOL).distinct().collect()}  # bounded by the request
            if set(wanted) - here:
                raise PanelError(f"{what} lack symbols {sorted(set(wanted) - here)}")
        bars, features = bars.where(F.col(SYMBOL).isin(wanted)), features.where(F.col(SYMBOL).isin(wanted))
    if strict:
        check(bars, what="bars")
        check(features, what="features")
    out = bars.join(features.select(*KEY, *feature_columns), list(KEY))
    forbid(out, FORBIDDEN, (), "research dataset")
    if strict and out.isEmpty():
        raise PanelError("bars and features share no key")
    return out.orderBy(*KEY)


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, symbols, first and last time, and the nulls of each column."""
    nulls = (F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(SYMBOL).alias("symbols"), F.min(TIMESTAMP).alias("first_timestamp"), F.max(TIMESTAMP).alias("last_timestamp"), *nulls)


def dataset_summary(df: DataFrame, columns: Sequence[str]) -> dict:
    got = summary(df, columns).first().asDict()
    return {k: v for k, v in got.items() if not k.startswith("nulls_")} | {"nulls": {c: got[f"nulls_{c}"] for c in columns}}
