"""Forward-return labels with a ledger of null reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BAR_COLUMNS, KEY, SYMBOL, TIMESTAMP, PanelError, check, forbid, require
from .features import by_symbol

REASON = "target_null_reason"
# Names that inputs must not hold, and that a label must not take either.
OUTPUTS = ("alpha", "order", "position", "prediction", "qty", "quantity", "side", "signal", "target", "target_weight", "trade", "weight")
RESERVED = (*BAR_COLUMNS, REASON, *OUTPUTS)


def label_name(horizon: int, name: str | None = None) -> str:
    if isinstance(horizon, bool) or not isinstance(horizon, int) or horizon < 1:
        raise PanelError("horizon must be an integer of at least 1")
    if name is None:
        return f"label_forward_return_{horizon}d"
    name = name.strip()
    if not name or name in RESERVED:
        raise PanelError(f"{name!r} cannot name a label")
    return name


def forward_return(horizon: int, price: str = "close") -> Column:
    """price[t+h] / price[t] - 1, h counted in rows."""
    return F.try_divide(F.lead(price, horizon).over(by_symbol()), F.col(price)) - 1


def null_reason(horizon: int, price: str = "close") -> Column:
    w = by_symbol()
    return (
        F.when(F.col(price).isNull(), "source_price_null")
        .when(F.lead(TIMESTAMP, horizon).over(w).isNull(), "insufficient_future_rows")
        .when(F.lead(price, horizon).over(w).isNull(), "future_price_null")
    )


def with_labels(bars: DataFrame, horizon: int = 1, *, price: str = "close", name: str | None = None, strict: bool = True) -> DataFrame:
    """Adds the label and the reason why it is null."""
    label = label_name(horizon, name)
    require(bars, [*KEY, price], "bars")
    forbid(bars, [*OUTPUTS, "label", label], ("label_", "target_"), "bars")
    if strict:
        check(bars, what="bars", prices=[price])
    return bars.withColumns({label: forward_return(horizon, price), REASON: null_reason(horizon, price)})


def ledger_violations(labelled: DataFrame, label: str) -> DataFrame:
    """One row: labels that are null without a reason, or have one without being null."""
    return labelled.agg(F.count_if(F.col(label).isNull() != F.col(REASON).isNotNull()).alias("violations"))


def assert_ledger(labelled: DataFrame, label: str) -> DataFrame:
    """A label is null if and only if a reason is given."""
    n = ledger_violations(labelled, label).first()["violations"]
    if n:
        raise PanelError(f"{n} rows where label and reason disagree")
    return labelled


def label_summary(labelled: DataFrame, label: str) -> DataFrame:
    """One row: rows, labelled, null, symbols, first and last time."""
    return labelled.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(label).alias("n_labelled"),
        F.count_if(F.col(label).isNull()).alias("n_null"),
        F.count_distinct(SYMBOL).alias("n_symbols"),
        F.min(TIMESTAMP).alias("first_timestamp"),
        F.max(TIMESTAMP).alias("last_timestamp"),
    )


def count_by(df: DataFrame, column: str, absent: str = "UNSPECIFIED") -> DataFrame:
    """Rows of each category, nulls as ``absent`` and last."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col(column).asc_nulls_last()).withColumn(column, F.coalesce(column, F.lit(absent)))
