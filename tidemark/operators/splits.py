"""Temporal train, validation and test splits with a purged and embargoed edge.

Only the edge from train to validation is purged. Labels of validation rows may reach into the test
block unless ``purge_validation`` is set.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, TIMESTAMP, PanelError

SPLIT = "split"


@dataclass(frozen=True)
class Boundaries:
    """Positions on the axis of distinct times: [0, train_end), [train_end, validation_end), [validation_end, n)."""

    n: int
    train_end: int
    validation_end: int
    max_horizon: int
    embargo: int
    purge_validation: bool = False


def boundaries(n: int, *, max_horizon: int, train_fraction: float = 0.6, validation_fraction: float = 0.2, embargo: int | None = None, purge_validation: bool = False) -> Boundaries:
    if n < 3:
        raise PanelError("a split needs at least three distinct times")
    embargo = max_horizon if embargo is None else embargo
    if any(isinstance(x, bool) or not isinstance(x, int) for x in (max_horizon, embargo)) or max_horizon < 1:
        raise PanelError("max_horizon and embargo are whole numbers, max_horizon at least 1")
    if embargo < max_horizon:
        raise PanelError("an embargo below max_horizon lets labels leak into the evaluation")
    if not (0 < train_fraction < 1 and 0 < validation_fraction < 1 and train_fraction + validation_fraction < 1):
        raise PanelError("fractions must lie between 0 and 1 and leave room for a test block")
    train_end = max(1, int(n * train_fraction))
    validation_end = min(max(train_end + 1, int(n * (train_fraction + validation_fraction))), n - 1)
    return Boundaries(n, train_end, validation_end, max_horizon, embargo, purge_validation)


def positions(df: DataFrame) -> DataFrame:
    """timestamp, position: dense ranks on the distinct times (as many rows as there are times, not bars)."""
    return df.select(TIMESTAMP).distinct().withColumn("position", F.row_number().over(Window.orderBy(TIMESTAMP)) - 1)


def labelled_positions(df: DataFrame, b: Boundaries) -> DataFrame:
    p = F.col("position")
    label = (
        F.when((p < b.train_end) & (p + b.max_horizon >= b.train_end), "purged")
        .when((p < b.train_end) & (b.train_end - p <= b.embargo), "embargoed")
        .when(p < b.train_end, "train")
    )
    if b.purge_validation:
        label = label.when((p < b.validation_end) & (p + b.max_horizon >= b.validation_end), "purged")
    label = label.when(p < b.validation_end, "validation").otherwise("test")
    return positions(df).withColumn(SPLIT, label)


def temporal_split(df: DataFrame, **options) -> tuple[DataFrame, Boundaries]:
    """(symbol, timestamp, split) and the boundaries; purged and embargoed rows keep their own labels."""
    b = boundaries(df.select(TIMESTAMP).distinct().count(), **options)
    return df.select(*KEY).join(F.broadcast(labelled_positions(df, b).select(TIMESTAMP, SPLIT)) if b.n <= 1_000_000 else labelled_positions(df, b).select(TIMESTAMP, SPLIT), TIMESTAMP).select(*KEY, SPLIT), b


def violations(df: DataFrame, assigned: DataFrame, b: Boundaries) -> DataFrame:
    """One row: rows in two splits, train positions whose labels reach the evaluation, and those inside the embargo."""
    where = assigned.join(positions(df), TIMESTAMP)
    twice = assigned.groupBy(*KEY).agg(F.count_distinct(SPLIT).alias("k")).agg(F.count_if(F.col("k") > 1).alias("overlapping"))
    first = where.agg(F.min(F.when(F.col(SPLIT).isin("validation", "test"), F.col("position"))).alias("first"))
    train = where.where(F.col(SPLIT) == "train").crossJoin(F.broadcast(first))  # one row
    late = train.agg(F.count_if(F.col("position") + b.max_horizon >= F.col("first")).alias("unpurged"), F.count_if(F.col("position") > F.col("first") - b.embargo).alias("inside_embargo"))
    return twice.crossJoin(late)  # one row each


def assert_split(df: DataFrame, assigned: DataFrame, b: Boundaries) -> None:
    if b.embargo < b.max_horizon:
        raise PanelError("invalid split: its embargo is below its horizon")
    got = violations(df, assigned, b).first()
    if any(got):
        raise PanelError(f"invalid split: {got.asDict()}")


def split_parts(df: DataFrame, b: Boundaries) -> DataFrame:
    """A row for each part: its size in times, its first and its last time."""
    return labelled_positions(df, b).groupBy(SPLIT).agg(F.count(F.lit(1)).alias("n"), F.min(TIMESTAMP).alias("first"), F.max(TIMESTAMP).alias("last"))


def split_summary(df: DataFrame, b: Boundaries) -> dict:
    """The parts, with times as ISO text, and the boundaries."""
    rows = split_parts(df, b).collect()
    parts = {r[SPLIT]: {"timestamps": r["n"], "first": r["first"].isoformat(), "last": r["last"].isoformat()} for r in rows}
    return {"boundaries": asdict(b), "parts": parts, "purged": parts.get("purged", {}).get("timestamps", 0), "embargoed": parts.get("embargoed", {}).get("timestamps", 0)}
