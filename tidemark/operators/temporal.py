"""Temporal joins: interval membership, interval identity, backward as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, SYMBOL, TIMESTAMP, PanelError, require

STATUS = "universe_status"
PERMANENT = "permanent_id"


def _covers(t: Column, start: Column, end: Column) -> Column:
    return (t >= start) & (end.isNull() | (t <= end))


def interval_faults(intervals: DataFrame) -> DataFrame:
    """One row: intervals without a start, and those that end before they start."""
    return intervals.agg(F.count_if(F.col("valid_from").isNull()).alias("starts"), F.count_if(F.col("valid_to") < F.col("valid_from")).alias("reversed"))


def check_intervals(intervals: DataFrame, what: str) -> None:
    got = interval_faults(intervals).first()
    if got["starts"] or got["reversed"]:
        raise PanelError(f"{what}: {got['starts']} intervals without valid_from, {got['reversed']} that end before they start")


def universe_membership(panel: DataFrame, universe: DataFrame | None, *, id_col: str = SYMBOL, strict: bool = True) -> DataFrame:
    """Adds universe_status: in_universe if any interval covers the time (both ends inclusive, null end open).

    An EXISTS test: rows never multiply, and with a small universe the plan is one broadcast existence join.
    """
    if universe is None:
        return panel.withColumn(STATUS, F.lit("no_universe_data"))
    require(universe, [id_col, "valid_from", "valid_to"], "universe")
    if strict:
        check_intervals(universe, "universe")
    spans = universe.select(F.col(id_col).alias("_u"), F.col("valid_from").alias("_a"), F.col("valid_to").alias("_b")).alias("spans")
    hit = spans.where((F.col("_u") == F.col(f"panel.{id_col}").outer()) & _covers(F.col(f"panel.{TIMESTAMP}").outer(), F.col("_a"), F.col("_b"))).exists()
    return panel.alias("panel").select("panel.*", F.when(hit, "in_universe").otherwise("not_in_universe").alias(STATUS))


def resolve_identity(panel: DataFrame, identity: DataFrame | None, *, id_col: str = SYMBOL, key: Sequence[str] = KEY) -> DataFrame:
    """Adds permanent_id: of the covering interval with the least (valid_from, permanent_id), else the raw id."""
    if identity is None:
        return panel.withColumn(PERMANENT, F.col(id_col))
    require(identity, [PERMANENT, id_col, "valid_from", "valid_to"], "identity")
    spans = identity.select(F.col(id_col).alias("_i"), F.col("valid_from").alias("_a"), F.col("valid_to").alias("_b"), F.col(PERMANENT).alias("_p"))
    pairs = panel.select(*key).join(spans, (F.col(id_col) == F.col("_i")) & _covers(F.col(TIMESTAMP), F.col("_a"), F.col("_b")))
    first = pairs.groupBy(*key).agg(F.min(F.struct("_a", "_p"))["_p"].alias(PERMANENT))
    return panel.join(first, list(key), "left").withColumn(PERMANENT, F.coalesce(PERMANENT, id_col))


def as_of(panel: DataFrame, reference: DataFrame | None, values: Sequence[str], *, id_col: str = SYMBOL, available: str = "available_at", sequence: str | None = None, fail_open: bool = False, strict: bool = True, keep_time: bool = False) -> DataFrame:
    """Adds, per row, the values of the latest reference row with available_at <= timestamp.

    The latest row counts even where its values are null. Ties in available_at go to the greatest
    ``sequence`` (without one, to the greatest values). Both sides meet in one window per id, sorted once:
    no row pairs are built, however many reference rows an id has.
    """
    if not values:
        raise PanelError("name at least one value column")
    taken = [v for v in values if v in panel.columns]
    if taken:
        raise PanelError(f"the panel already holds {taken}")
    if reference is None or available not in reference.columns:
        if fail_open:
            types = {} if reference is None else {f.name: f.dataType for f in reference.schema.fields}
            return panel.select("*", *(F.lit(None).cast(types.get(v, "double")).alias(v) for v in values))
        raise PanelError(f"reference lacks {available}")
    require(reference, [id_col, available, *values], "reference")
    if strict and not reference.where(F.col(available).isNull()).isEmpty():
        raise PanelError(f"reference holds null {available}")
    order = [sequence] if sequence else list(values)
    fact = F.struct(F.col(available).alias("_at"), *(F.col(v).alias(v) for v in values))
    right = reference.select(F.col(id_col).alias("_id"), F.col(available).cast(panel.schema[TIMESTAMP].dataType).alias("_t"), F.lit(0).alias("_side"), F.struct(*order).alias("_seq"), fact.alias("_fact"), F.lit(None).cast(panel.schema).alias("_row"))
    left = panel.select(F.col(id_col).alias("_id"), F.col(TIMESTAMP).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema["_seq"].dataType).alias("_seq"), F.lit(None).cast(right.schema["_fact"].dataType).alias("_fact"), F.struct(*(F.col(c) for c in panel.columns)).alias("_row"))
    w = Window.partitionBy("_id").orderBy("_t", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    met = right.unionByName(left).withColumn("_last", F.last("_fact", ignorenulls=True).over(w)).where("_side = 1")
    time = [F.col("_last._at").alias(available)] if keep_time else []
    return met.select("_row.*", *time, *(F.col(f"_last.{v}").alias(v) for v in values))


def as_of_coverage(joined: DataFrame, values: Sequence[str]) -> dict:
    """Matched and unmatched rows of each value column; a matched null counts as unmatched."""
    here = [v for v in values if v in joined.columns]
    got = joined.agg(F.count(F.lit(1)).alias("_n"), *(F.count(v).alias(v) for v in here)).first()
    columns = {v: {"present": True, "matched": got[v], "unmatched": got["_n"] - got[v]} if v in here else {"present": False} for v in values}
    return {"columns": columns, "rows": got["_n"]}
