"""Synthetic panels with known provenance: one clean, and one for each thing that can be wrong with it."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import with_labels
from .contracts import FeatureDefinition, FeatureRegistry
from .dataset import Panel

FEATURE, LABEL = "bar_volume", "label_forward_return_1d"
OLD, NEW, PERMANENT = "AAA1", "AAA2", "ID-AAA"
DIRTY = ("delisted", "broken_identity", "missing_availability", "ambiguous_adjustment", "zone_mismatch", "too_short")


def registry() -> FeatureRegistry:
    return FeatureRegistry([FeatureDefinition(FEATURE, "volume", "traded volume of the bar", "double", "bars", pit_safe=True)])


def day(n: int) -> dt.datetime:
    return dt.datetime(2024, 1, n)


ACTIONS = "permanent_id string, symbol string, action_type string, effective_date timestamp_ntz, ratio double, cash_amount double, adjustment_factor double, available_at timestamp_ntz"


def corporate_actions(spark: SparkSession) -> DataFrame:
    """What happened to the identity: a split under its first ticker and a dividend under its second, each known on its day.

    As the reference of an as-of join they show which factor was known when, without a bar being adjusted.
    """
    rows = [(PERMANENT, OLD, "split", day(5), 2.0, None, 0.5, day(5)), (PERMANENT, NEW, "cash_dividend", day(9), None, 0.5, 0.99, day(9))]
    return spark.createDataFrame(rows, ACTIONS)


def clean(spark: SparkSession) -> tuple[Panel, dict]:
    """Ten bars of one identity under two tickers (the change falls on day 7), a split and a dividend on record."""
    rows = [(OLD if d <= 6 else NEW, day(d), 100.0 + d, 1000.0 + d) for d in range(2, 12)]
    bars = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, close double, volume double")
    spans = [(PERMANENT, OLD, day(2), day(6)), (PERMANENT, NEW, day(7), day(11))]
    identity = spark.createDataFrame(spans, "permanent_id string, symbol string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    reference = spark.createDataFrame([(OLD, day(2), 1.0), (OLD, day(5), 0.5), (NEW, day(7), 0.5), (NEW, day(9), 0.49)], "symbol string, available_at timestamp_ntz, adjustment_factor double")
    panel = Panel(
        labels=with_labels(bars.select("symbol", "timestamp", "close"), 1),
        label_columns=[LABEL],
        features=bars.select("symbol", "timestamp", F.col("volume").alias(FEATURE)),
        feature_columns=[FEATURE],
        universe=identity.select("symbol", "valid_from", "valid_to"),
        identity=identity,
        reference=reference,
        reference_columns=["adjustment_factor"],
        label_zone="UTC",
        feature_zone="UTC",
    )
    return panel, {"data_declaration": {"corporate_actions_status": "complete", "adjustment_status": "none_needed"}}


def dirty(spark: SparkSession, fault: str) -> tuple[Panel, dict]:
    """The clean panel with exactly one guarantee broken."""
    panel, declaration = clean(spark)
    if fault == "delisted":
        panel = replace(panel, universe=panel.universe.where(F.col("symbol") == OLD))
    elif fault == "broken_identity":
        panel = replace(panel, identity=None)
    elif fault == "missing_availability":
        panel = replace(panel, reference=panel.reference.drop("available_at"))
    elif fault == "ambiguous_adjustment":
        declaration = {"data_declaration": {"corporate_actions_status": "partial"}}
    elif fault == "zone_mismatch":
        panel = replace(panel, feature_zone="America/New_York")
    elif fault == "too_short":
        early = F.col("timestamp") <= F.lit(day(2))
        panel = replace(panel, labels=panel.labels.where(early), features=panel.features.where(early))
    else:
        raise KeyError(fault)
    return panel, declaration
