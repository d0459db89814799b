"""The gate for target-weight messages, over whole tables of them.

The first violated rule names the rejection; null means that the message may be acted on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PanelError

SCHEMA_MAJOR = 1
# Required fields in the order in which they are checked, and the message schema.
REQUIRED = ("schema_version", "signal_id", "valid_until", "mode", "rebalance_type", "backtest_run_id", "data_declaration_id")
MESSAGE = """schema_version string, signal_id string, created_at timestamp, as_of timestamp, valid_until timestamp,
mode string, rebalance_type string, generated_by string, approval_required boolean, approval_status string,
model_id string, feature_set_id string, universe_id string, backtest_run_id string, data_declaration_id string, horizon string,
targets array<struct<symbol:string,asset_class:string,target_weight:double,conviction:double,max_position_weight:double,reason_codes:array<string>,reduce_only:boolean>>,
metadata struct<expected_turnover:double,expected_cost_bps:double,risk_score:double,target_gross_exposure:double,target_net_exposure:double>"""


@dataclass(frozen=True)
class Limits:
    """Process-side facts; exposure limits at or below zero are not enforced."""

    mode: str = "paper"
    allow_live: bool = False
    max_gross: float = 0.0
    max_net: float = 0.0


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    return raw.select(F.from_json(column, MESSAGE).alias("m")).select("m.*")


def major(version: Column) -> Column:
    """The part before the first dot as an integer; null if it is none."""
    head = F.split_part(version, F.lit("."), F.lit(1))
    return F.when(head.rlike(r"^[+-]?[0-9]+$"), head.try_cast("int"))


def increases_exposure(rebalance: Column) -> Column:
    return F.coalesce(rebalance == "target_weight", F.lit(False))


def within_limits(gross: Column, net: Column, limits: Limits) -> Column:
    ok = F.lit(True)
    if limits.max_gross > 0:
        ok &= F.coalesce(gross, F.lit(0.0)) <= limits.max_gross
    if limits.max_net > 0:
        ok &= F.abs(F.coalesce(net, F.lit(0.0))) <= limits.max_net
    return ok


def validate(messages: DataFrame, now: Column, limits: Limits) -> DataFrame:
    """Adds rejection_reason."""
    c = F.col
    rules: list[tuple[str, Column]] = []
    for name in REQUIRED:
        empty = c(name).isNull() if name == "valid_until" else (c(name).isNull() | (c(name) == ""))
        rules.append((f"missing_{name}", empty))
    version = major(c("schema_version"))
    rules += [
        ("invalid_schema_version", version.isNull()),
        ("unsupported_schema_major", version != SCHEMA_MAJOR),
        ("expired", now > c("valid_until")),
        ("mode_mismatch", c("mode") != limits.mode),
    ]
    if not limits.allow_live:
        rules.append(("live_not_allowed", c("mode") == "live"))
    gross, net = c("metadata.target_gross_exposure"), c("metadata.target_net_exposure")
    if limits.max_gross > 0:
        rules.append(("gross_exposure", gross > limits.max_gross))
    if limits.max_net > 0:
        rules.append(("net_exposure", F.abs(net) > limits.max_net))
    unapproved = F.coalesce(c("approval_required"), F.lit(False)) & (F.coalesce(c("approval_status"), F.lit("")) != "approved")
    rules.append(("approval_missing", increases_exposure(c("rebalance_type")) & unapproved))
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(broken, name).otherwise(reason)
    return messages.withColumn("rejection_reason", reason)


def orders(messages: DataFrame) -> DataFrame:
    """One row per target with its idempotent client_order_id, signal:symbol."""
    rows = messages.select("signal_id", F.explode("targets").alias("t"))
    return rows.select("signal_id", "t.symbol", "t.target_weight", F.concat_ws(":", "signal_id", "t.symbol").alias("client_order_id"))


def position_weights(wanted: DataFrame, positions: DataFrame, equity: Column) -> DataFrame:
    """Adds current_weight = quantity * average price / equity; 0 without a position or with equity at or below 0."""
    held = positions.select(F.col("symbol"), F.col("qty").alias("_q"), F.col("avg_price").alias("_p"))
    value = F.when(equity > 0, F.try_divide(F.col("_q") * F.col("_p"), equity))
    return wanted.join(held, "symbol", "left").withColumn("current_weight", F.coalesce(value, F.lit(0.0))).drop("_q", "_p")


def check_boot(mode: str, allow_live_trading: bool, require_human_approval: bool) -> None:
    """Live mode starts only if it is allowed and a human approves."""
    if mode == "live" and not (allow_live_trading and require_human_approval):
        raise PanelError("live mode needs allow_live_trading and require_human_approval")
