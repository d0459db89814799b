"""The registered queries, each with its SQL oracle, over bars derived from the star-schema tables.

A bar is one brand's line items on one ship date; the auxiliary tables (universe, identity, reference,
weights, signals) are rules over brands and dates, so both engines derive the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features, labels
from .operators import backtest, distribution, nullmodels, signals, splits, temporal
from .plans import dataset, fingerprints, reports
from .schema import KEY, SYMBOL, TIMESTAMP, duplicate_keys, faults, missing_symbols, shared_symbols
from .session import saved, shared_dir
from .sources import bars as source
from .sources.rest import flatten
from .sources.sinks import write_bars
from .streaming import bars as streaming

AS_OF = "1997-06-30"
START = "1995-07-01"
HORIZON = 5
SEED = 11
COST = backtest.CostModel(1.0, 5.0)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BARS_SQL = """
SELECT p_brand AS symbol, l_shipdate AS "timestamp",
  arg_min(l_extendedprice, row(l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS "open",
  max(l_extendedprice) AS high, min(l_extendedprice) AS low,
  arg_max(l_extendedprice, row(l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS "close",
  CAST(sum(l_quantity) AS BIGINT) AS volume, count(*) AS trade_count,
  sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_quantity AS DECIMAL(10, 0)))::DOUBLE / sum(l_quantity) AS vwap
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_shipdate"""
_BRANDS_SQL = "SELECT DISTINCT p_brand AS symbol, CAST(substr(p_brand, 7) AS INT) // 5 AS a, CAST(substr(p_brand, 7) AS INT) % 5 AS b FROM part"
_WITH = {
    "bars": _BARS_SQL,
    "brands": _BRANDS_SQL,
    "universe": """SELECT symbol, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (a * 60) AS valid_from, TIMESTAMP '1996-06-01' + INTERVAL 1 DAY * (b * 90) AS valid_to FROM brands WHERE a < 5
UNION ALL SELECT symbol, TIMESTAMP '1998-01-01' + INTERVAL 1 DAY * (a * 30), NULL FROM brands WHERE a < 5 AND b % 2 = 0""",
    "identity": """SELECT 'ID-' || a || b || '-A' AS permanent_id, symbol, TIMESTAMP '1992-01-01' AS valid_from, TIMESTAMP '1998-06-30' AS valid_to FROM brands WHERE b <> 3
UNION ALL SELECT 'ID-' || a || b || '-B', symbol, TIMESTAMP '1998-07-01', NULL FROM brands WHERE b <> 3""",
    "reference": """SELECT symbol, date_trunc('month', "timestamp") + INTERVAL 40 DAY AS available_at, CASE WHEN month("timestamp") % 3 = 0 THEN NULL ELSE max("close") END AS ref_close
FROM bars GROUP BY symbol, date_trunc('month', "timestamp"), month("timestamp")""",
    "weighted": """SELECT bars.*, ((dayofyear("timestamp") * 7 + a * 13 + b * 29) % 21 - 10) / 10.0::DOUBLE AS weight FROM bars JOIN brands USING (symbol)""",
    "labelled": f"""SELECT *, lead("close", {HORIZON}) OVER w / "close" - 1 AS label_forward_return_{HORIZON}d,
CASE WHEN "close" IS NULL THEN 'source_price_null' WHEN lead("timestamp", {HORIZON}) OVER w IS NULL THEN 'insufficient_future_rows' WHEN lead("close", {HORIZON}) OVER w IS NULL THEN 'future_price_null' END AS target_null_reason
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY "timestamp")""",
    "returns": """SELECT *, "close" / lag("close") OVER w - 1 AS daily_return, ln("close" / lag("close") OVER w) AS log_return FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY "timestamp")""",
    "featured": """SELECT *, CASE WHEN count(log_return) OVER w20 >= 20 THEN stddev_samp(log_return) OVER w20 * sqrt(252) END AS rolling_vol_20d,
CASE WHEN count("close") OVER w5 >= 5 THEN avg("close") OVER w5 END AS sma_5d, CASE WHEN count("close") OVER w20 >= 20 THEN avg("close") OVER w20 END AS sma_20d,
CASE WHEN count(volume) OVER w20 >= 20 THEN avg(volume::DOUBLE) OVER w20 END AS rolling_vol_volume_20d FROM returns
WINDOW w20 AS (PARTITION BY symbol ORDER BY "timestamp" ROWS 19 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY "timestamp" ROWS 4 PRECEDING)""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "timestamp") AS rn FROM bars""",
    "ema": """SELECT a.symbol, a."timestamp", CASE WHEN a.rn >= 5 THEN sum(b."close" * pow(1 - 2.0 / 6, a.rn - b.rn)) FILTER (b.rn > a.rn - 100) / sum(pow(1 - 2.0 / 6, a.rn - b.rn)) FILTER (b.rn > a.rn - 100) END AS ema_5d,
CASE WHEN a.rn >= 20 THEN sum(b."close" * pow(1 - 2.0 / 21, a.rn - b.rn)) / sum(pow(1 - 2.0 / 21, a.rn - b.rn)) END AS ema_20d
FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND b.rn <= a.rn AND b.rn > a.rn - 450 GROUP BY a.symbol, a."timestamp", a.rn""",
    "membership": """SELECT bars.*, CASE WHEN EXISTS (SELECT 1 FROM universe u WHERE u.symbol = bars.symbol AND bars."timestamp" >= u.valid_from AND (u.valid_to IS NULL OR bars."timestamp" <= u.valid_to)) THEN 'in_universe' ELSE 'not_in_universe' END AS universe_status FROM bars""",
    "resolved": """SELECT b.symbol, b."timestamp", coalesce(arg_min(i.permanent_id, row(i.valid_from, i.permanent_id)), b.symbol) AS permanent_id
FROM bars b LEFT JOIN identity i ON b.symbol = i.symbol AND b."timestamp" >= i.valid_from AND (i.valid_to IS NULL OR b."timestamp" <= i.valid_to) GROUP BY b.symbol, b."timestamp" """,
    "known": """SELECT b.symbol, b."timestamp", r.ref_close FROM bars b ASOF LEFT JOIN reference r ON b.symbol = r.symbol AND b."timestamp" >= r.available_at""",
    "assembled": f"""SELECT l.symbol, l."timestamp", v.volume::DOUBLE AS bar_volume, l.label_forward_return_{HORIZON}d, k.ref_close, i.permanent_id, m.universe_status,
lag(l."timestamp") OVER (PARTITION BY l.symbol ORDER BY l."timestamp") AS feature_cutoff
FROM labelled l LEFT JOIN bars v USING (symbol, "timestamp") JOIN known k USING (symbol, "timestamp") JOIN resolved i USING (symbol, "timestamp") JOIN membership m USING (symbol, "timestamp")""",
    "eligible": f"""SELECT *, CASE WHEN feature_cutoff IS NULL THEN 'insufficient_feature_history' WHEN universe_status = 'not_in_universe' THEN 'not_in_universe' WHEN label_forward_return_{HORIZON}d IS NULL THEN 'all_labels_null' ELSE 'eligible' END AS eligibility_reason FROM assembled""",
    "axis": """SELECT "timestamp", row_number() OVER (ORDER BY "timestamp") - 1 AS position, count(*) OVER () AS n FROM (SELECT DISTINCT "timestamp" FROM bars)""",
    "edges": """SELECT *, greatest(1, CAST(floor(n * 0.6) AS BIGINT)) AS te, least(greatest(greatest(1, CAST(floor(n * 0.6) AS BIGINT)) + 1, CAST(floor(n * 0.8) AS BIGINT)), n - 1) AS ve FROM axis""",
    "split": f"""SELECT "timestamp", position, CASE WHEN position < te AND position + {HORIZON} >= te THEN 'purged' WHEN position < te AND te - position <= 10 THEN 'embargoed' WHEN position < te THEN 'train' WHEN position < ve THEN 'validation' ELSE 'test' END AS split FROM edges""",
    "dirty": """SELECT CASE WHEN volume % 97 = 0 THEN '  ' ELSE symbol END AS symbol, "timestamp", CASE day("timestamp") WHEN 13 THEN 'NaN'::DOUBLE WHEN 14 THEN -"close" WHEN 15 THEN NULL ELSE "close" END AS "close",
CASE dayofyear("timestamp") % 50 WHEN 0 THEN NULL WHEN 1 THEN 'Infinity'::DOUBLE ELSE weight END AS weight FROM weighted""",
    "scored": """SELECT symbol, "timestamp", weight, lead("close") OVER (PARTITION BY symbol ORDER BY "timestamp") / "close" - 1 AS fwd FROM weighted""",
    "draws": f"""SELECT *, md5('{SEED}' || '|' || symbol || '|' || strftime("timestamp", '%Y-%m-%d %H:%M:%S')) AS h1, md5('{SEED + 1}a' || '|' || symbol || '|' || strftime("timestamp", '%Y-%m-%d %H:%M:%S')) AS h2, md5('{SEED + 1}b' || '|' || symbol || '|' || strftime("timestamp", '%Y-%m-%d %H:%M:%S')) AS h3 FROM scored""",
    "randomised": """SELECT symbol, "timestamp", fwd, -1 + 2 * (CAST('0x' || substr(h1, 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE) AS weight FROM draws""",
    "shuffled": """SELECT a.symbol, a."timestamp", a.fwd, b.weight FROM (SELECT *, row_number() OVER (ORDER BY h2, symbol, "timestamp") AS i FROM draws) a JOIN (SELECT weight, row_number() OVER (ORDER BY h3, symbol, "timestamp") AS i FROM draws) b USING (i)""",
    "shifted": """SELECT symbol, "timestamp", fwd, coalesce(lag(weight, 1, 0.0) OVER (PARTITION BY symbol ORDER BY "timestamp"), 0.0) AS weight FROM scored""",
    "leaked": """SELECT symbol, "timestamp", fwd, coalesce(sign(fwd)::DOUBLE, 0.0) AS weight FROM scored""",
    "variants": """SELECT 'baseline' AS variant, 0.0006::DOUBLE AS rate, symbol, "timestamp", fwd, weight FROM scored UNION ALL SELECT 'cost_stress_2x', 0.0011, symbol, "timestamp", fwd, weight FROM scored
UNION ALL SELECT 'cost_stress_5x', 0.0026, symbol, "timestamp", fwd, weight FROM scored UNION ALL SELECT 'random_weights', 0.0006, symbol, "timestamp", fwd, weight FROM randomised
UNION ALL SELECT 'shuffled_weights', 0.0006, symbol, "timestamp", fwd, weight FROM shuffled UNION ALL SELECT 'shifted_weights', 0.0006, symbol, "timestamp", fwd, weight FROM shifted
UNION ALL SELECT 'future_leak', 0.0006, symbol, "timestamp", fwd, weight FROM leaked""",
    "traded": """SELECT variant, "timestamp", weight * fwd AS pnl, abs(weight - lag(weight, 1, 0.0) OVER (PARTITION BY variant, symbol ORDER BY "timestamp")) AS turnover, rate FROM variants WHERE fwd IS NOT NULL""",
    "netted": """SELECT variant, "timestamp", sum(pnl) AS gross_return, sum(turnover * rate) AS cost, sum(turnover) AS turnover, sum(pnl) - sum(turnover * rate) AS net_return FROM traded GROUP BY variant, "timestamp" """,
    "curve": """SELECT *, product(1 + net_return) OVER (PARTITION BY variant ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING) AS equity FROM netted""",
    "drawn": """SELECT *, CASE WHEN max(equity) OVER w > 0 THEN least(0.0, equity / max(equity) OVER w - 1) ELSE 0.0 END AS drawdown FROM curve WINDOW w AS (PARTITION BY variant ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING)""",
    "measured": """SELECT variant, CASE WHEN count(*) < 2 OR stddev_samp(net_return) = 0 THEN 0.0 ELSE avg(net_return) / stddev_samp(net_return) * sqrt(252) END AS sharpe,
CASE WHEN sum(CASE WHEN net_return < 0 THEN 1 ELSE 0 END) = 0 THEN 0.0 ELSE avg(net_return) / sqrt(sum(CASE WHEN net_return < 0 THEN net_return * net_return ELSE 0 END) / count(*)) * sqrt(252) END AS sortino,
min(drawdown) AS max_drawdown, avg(turnover) * 252 AS annual_turnover, arg_max(equity, "timestamp") - 1 AS total_return,
CASE WHEN arg_max(equity, "timestamp") > 0 THEN pow(greatest(arg_max(equity, "timestamp"), 1e-300), 252.0 / count(*)) - 1 ELSE -1.0 END AS cagr, count(*) AS n_periods FROM drawn GROUP BY variant""",
    "signals_in": """SELECT o_orderkey, o_orderkey % 17 AS k, CASE WHEN o_orderkey % 11 = 0 THEN '2.0.0' WHEN o_orderkey % 23 = 0 THEN 'x.1' WHEN o_orderkey % 29 = 0 THEN '' ELSE '1.1.0' END AS schema_version, 'sig-' || o_orderkey AS signal_id,
o_orderdate AS valid_until, CASE WHEN o_orderkey % 7 = 0 THEN 'live' ELSE 'paper' END AS mode, CASE WHEN o_orderkey % 5 = 0 THEN 'reduce_only' ELSE 'target_weight' END AS rebalance_type,
o_orderkey % 3 = 0 AS approval_required, CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'pending' END AS approval_status, (o_orderkey % 13) / 10.0::DOUBLE AS gross, (o_orderkey % 9 - 4) / 10.0::DOUBLE AS net FROM orders""",
}


def sql(last: str) -> str:
    """The query with the common tables it needs."""
    import re

    used: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in _WITH:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                seen.add(name)
                visit(_WITH[name])
                used.append(name)

    visit(last)
    return "WITH " + ", ".join(f"{n} AS ({_WITH[n]})" for n in used) + " " + last if used else last


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial aggregation below the one shuffle by (symbol, day)."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias(SYMBOL))
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    price = F.col("l_extendedprice")
    return items.join(parts, items.l_partkey == parts.p_partkey).groupBy(SYMBOL, F.col("l_shipdate").alias(TIMESTAMP)).agg(
        F.min(order)["l_extendedprice"].alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max(order)["l_extendedprice"].alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
        (F.sum(price.cast("decimal(18,2)") * F.col("l_quantity").cast("decimal(10,0)")).cast("double") / F.sum("l_quantity")).alias("vwap"),
    )


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("p_brand", 7, 9).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias(SYMBOL), F.floor(number / 5).cast("int").alias("a"), (number % 5).alias("b")).distinct()


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = brands(spark, sf_dir).where("a < 5")
    first = listed.selectExpr("symbol", "timestamp_ntz'1995-01-01' + make_dt_interval(a * 60) AS valid_from", "timestamp_ntz'1996-06-01' + make_dt_interval(b * 90) AS valid_to")
    return first.unionByName(listed.where("b % 2 = 0").selectExpr("symbol", "timestamp_ntz'1998-01-01' + make_dt_interval(a * 30) AS valid_from", "CAST(NULL AS timestamp_ntz) AS valid_to"))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = brands(spark, sf_dir).where("b <> 3")
    first = named.selectExpr("concat('ID-', a, b, '-A') AS permanent_id", "symbol", "timestamp_ntz'1992-01-01' AS valid_from", "timestamp_ntz'1998-06-30' AS valid_to")
    return first.unionByName(named.selectExpr("concat('ID-', a, b, '-B') AS permanent_id", "symbol", "timestamp_ntz'1998-07-01' AS valid_from", "CAST(NULL AS timestamp_ntz) AS valid_to"))


def reference(own: DataFrame) -> DataFrame:
    month = F.date_trunc("month", TIMESTAMP).cast("timestamp_ntz")
    monthly = own.groupBy(SYMBOL, month.alias("m")).agg(F.max("close").alias("top"))
    return monthly.select(SYMBOL, (F.col("m") + F.expr("INTERVAL 40 DAY")).alias("available_at"), F.when(F.month("m") % 3 != 0, F.col("top")).alias("ref_close"))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = bars(spark, sf_dir).join(brands(spark, sf_dir), SYMBOL)
    return joined.withColumn("weight", ((F.dayofyear(TIMESTAMP) * 7 + F.col("a") * 13 + F.col("b") * 29) % 21 - 10) / 10.0).drop("a", "b")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.with_labels(bars(spark, sf_dir), HORIZON, strict=False)


LABEL = labels.label_name(HORIZON)


def _rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"SELECT * FROM bars WHERE \"timestamp\" >= DATE '{START}' AND \"timestamp\"::DATE <= DATE '{AS_OF}'")
def pit_scan(spark, sf_dir):
    return source.point_in_time(bars(spark, sf_dir), as_of=AS_OF, start=START, strict=False)


@query("SELECT count(*) AS n FROM bars")
def bar_count(spark, sf_dir):
    return bars(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT symbol FROM bars")
def symbols_distinct(spark, sf_dir):
    return source.available_symbols(bars(spark, sf_dir))


@query("SELECT symbol, \"timestamp\", \"close\", volume FROM bars WHERE symbol IN ('Brand#12', 'Brand#23') AND \"timestamp\"::DATE BETWEEN DATE '1995-03-01' AND DATE '1996-12-31'")
def symbol_date_filter(spark, sf_dir):
    named = bars(spark, sf_dir).where(F.col(SYMBOL).isin("Brand#12", "Brand#23"))
    return source.select_bars(named, start="1995-03-01", end="1996-12-31", columns=[SYMBOL, TIMESTAMP, "close", "volume"])


@query(f"SELECT count(*) AS violations FROM bars WHERE \"timestamp\"::DATE > DATE '{AS_OF}'")
def lookahead_violations(spark, sf_dir):
    return source.lookahead(bars(spark, sf_dir), AS_OF)


@query('SELECT symbol, "timestamp", round(daily_return, 8) AS daily_return FROM returns')
def daily_return(spark, sf_dir):
    return bars(spark, sf_dir).select(*KEY, F.round(features.daily_return(), 8).alias("daily_return"))


@query('SELECT symbol, "timestamp", round(log_return, 8) AS log_return FROM returns')
def log_return(spark, sf_dir):
    return bars(spark, sf_dir).select(*KEY, F.round(features.log_return(), 8).alias("log_return"))


@query('SELECT symbol, "timestamp", round(rolling_vol_20d, 8) AS rolling_vol_20d FROM featured')
def rolling_vol(spark, sf_dir):
    with_returns = bars(spark, sf_dir).withColumn("log_return", features.log_return())
    return with_returns.select(*KEY, F.round(features.rolling_volatility(20), 8).alias("rolling_vol_20d"))


@query('SELECT symbol, "timestamp", round(sma_5d, 4) AS sma_5d, round(sma_20d, 4) AS sma_20d FROM featured')
def sma(spark, sf_dir):
    return bars(spark, sf_dir).select(*KEY, F.round(features.sma(5), 4).alias("sma_5d"), F.round(features.sma(20), 4).alias("sma_20d"))


@query('SELECT symbol, "timestamp", round(ema_5d, 3) AS ema_5d, round(ema_20d, 3) AS ema_20d FROM ema')
def ema(spark, sf_dir):
    return _rounded(features.with_ema(bars(spark, sf_dir).select(*KEY, "close"), (5, 20)), "ema_5d", "ema_20d", digits=3).drop("close")


@query('SELECT symbol, "timestamp", round(rolling_vol_volume_20d, 4) AS rolling_vol_volume_20d FROM featured')
def rolling_volume(spark, sf_dir):
    return bars(spark, sf_dir).select(*KEY, F.round(features.rolling_volume(20), 4).alias("rolling_vol_volume_20d"))


@query("""SELECT f.symbol, f."timestamp", round(daily_return, 7) AS daily_return, round(log_return, 7) AS log_return, round(rolling_vol_20d, 7) AS rolling_vol_20d, round(sma_5d, 4) AS sma_5d, round(sma_20d, 4) AS sma_20d,
round(ema_5d, 3) AS ema_5d, round(ema_20d, 3) AS ema_20d, round(rolling_vol_volume_20d, 4) AS rolling_vol_volume_20d FROM featured f JOIN ema USING (symbol, "timestamp")""")
def feature_pipeline(spark, sf_dir):
    made = features.with_features(bars(spark, sf_dir))
    made = _rounded(made.select(*KEY, *features.FEATURES), "daily_return", "log_return", "rolling_vol_20d", digits=7)
    return _rounded(_rounded(made, "sma_5d", "sma_20d", "rolling_vol_volume_20d", digits=4), "ema_5d", "ema_20d", digits=3)


_SETS = "SELECT symbol, \"timestamp\", 'set' AS feature_set_id, round(sma_5d, 4) AS sma_5d FROM featured"


@query(_SETS)
def feature_concat(spark, sf_dir):
    made = bars(spark, sf_dir).select(*KEY, F.lit("set").alias("feature_set_id"), F.round(features.sma(5), 4).alias("sma_5d"))
    old, new = made.where(F.year(TIMESTAMP) < 1998), made.where(F.year(TIMESTAMP) >= 1998)
    return source.concat_features([old, new], features.FEATURES)


@query(f"SELECT b.symbol, b.\"timestamp\", b.\"close\", round(f.sma_20d, 4) AS sma_20d FROM bars b JOIN featured f USING (symbol, \"timestamp\") WHERE f.sma_20d IS NOT NULL AND b.\"timestamp\"::DATE BETWEEN DATE '{START}' AND DATE '{AS_OF}'")
def research_join(spark, sf_dir):
    own = bars(spark, sf_dir)
    made = own.select(*KEY, F.round(features.sma(20), 4).alias("sma_20d")).where("sma_20d is not null")
    joined = dataset.research_dataset(own, made, start=START, as_of=AS_OF, feature_columns=["sma_20d"], strict=False)
    return joined.select(*KEY, "close", "sma_20d")


@query(f'SELECT symbol, "timestamp", round({LABEL}, 8) AS {LABEL}, target_null_reason FROM labelled')
def forward_label(spark, sf_dir):
    return labelled(spark, sf_dir).select(*KEY, F.round(LABEL, 8).alias(LABEL), labels.REASON)


@query("SELECT coalesce(target_null_reason, 'UNSPECIFIED') AS target_null_reason, count(*) AS n FROM labelled GROUP BY 1")
def label_null_reason(spark, sf_dir):
    return labels.count_by(labelled(spark, sf_dir), labels.REASON)


@query(f'SELECT count(*) AS n_rows, count({LABEL}) AS n_labelled, count(*) - count({LABEL}) AS n_null, count(DISTINCT symbol) AS n_symbols, min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp FROM labelled')
def label_summary(spark, sf_dir):
    return labels.label_summary(labelled(spark, sf_dir), LABEL)


_STATS = f"""count(*) AS n_total, count({LABEL}) AS n_valid, count(*) - count({LABEL}) AS n_null, 0::BIGINT AS n_non_finite, round(100.0 * (count(*) - count({LABEL})) / count(*), 6) AS null_pct, round(avg({LABEL}), 7) AS mean, round(stddev_samp({LABEL}), 7) AS std,
round(min({LABEL}), 7) AS "min", round(max({LABEL}), 7) AS "max", round(quantile_cont({LABEL}, 0.01), 7) AS p01, round(quantile_cont({LABEL}, 0.05), 7) AS p05, round(quantile_cont({LABEL}, 0.5), 7) AS p50, round(quantile_cont({LABEL}, 0.95), 7) AS p95, round(quantile_cont({LABEL}, 0.99), 7) AS p99"""
_MEASURES = ("mean", "std", "min", "max", *distribution.PERCENTILES)


def _stats(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(df, *_MEASURES, digits=7), "null_pct", digits=6)


@query(f"SELECT {_STATS}, count(*) FILTER (abs({LABEL}) > 0.5) AS n_extreme FROM labelled")
def label_distribution(spark, sf_dir):
    return _stats(distribution.distribution(labelled(spark, sf_dir), LABEL, extreme=0.5))


@query(f"SELECT symbol, {_STATS} FROM labelled GROUP BY symbol")
def label_by_symbol(spark, sf_dir):
    return _stats(distribution.by_symbol(labelled(spark, sf_dir), LABEL))


@query(f"SELECT strftime(\"timestamp\", '%Y-%m') AS month, {_STATS} FROM labelled GROUP BY 1")
def label_by_month(spark, sf_dir):
    return _stats(distribution.by_month(labelled(spark, sf_dir), LABEL))


@query(f"""SELECT CASE WHEN grouping(symbol) = 0 THEN 'symbol' WHEN grouping(month) = 0 THEN 'month' ELSE 'all' END AS level, symbol, month, {_STATS}
FROM (SELECT *, strftime("timestamp", '%Y-%m') AS month FROM labelled) GROUP BY GROUPING SETS ((), (symbol), (month))""")
def label_grouping_sets(spark, sf_dir):
    return _stats(distribution.grouping_sets(labelled(spark, sf_dir), LABEL))


@query('SELECT symbol, "timestamp", universe_status FROM membership')
def universe_membership(spark, sf_dir):
    return temporal.universe_membership(bars(spark, sf_dir).select(*KEY), universe(spark, sf_dir), strict=False)


@query("SELECT * FROM resolved")
def identity_resolution(spark, sf_dir):
    return temporal.resolve_identity(bars(spark, sf_dir).select(*KEY), identity(spark, sf_dir))


@query("SELECT * FROM known")
def asof_reference(spark, sf_dir):
    own = saved(bars(spark, sf_dir).select(*KEY, "close"))
    return temporal.as_of(own.select(*KEY), reference(own), ["ref_close"], strict=False)


@query("SELECT count(ref_close) AS matched, count(*) - count(ref_close) AS unmatched FROM known")
def asof_coverage(spark, sf_dir):
    joined = asof_reference(spark, sf_dir)
    return joined.agg(F.count("ref_close").alias("matched"), F.count_if(F.col("ref_close").isNull()).alias("unmatched"))


def _assembled(spark, sf_dir) -> DataFrame:
    """The panel's inputs are bars as a table: line items are read once, not once an input."""
    own = saved(bars(spark, sf_dir))
    panel = dataset.Panel(
        labels=labels.with_labels(own.select(*KEY, "close"), HORIZON, strict=False),
        label_columns=[LABEL],
        features=own.select(*KEY, F.col("volume").cast("double").alias("bar_volume")),
        feature_columns=["bar_volume"],
        universe=universe(spark, sf_dir),
        identity=identity(spark, sf_dir),
        reference=reference(own),
        reference_columns=["ref_close"],
    )
    return dataset.assemble_rows(panel, strict=False)


@query(f"SELECT symbol, \"timestamp\", bar_volume, round({LABEL}, 8) AS {LABEL}, ref_close, permanent_id, universe_status, feature_cutoff, {HORIZON} AS max_label_horizon, eligibility_reason = 'eligible' AS eligible, eligibility_reason FROM eligible")
def ml_assemble(spark, sf_dir):
    return _rounded(_assembled(spark, sf_dir), LABEL)


@query("SELECT eligibility_reason, count(*) AS n FROM eligible GROUP BY 1")
def eligibility_counts(spark, sf_dir):
    return labels.count_by(_assembled(spark, sf_dir), "eligibility_reason")


@query("SELECT universe_status, count(*) AS n FROM eligible GROUP BY 1")
def universe_coverage(spark, sf_dir):
    return labels.count_by(_assembled(spark, sf_dir), "universe_status")


def _nulls_sql(column: str) -> str:
    e = "(eligibility_reason = 'eligible')"
    return f"""SELECT '{column}' AS column_name, count(*) - count({column}) AS null_count, round((count(*) - count({column}))::DOUBLE / count(*), 8) AS null_fraction, count(*) FILTER ({e} AND {column} IS NULL) AS eligible_null_count,
round(coalesce(count(*) FILTER ({e} AND {column} IS NULL)::DOUBLE / nullif(count(*) FILTER ({e}), 0), 0.0), 8) AS eligible_null_fraction FROM eligible"""


@query(" UNION ALL ".join(_nulls_sql(c) for c in ("bar_volume", LABEL, "ref_close")))
def null_matrix(spark, sf_dir):
    found = distribution.null_matrix(_assembled(spark, sf_dir), ["bar_volume", LABEL, "ref_close"], F.col("eligible"))
    return _rounded(found, "null_fraction", "eligible_null_fraction")


@query('SELECT symbol, "timestamp", split FROM bars JOIN split USING ("timestamp")')
def temporal_split(spark, sf_dir):
    return splits.temporal_split(bars(spark, sf_dir).select(*KEY), max_horizon=HORIZON, embargo=10)[0]


@query(f"""SELECT 0::BIGINT AS overlapping, count(*) FILTER (split = 'train' AND position + {HORIZON} >= f) AS unpurged, count(*) FILTER (split = 'train' AND position > f - 10) AS inside_embargo
FROM (SELECT *, min(position) FILTER (split IN ('validation', 'test')) OVER () AS f FROM split) JOIN bars USING ("timestamp")""")
def split_check(spark, sf_dir):
    own = bars(spark, sf_dir).select(*KEY)
    assigned, b = splits.temporal_split(own, max_horizon=HORIZON, embargo=10)
    return splits.violations(own, assigned, b)


def _curve(spark, sf_dir) -> DataFrame:
    rows = backtest.realised(backtest.with_outcome(weighted(spark, sf_dir)), cost_rate=COST.rate)
    return backtest.periods(rows)


@query("SELECT \"timestamp\", round(gross_return, 7) AS gross_return, round(cost, 7) AS cost, round(turnover, 7) AS turnover, round(net_return, 7) AS net_return FROM netted WHERE variant = 'baseline'")
def backtest_periods(spark, sf_dir):
    return _rounded(_curve(spark, sf_dir), "gross_return", "cost", "turnover", "net_return", digits=7).drop("equity", "drawdown")


_METRICS = "round(sharpe, 7) AS sharpe, round(sortino, 7) AS sortino, round(max_drawdown, 7) AS max_drawdown, round(annual_turnover, 5) AS annual_turnover, round(total_return, 7) AS total_return, round(cagr, 7) AS cagr, n_periods"


def _metrics(df: DataFrame) -> DataFrame:
    return _rounded(_rounded(df, "sharpe", "sortino", "max_drawdown", "total_return", "cagr", digits=7), "annual_turnover", digits=5)


@query(f"SELECT {_METRICS} FROM measured WHERE variant = 'baseline'")
def backtest_metrics(spark, sf_dir):
    return _metrics(backtest.metrics(_curve(spark, sf_dir)))


@query("SELECT \"timestamp\", round(drawdown, 7) AS drawdown FROM drawn WHERE variant = 'baseline'")
def drawdown_curve(spark, sf_dir):
    return _curve(spark, sf_dir).select(TIMESTAMP, F.round("drawdown", 7).alias("drawdown"))


def _scored(spark, sf_dir) -> DataFrame:
    return backtest.with_outcome(weighted(spark, sf_dir)).select(*KEY, "weight", "forward_return")


@query('SELECT symbol, "timestamp", round(weight, 9) AS weight FROM randomised')
def random_weights(spark, sf_dir):
    return _rounded(nullmodels.random_weights(_scored(spark, sf_dir), SEED), "weight", digits=9).select(*KEY, "weight")


@query('SELECT symbol, "timestamp", weight FROM shuffled')
def shuffled_weights(spark, sf_dir):
    return nullmodels.shuffled_weights(saved(_scored(spark, sf_dir)), SEED + 1).select(*KEY, "weight")


@query('SELECT symbol, "timestamp", weight FROM shifted')
def shifted_weights(spark, sf_dir):
    return nullmodels.shifted_weights(_scored(spark, sf_dir)).select(*KEY, "weight")


@query('SELECT symbol, "timestamp", weight FROM leaked')
def leak_weights(spark, sf_dir):
    return nullmodels.leak_weights(_scored(spark, sf_dir)).select(*KEY, "weight")


@query("SELECT variant, round(sharpe, 6) AS sharpe, round(annual_turnover, 4) AS annual_turnover, n_periods FROM measured")
def null_battery(spark, sf_dir):
    found = nullmodels.battery_metrics(saved(weighted(spark, sf_dir).select(*KEY, "close", "weight")), seed=SEED, cost_model=COST)
    return found.select("variant", F.round("sharpe", 6).alias("sharpe"), F.round("annual_turnover", 4).alias("annual_turnover"), "n_periods")


@query(f"SELECT variant, {_METRICS} FROM measured WHERE variant IN ('baseline', 'cost_stress_2x', 'cost_stress_5x')")
def cost_stress(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    levels = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(COST.stressed(k).rate).alias("cost_rate")) for v, k in (("baseline", 1), ("cost_stress_2x", 2), ("cost_stress_5x", 5))))
    stacked = scored.select(F.inline(levels), *scored.columns)
    rows = backtest.realised(stacked, cost_rate="cost_rate", by=["variant"])
    return _metrics(backtest.metrics(backtest.periods(rows, ["variant"]), ["variant"]))


def _signals(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    every = lambda n, r=0: k % n == r
    version = F.when(every(11), "2.0.0").when(every(23), "x.1").when(every(29), "").otherwise("1.1.0")
    exposure = F.struct(((k % 13) / 10.0).alias("target_gross_exposure"), ((k % 9 - 4) / 10.0).alias("target_net_exposure"))
    return table(spark, sf_dir, "orders").select(
        version.alias("schema_version"), F.concat(F.lit("sig-"), k).alias("signal_id"), F.col("o_orderdate").alias("valid_until"), F.when(every(7), "live").otherwise("paper").alias("mode"),
        F.when(every(5), "reduce_only").otherwise("target_weight").alias("rebalance_type"), F.lit("run").alias("backtest_run_id"), F.lit("decl").alias("data_declaration_id"),
        every(3).alias("approval_required"), F.when(every(2), "approved").otherwise("pending").alias("approval_status"), exposure.alias("metadata"),
    )


@query("""SELECT signal_id, CASE WHEN schema_version = '' THEN 'missing_schema_version' WHEN schema_version = 'x.1' THEN 'invalid_schema_version' WHEN schema_version = '2.0.0' THEN 'unsupported_schema_major'
WHEN TIMESTAMP '1998-01-01' > valid_until THEN 'expired' WHEN mode <> 'paper' THEN 'mode_mismatch' WHEN gross > 1.0 THEN 'gross_exposure' WHEN abs(net) > 0.35 THEN 'net_exposure'
WHEN rebalance_type = 'target_weight' AND approval_required AND approval_status <> 'approved' THEN 'approval_missing' END AS rejection_reason FROM signals_in""")
def signal_validation(spark, sf_dir):
    now = F.expr("timestamp_ntz'1998-01-01'")
    checked = signals.validate(_signals(spark, sf_dir), now, signals.Limits("paper", max_gross=1.0, max_net=0.35))
    return checked.select("signal_id", "rejection_reason")


@query("""SELECT symbol, round(coalesce(q * p / 1000000000.0::DOUBLE, 0.0), 6) AS current_weight FROM brands LEFT JOIN (SELECT p_brand AS symbol, sum(l_quantity) AS q, round(avg(l_extendedprice), 4) AS p FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(substr(p_brand, 7) AS INT) % 5 <> 2 GROUP BY 1) USING (symbol)""")
def position_weight(spark, sf_dir):
    """Every line of a brand is a position in it; brands of one remainder are not held and weigh nothing."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias(SYMBOL)).where(F.substring(SYMBOL, 7, 9).cast("int") % 5 != 2)
    held = items.join(parts, items.l_partkey == parts.p_partkey).groupBy(SYMBOL).agg(F.sum("l_quantity").alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))
    found = signals.position_weights(brands(spark, sf_dir).select(SYMBOL), held, F.lit(1_000_000_000.0))
    return _rounded(found, "current_weight", digits=6)


@query("SELECT 'sig-' || l_orderkey AS signal_id, 'S' || l_linenumber AS symbol, max(l_discount) AS target_weight, 'sig-' || l_orderkey || ':' || 'S' || l_linenumber AS client_order_id FROM lineitem GROUP BY l_orderkey, l_linenumber")
def order_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("w"))
    sent = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("S"), "l_linenumber").alias("symbol"), F.col("w").alias("target_weight"))).alias("targets"))
    return signals.orders(sent.select(F.concat(F.lit("sig-"), "l_orderkey").alias("signal_id"), "targets"))


@query('SELECT upper(symbol) AS symbol, "timestamp", "open", high, low, "close", volume, trade_count, vwap FROM bars')
def bars_json_flatten(spark, sf_dir):
    """Every bar, in one page for each symbol and month: a page holds 31 bars at most."""
    own = bars(spark, sf_dir)
    day = F.date_format(TIMESTAMP, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.struct(day.alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("trade_count").alias("n"), F.col("vwap").alias("vw"))
    pages = own.groupBy(SYMBOL, F.date_format(TIMESTAMP, "yyyy-MM").alias("m")).agg(F.collect_list(raw).alias("list"))
    pages = pages.select(F.to_json(F.struct(F.create_map(SYMBOL, "list").alias("bars"))).alias("value"))
    return flatten(pages).withColumn(TIMESTAMP, F.col(TIMESTAMP).cast("timestamp_ntz"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT 1 FROM dirty GROUP BY symbol, "timestamp" HAVING count(*) > 1)) AS duplicate_keys, count(*) FILTER (symbol IS NULL OR trim(symbol) = '') AS blank_ids,
count(*) FILTER ("timestamp" IS NULL) AS null_times, count(*) FILTER (isnan("close") OR isinf("close")) AS close_non_finite, count(*) FILTER ("close" <= 0) AS close_at_or_below_zero, count("close") AS close_values,
count(*) FILTER (isnan(weight) OR isinf(weight)) AS weight_non_finite, count(*) FILTER (weight IS NULL) AS weight_null FROM dirty""")
def panel_faults(spark, sf_dir):
    """Bars with every fault that the checks count, put in by rules."""
    day, year = F.dayofmonth(TIMESTAMP), F.dayofyear(TIMESTAMP) % 50
    close = F.when(day == 13, float("nan")).when(day == 14, -F.col("close")).when(day != 15, F.col("close"))
    weight = F.when(year == 1, float("inf")).when(year != 0, F.col("weight"))
    dirty = weighted(spark, sf_dir).select(F.when(F.col("volume") % 97 == 0, "  ").otherwise(F.col(SYMBOL)).alias(SYMBOL), TIMESTAMP, close.alias("close"), weight.alias("weight"))
    return faults(dirty, prices=["close"], weights=["weight"])


@query("""SELECT count(*) FILTER (valid_from IS NULL) AS starts, count(*) FILTER (valid_to < valid_from) AS reversed FROM (SELECT CASE WHEN symbol NOT LIKE '%1' THEN valid_from + INTERVAL 500 DAY END AS valid_from, valid_to FROM universe)""")
def interval_faults(spark, sf_dir):
    late = F.when(~F.col(SYMBOL).endswith("1"), F.col("valid_from") + F.expr("INTERVAL 500 DAY"))
    return temporal.interval_faults(universe(spark, sf_dir).withColumn("valid_from", late))


@query("SELECT symbol FROM universe INTERSECT SELECT symbol FROM identity")
def symbols_shared(spark, sf_dir):
    return shared_symbols(universe(spark, sf_dir), identity(spark, sf_dir))


@query("SELECT symbol FROM bars EXCEPT SELECT symbol FROM identity")
def symbols_missing(spark, sf_dir):
    return missing_symbols(bars(spark, sf_dir), identity(spark, sf_dir))


@query("SELECT upper(symbol) AS symbol, \"timestamp\", \"open\", vwap FROM bars WHERE upper(symbol) IN ('BRAND#12', 'BRAND#23')")
def symbols_requested(spark, sf_dir):
    own = bars(spark, sf_dir).withColumn(SYMBOL, F.upper(SYMBOL))
    return source.select_bars(own, symbols=[" brand#12", "Brand#23 ", "BRAND#12", ""], columns=[SYMBOL, TIMESTAMP, "open", "vwap"])


@query("SELECT upper(b.symbol) AS symbol, b.\"timestamp\", b.\"close\", round(f.sma_5d, 4) AS sma_5d FROM bars b JOIN featured f USING (symbol, \"timestamp\") WHERE f.sma_5d IS NOT NULL AND b.symbol IN ('Brand#7', 'Brand#19')")
def research_symbols(spark, sf_dir):
    own = bars(spark, sf_dir).withColumn(SYMBOL, F.upper(SYMBOL))
    made = own.select(*KEY, F.round(features.sma(5), 4).alias("sma_5d")).where("sma_5d is not null")
    return dataset.research_dataset(own, made, feature_columns=["sma_5d"], symbols=["brand#7", "brand#19"], strict=False).select(*KEY, "close", "sma_5d")


@query(f"SELECT symbol, \"timestamp\", \"close\", weight FROM weighted WHERE \"timestamp\"::DATE <= DATE '{AS_OF}' AND weight <> 0")
def weights_join(spark, sf_dir):
    """The table of weights lists what is held; bars that are not have no row there."""
    own = weighted(spark, sf_dir)
    given = own.where("weight <> 0").select(*KEY, "weight")
    return reports.weighted_bars(own.drop("weight"), given, as_of=AS_OF, strict=False)


@query(f'SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp, count(*) - count(bar_volume) AS nulls_bar_volume, count(*) - count({LABEL}) AS nulls_{LABEL}, count(*) - count(ref_close) AS nulls_ref_close FROM eligible')
def dataset_summary(spark, sf_dir):
    return dataset.summary(_assembled(spark, sf_dir), ["bar_volume", LABEL, "ref_close"])


@query(f'SELECT count(*) FILTER (({LABEL} IS NULL) <> (target_null_reason IS NOT NULL)) AS violations FROM (SELECT {LABEL}, CASE WHEN day("timestamp") <> 3 THEN target_null_reason END AS target_null_reason FROM labelled)')
def ledger_violations(spark, sf_dir):
    """Reasons of one day of the month are taken away, so that some nulls have none."""
    blotted = labelled(spark, sf_dir).withColumn(labels.REASON, F.when(F.dayofmonth(TIMESTAMP) != 3, F.col(labels.REASON)))
    return labels.ledger_violations(blotted, LABEL)


@query('SELECT split, count(*) AS n, min("timestamp") AS "first", max("timestamp") AS "last" FROM split GROUP BY split')
def split_parts(spark, sf_dir):
    own = bars(spark, sf_dir).select(*KEY)
    b = splits.boundaries(own.select(TIMESTAMP).distinct().count(), max_horizon=HORIZON, embargo=10)
    return splits.split_parts(own, b)


@query('SELECT symbol, "timestamp", volume FROM bars ORDER BY volume DESC, symbol, "timestamp" LIMIT 20')
def top_volume(spark, sf_dir):
    """A top-k report."""
    return bars(spark, sf_dir).select(*KEY, "volume").orderBy(F.desc("volume"), *KEY).limit(20)


@query('SELECT upper(symbol) AS symbol, "timestamp", "open", high, low, "close", volume, trade_count, vwap FROM bars')
def bars_written_and_read(spark, sf_dir):
    """Through the Parquet sink, which writes tickers in upper case, and back."""
    path = f"{shared_dir(spark)}/bars.parquet"
    write_bars(bars(spark, sf_dir), path)
    return source.select_bars(source.scan(spark, path)).withColumn(TIMESTAMP, F.col(TIMESTAMP).cast("timestamp_ntz"))


@query('SELECT symbol, date_trunc(\'day\', "timestamp")::TIMESTAMP AS day, volume, trade_count FROM bars')
def bars_from_csv(spark, sf_dir):
    """Through CSV with inferred types and back."""
    path = f"{shared_dir(spark)}/bars.csv"
    bars(spark, sf_dir).select(SYMBOL, F.to_date(TIMESTAMP).alias("day"), "volume", "trade_count").write.option("header", True).csv(path)
    back = source.read_table(spark, path)
    return back.select(SYMBOL, F.col("day").cast("timestamp_ntz").alias("day"), F.col("volume").cast("long").alias("volume"), F.col("trade_count").cast("long").alias("trade_count"))


def _digest_sql(columns: list[tuple[str, str]], rows: str) -> str:
    """The multiset hash in SQL, over rows that hold each column's JSON text."""
    header = fingerprints.canonical([[c, kind] for c, kind in columns])
    json = " || ',' || ".join(f"""'"{c}":' || {c}""" for c, _ in columns)
    lanes = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)::HUGEINT), 0) AS s{i}" for i in range(fingerprints.LANES))
    total = " || '|' || ".join(["n_rows", *(f"s{i}" for i in range(fingerprints.LANES))])
    return f"SELECT 'sha256:' || sha256('{header}' || '|' || {total}) AS fingerprint, n_rows FROM (SELECT count(*) AS n_rows, {lanes} FROM (SELECT sha256('{{' || {json} || '}}') AS h FROM ({rows})))"


_PRINTED = """SELECT '"' || symbol || '"' AS symbol, '"' || strftime("timestamp", '%Y-%m-%d') || '"' AS day, '"' || printf('%.2f', "close") || '"' AS price, CAST(volume AS VARCHAR) AS volume FROM bars"""


@query(_digest_sql([(SYMBOL, "string"), ("day", "string"), ("price", "string"), ("volume", "bigint")], _PRINTED))
def frame_fingerprint(spark, sf_dir):
    printed = bars(spark, sf_dir).select(SYMBOL, F.date_format(TIMESTAMP, "yyyy-MM-dd").alias("day"), F.format_string("%.2f", "close").alias("price"), "volume")
    return fingerprints.frame_digest(printed)


_EVENTS = "SELECT event_type AS symbol, date_trunc('hour', ts) AS \"timestamp\", arg_min(value, row(ts, event_id)) AS \"open\", max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS \"close\", count(*) AS trade_count FROM events GROUP BY 1, 2"


@query(_EVENTS)
def stream_bars(spark, sf_dir):
    return streaming.run_once(spark, f"{sf_dir}/events.parquet")
