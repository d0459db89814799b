"""Bars and exponential means over streams of ticks, late rows included up to a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SYMBOL, TIMESTAMP
from ..session import shared_dir


def build(ticks: DataFrame, *, width: str = "1 hour", late: str = "10 minutes", symbol: str = "event_type", time: str = "ts", value: str = "value", sequence: str = "event_id") -> DataFrame:
    """Tumbling bars per symbol. On a stream, a bar closes once the watermark passes its end; the same plan serves batches."""
    if dict(ticks.dtypes)[time] == "timestamp_ntz":
        ticks = ticks.withColumn(time, F.col(time).cast("timestamp"))
    if ticks.isStreaming:
        ticks = ticks.withWatermark(time, late)
    order = F.struct(time, sequence, value)
    made = ticks.groupBy(F.window(time, width).alias("w"), F.col(symbol).alias(SYMBOL)).agg(
        F.min(order)[value].alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max(order)[value].alias("close"), F.count(F.lit(1)).alias("trade_count")
    )
    return made.select(SYMBOL, F.col("w.start").alias(TIMESTAMP), "open", "high", "low", "close", "trade_count")


def sessions(ticks: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id", time: str = "ts") -> DataFrame:
    """Activity sessions per key, closed by a gap."""
    if dict(ticks.dtypes)[time] == "timestamp_ntz":
        ticks = ticks.withColumn(time, F.col(time).cast("timestamp"))
    if ticks.isStreaming:
        ticks = ticks.withWatermark(time, late)
    made = ticks.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return made.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_ema(ticks: DataFrame, span: int, *, symbol: str = SYMBOL, time: str = TIMESTAMP, value: str = "close") -> DataFrame:
    """(symbol, timestamp, ema) of each arriving row: normalised weights, two numbers of state per symbol.

    Rows of one micro-batch are taken in time order; later batches continue from the state.
    """
    keep = 1 - 2 / (span + 1)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, weight = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values(time, kind="stable")
        out = []
        for x in rows[value]:
            total, weight = total * keep + x, weight * keep + 1
            out.append(total / weight)
        state.update((total, weight))
        yield pd.DataFrame({symbol: key[0], time: rows[time].to_numpy(), "ema": out})

    kind = dict(ticks.dtypes)[time]
    return ticks.select(symbol, time, value).groupBy(symbol).applyInPandasWithState(step, f"{symbol} string, {time} {kind}, ema double", "total double, weight double", "append", "NoTimeout")


def run_once(spark: SparkSession, path: str, **options) -> DataFrame:
    """All available rows of a Parquet path through a real stream; the finished bars as a batch.

    The complete mode returns every bar, open ones too, so the result equals that of one batch. Bars go from the
    executors to Parquet in the shared folder, each batch in place of the last, and never to the driver.
    """
    schema = spark.read.parquet(path).schema
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern, so that a single file serves as well as a folder
    made = build(spark.readStream.schema(schema).parquet(either), **options)
    folder = shared_dir(spark)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/bars")

    query = made.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.createDataFrame([], made.schema) if query.lastProgress is None else spark.read.schema(made.schema).parquet(f"{folder}/bars")
    return found.withColumn(TIMESTAMP, F.col(TIMESTAMP).cast("timestamp_ntz"))
