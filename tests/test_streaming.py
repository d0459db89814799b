import datetime as dt

import pandas as pd
import pytest

from tidemark.streaming import bars as streaming


def ticks(spark, n=200):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i), i % 5, "ab"[i % 2], float(i % 13)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def test_stream_equals_batch(spark, tmp_path):
    df = ticks(spark)
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = streaming.run_once(spark, str(tmp_path / "events.parquet"))
    want = streaming.build(df)
    key = lambda f: sorted((r["symbol"], str(r["timestamp"]), r["open"], r["high"], r["low"], r["close"], r["trade_count"]) for r in f.collect())
    assert key(got) == key(want)


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    source = tmp_path / "in"
    df = ticks(spark, 40)
    df.write.mode("append").parquet(str(source))
    made = streaming.build(spark.readStream.schema(df.schema).parquet(str(source)), late="1 hour").writeStream.outputMode("append").format("memory").queryName("late_bars").option("checkpointLocation", str(tmp_path / "c")).start()
    made.processAllAvailable()
    before = spark.table("late_bars").count()
    df.limit(1).write.mode("append").parquet(str(source))
    made.processAllAvailable()
    made.stop()
    assert before > 0 and spark.table("late_bars").count() >= before
    assert spark.table("late_bars").groupBy("symbol", "timestamp").count().where("count > 1").isEmpty()


def test_sessions(spark):
    assert streaming.sessions(ticks(spark, 40), gap="20 minutes").count() == 40


def test_running_ema(spark, tmp_path):
    values = [1.0, 4.0, 2.0, 8.0, 5.0, 7.0]
    start = dt.datetime(2024, 1, 1)
    rows = [("A", start + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    source = tmp_path / "in"
    first = spark.createDataFrame(rows[:3], "symbol string, timestamp timestamp, close double")
    first.write.mode("append").parquet(str(source))
    made = streaming.running_ema(spark.readStream.schema(first.schema).parquet(str(source)), 3).writeStream.outputMode("append").format("memory").queryName("emas").option("checkpointLocation", str(tmp_path / "c")).start()
    made.processAllAvailable()
    spark.createDataFrame(rows[3:], first.schema).write.mode("append").parquet(str(source))
    made.processAllAvailable()
    made.stop()
    got = [r["ema"] for r in spark.table("emas").orderBy("timestamp").collect()]
    assert got == pytest.approx(pd.Series(values).ewm(span=3, adjust=True).mean().tolist())
