import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    made = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def day():
    return lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture
def bars(spark, day):
    """Builds bars from closes: {symbol: [close, ...]}, daily from 2024-01-01."""

    def make(closes, volume=1000):
        rows = [(s, day(i), *[float(c)] * 4, volume + i, 10 + i, float(c)) for s, values in closes.items() for i, c in enumerate(values)]
        return spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume long, trade_count long, vwap double")

    return make
