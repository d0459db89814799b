"""Shared-folder tables: the only way these operators cut lineage.

Every intermediate goes to the folder named by ``spark.checkpoint.dir``, which
all executors and the driver see, so a lost executor never loses a stage's
input. Only a local master without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROWS_A_FILE = 250_000
#: Scratch made by this driver, oldest first: ("path" or "table", name).
_made: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, base, True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    if not _made:
        atexit.register(_release_at_exit)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(("path", path))
    return path


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


def materialize(df: DataFrame, name: str, *, rows: int | None = None, apart: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Where a bound on its rows is known, no more tasks write than the rows need, so that a small table
    has few files however many partitions it comes in; their number grows with the rows. With ``apart``
    a shuffle brings the rows to those tasks, for rows that are dear to make: as many tasks as before make them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None and (files := max(1, -(-rows // ROWS_A_FILE))) < partitions(spark):
        df = df.repartition(files) if apart else df.coalesce(files)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """How many scratch paths and tables there are; they are counted in the order in which they were made."""
    return len(_made)


def release(spark: SparkSession, *, since: int = 0, until: int | None = None) -> None:
    """Delete the scratch made between two marks.

    Results are lazy and read their scratch tables, so only the caller knows when they are done with: take marks before
    and after an operator is called, write its result, then release what lies between. What is left goes when the
    driver's interpreter ends.
    """
    for kind, name in _made[since:until]:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since:until]


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write ``df`` as a table bucketed by ``column``: later grouping or joining on it moves no row.

    The files lie in the shared folder; the catalog entry is dropped with the session.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", scratch_path(spark, name)).bucketBy(buckets, column).saveAsTable(table)
    _made.append(("table", table))
    return spark.table(table)


def buckets(spark: SparkSession) -> int:
    """As many buckets as partitions, but no more than Spark allows a table."""
    return min(partitions(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
