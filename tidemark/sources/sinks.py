"""Parquet sinks that never overwrite unless told to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BAR_COLUMNS, SYMBOL, PanelError, require


def write_frame(df: DataFrame, path: str, *, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    if df.isEmpty():
        raise PanelError("nothing to write")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bars(bars: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Bars in the fixed column order, tickers upper-cased."""
    require(bars, BAR_COLUMNS, "bars")
    write_frame(bars.withColumn(SYMBOL, F.upper(F.trim(SYMBOL))).select(*BAR_COLUMNS), path, overwrite=overwrite)
