"""Identities of frames, configurations and sets: equal content, equal id, in any order of rows or keys."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PanelError

LANES = 8


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys; NaN is an error, other types become text."""
    return json.dumps(value, allow_nan=False, default=str, separators=(",", ":"), sort_keys=True)


def sha(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def config_hash(config: Any) -> str | None:
    return None if config is None else f"sha256:{sha(config)}"


def short_id(prefix: str, value: Any, digits: int = 12) -> str:
    return f"{prefix}-{sha(value)[:digits]}"


def feature_set_id(path: str, symbol: str, last_bar: Any = None) -> str:
    """Keyed by the last bar found, not by the cutoff asked for: two cutoffs without a bar between them agree."""
    return short_id(f"feat-{symbol.strip().upper()}", {"path": str(path), "symbol": symbol.strip().upper(), "last_bar": str(last_bar) if last_bar is not None else None}, 8)


def dataset_id(paths: Sequence[str], **options: Any) -> str:
    return short_id("rds", {"paths": [str(p) for p in paths], **options}, 8)


def target_id(fingerprint: str, horizons: Sequence[int]) -> str:
    return short_id("tgt", {"fingerprint": fingerprint, "horizons": list(horizons)})


def frame_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, fingerprint and n_rows: a multiset hash, the SHA-256 of the number and the summed digests of all rows.

    A row's digest is cut into LANES numbers of 32 bits, which are summed apart: no list of rows is ever
    gathered, and their order cannot matter. Column names and types take part.
    """
    columns = list(columns or df.columns)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(LANES)]
    sums = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), *lanes)
    header = canonical([[c, df.schema[c].dataType.simpleString()] for c in columns])
    total = F.concat_ws("|", F.lit(header), "n_rows", *(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(LANES)))
    return sums.select(F.concat(F.lit("sha256:"), F.sha2(total, 256)).alias("fingerprint"), "n_rows")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """Of the frame; NaN in a floating column is an error."""
    columns = list(columns or df.columns)
    floats = [c for c in columns if df.schema[c].dataType.typeName() in ("double", "float")]
    if floats and not df.where(" or ".join(f"isnan(`{c}`)" for c in floats)).isEmpty():
        raise PanelError("NaN has no fingerprint")
    return frame_digest(df, columns).first()["fingerprint"]
