"""Append-only JSONL ledgers of fetches, experiments and lineage. Entries never change; secrets never enter."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import subprocess
import uuid
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PanelError
from .contracts import VERDICTS, _one_of
from .fingerprints import canonical, sha

SECRET_KEYS = re.compile(r"secret|password|token|api_?key|credential", re.I)


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def run_id(prefix: str = "run", clock: Callable[[], dt.datetime] = now) -> str:
    return f"{prefix}-{clock():%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def git_sha(folder: str = ".") -> str | None:
    try:
        got = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return got.stdout.strip() or None if got.returncode == 0 else None


def _keys(value: Any):
    if isinstance(value, Mapping):
        for k, v in value.items():
            yield str(k)
            yield from _keys(v)
    elif isinstance(value, list | tuple):
        for v in value:
            yield from _keys(v)


class Ledger:
    """One JSON object a line. A single writer appends on the driver; reads go through Spark."""

    def __init__(self, path: str | os.PathLike):
        self.path = Path(path)

    def entries(self) -> list[dict]:
        if not self.path.exists():
            return []
        return [json.loads(line) for line in self.path.read_text(encoding="utf-8").splitlines() if line.strip()]

    def append(self, record: Mapping, *, id_field: str, secrets: Sequence[str] = ()) -> dict:
        """Adds an id and a time where absent. A known id with other content is an error; with the same, nothing is added."""
        entry = dict(record)
        entry.setdefault(id_field, run_id())
        entry.setdefault("created_at", now().isoformat())
        line = canonical(entry)
        if any(s and s in line for s in secrets) or any(SECRET_KEYS.search(k) for k in _keys(entry)):
            raise PanelError("a ledger entry must not hold secrets")
        for old in self.entries():
            if old.get(id_field) == entry[id_field]:
                if canonical(old) == line:
                    return old
                raise PanelError(f"{id_field} {entry[id_field]} is already recorded and cannot change")
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a", encoding="utf-8") as f:
            f.write(line + "\n")
        return entry

    def read(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.json(str(self.path))


LINEAGE = "entry_id string, created_at_utc string, dataset_id string, dataset_fingerprint string, feature_set_id string, source_label_fingerprint string, verdict string, reason_list array<map<string,string>>, split_ref array<map<string,string>>, declared_corporate_actions_status string, declared_adjustment_status string, entry_fingerprint string"


def lineage_record(manifest: Mapping, report: Mapping, *, feature_set_id: str | None = None, clock: Callable[[], dt.datetime] = now) -> dict:
    """Verdict and reasons are carried over, not recomputed; the fingerprint leaves out the ids derived from it."""
    when = clock()
    if when.tzinfo is None:
        raise PanelError("the clock must know its time zone")
    _one_of(report["verdict"], VERDICTS, "verdict")
    if report.get("dataset_fingerprint") not in (None, manifest["fingerprint"]):
        raise PanelError("manifest and report describe different datasets")
    body = {
        "record_type": "lineage",
        "created_at_utc": when.astimezone(dt.UTC).isoformat(),
        "dataset_id": manifest["dataset_id"],
        "dataset_fingerprint": manifest["fingerprint"],
        "feature_set_id": feature_set_id,
        "source_label_fingerprint": manifest.get("source_label_fingerprint"),
        "split_ref": list(report.get("split_summaries", [])),
        "verdict": report["verdict"],
        "reason_list": list(report.get("warnings", [])),
        "declared_corporate_actions_status": manifest.get("declared_corporate_actions_status"),
        "declared_adjustment_status": manifest.get("declared_adjustment_status"),
    }
    digest = sha(body)
    return body | {"entry_fingerprint": f"sha256:{digest}", "entry_id": f"lin-{digest[:12]}"}


def check_lineage(record: Mapping) -> Mapping:
    body = {k: v for k, v in record.items() if k not in ("entry_id", "entry_fingerprint", "created_at")}
    if record["entry_fingerprint"] != f"sha256:{sha(body)}" or record["entry_id"] != f"lin-{sha(body)[:12]}":
        raise PanelError("a lineage entry does not match its fingerprint")
    return record


class LineageLedger(Ledger):
    def record(self, manifest: Mapping, report: Mapping, **options: Any) -> dict:
        entry = dict(check_lineage(lineage_record(manifest, report, **options)))
        return self.append(entry | {"created_at": entry["created_at_utc"]}, id_field="entry_id")

    def entries(self) -> list[dict]:
        """Every entry, checked against its fingerprint; an id that occurs twice is an error."""
        found = [dict(check_lineage(e)) for e in super().entries()]
        ids = [e["entry_id"] for e in found]
        if len(set(ids)) < len(ids):
            raise PanelError(f"lineage ids recorded more than once: {sorted({i for i in ids if ids.count(i) > 1})}")
        return found

    def export(self, path: str | os.PathLike, **filters: str) -> Path:
        """The entries whose fields have the given values, in the order recorded, as one JSON list."""
        unknown = set(filters) - {"dataset_id", "feature_set_id", "verdict"}
        if unknown:
            raise PanelError(f"lineage is not filtered by {sorted(unknown)}")
        chosen = [e for e in self.entries() if all(e.get(k) == v for k, v in filters.items())]
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(chosen, allow_nan=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")
        return target

    def find(self, spark: SparkSession, *, dataset_id: str | None = None, feature_set_id: str | None = None, verdict: str | None = None) -> DataFrame:
        out = self.read(spark, LINEAGE)
        for column, value in (("dataset_id", dataset_id), ("feature_set_id", feature_set_id), ("verdict", verdict)):
            if value is not None:
                out = out.where(F.col(column) == value)
        return out.orderBy("created_at_utc", "entry_id")
