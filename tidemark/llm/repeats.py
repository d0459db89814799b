"""Removal of long repeated byte strings, with run-length indexes over the places that need one.

1. Every window of ``length`` bytes has a minimizer: the anchor that it contains at a place its content
   alone decides. Windows that share a minimizer form a segment. Equal windows lie in segments with
   equal anchors, so an anchor that occurs once rules its whole segment out.
2. Segments with equal anchors and equal bytes repeat as a whole. They are counted, map-side first; one
   of them stands for all in the index. What is frequent is broadcast, at most HOT keys, and never shuffled.
3. The other segments with shared anchors meet in a run-length index (see ``rlbwt``), groups of an anchor
   kept together; matching statistics of at least ``length`` mark repeated windows. A group of more distinct
   bytes than one index takes (``group_bytes``) is settled by counting the hashes of its windows, which spreads
   over all tasks and gives the same spans.

Hashes decide as 128 bits (anchor and segment, or two window hashes).
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker
from .rlbwt import build
from .shingles import mix
from .storage import materialize, partitions

LENGTH = 200
ANCHOR = 64
CHUNK = 1 << 17
INDEX_BYTES = 400_000
GROUP_BYTES = 4_000_000
BITMAP_BITS = 1 << 22
HOT = 4096
NO_ID = -(2**63)

_BASE = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.Generator(np.random.PCG64(20240301))
_TABLES = _rng.integers(1, 1 << 63, (2, 256), np.uint64)
_POSITION = np.uint64((1 << 22) - 1)
_powers: list[np.ndarray] = []
worker.cache(_powers.clear)


def _scaled() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers:
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            steps = np.full(3 * CHUNK, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any substring of ``data`` (shorter than 3 * CHUNK) from prefix sums."""

    def __init__(self, data: np.ndarray, which: int):
        powers, self.inverse = _scaled()
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLES[which][data] * powers[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def segments(data: np.ndarray, first: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(string, start, bytes, anchor hash, segment hash) of all segments; ``first`` holds the strings' starts in ``data``."""
    n, width = len(data), length - anchor + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    hashes = Hashes(data, 0)
    at = np.arange(n - anchor + 1)
    keys = hashes.of(at, at + anchor)
    value = (keys & ~_POSITION) | at.astype(np.uint64)
    pad = -len(value) % width
    blocks = np.concatenate([value, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    low_to = np.minimum.accumulate(blocks, axis=1).ravel()
    low_from = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - length + 1)
    lowest = (np.minimum(low_from[p], low_to[p + width - 1]) & _POSITION).astype(np.int64)
    string = np.searchsorted(first, p, side="right") - 1
    ends = np.concatenate([first[1:], [n]])
    valid = p + length <= ends[string]
    p, lowest, string = p[valid], lowest[valid], string[valid]
    if not len(p):
        return none, none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (lowest[1:] != lowest[:-1]) | (string[1:] != string[:-1])]))
    last = np.concatenate([new[1:], [len(p)]]) - 1
    start, end = p[new], p[last] + length
    return string[new], start - first[string[new]], end - start, keys[lowest[new]].astype(np.int64), Hashes(data, 1).of(start, end).astype(np.int64)


def _slices(texts: list[bytes], length: int):
    """Groups of slices, (text number, offset, bytes), of about CHUNK bytes; slices of a long text overlap by length - 1."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - length + 1), CHUNK):
            part = t[lo : lo + CHUNK + length - 1]
            if len(part) < length:
                continue
            if group and size + len(part) > CHUNK:
                yield group
                group, size = [], 0
            group.append((i, lo, part))
            size += len(part)
    if group:
        yield group


def _all_segments(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    names = ["d", "h", "at", "bytes", "anchor", "body"]

    def run(batches):
        worker.claim("repeats")
        for batch in batches:
            d, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo in range(0, batch.num_rows, 1000):
                texts = [t.encode() for t in batch.column(2).slice(lo, 1000).to_pylist()]
                for group in _slices(texts, length):
                    data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
                    size = np.array([len(x[2]) for x in group])
                    string, start, n, key, body = segments(data, np.cumsum(size) - size, length, anchor)
                    if len(string):
                        doc, off = np.array([x[0] for x in group])[string] + lo, np.array([x[1] for x in group])[string]
                        yield pa.RecordBatch.from_arrays([pa.array(d[doc]), pa.array(h[doc]), pa.array(start + off), pa.array(n.astype(np.int32)), pa.array(key), pa.array(body)], names=names)
        worker.trim()

    return docs.select("d", "h", "text").mapInArrow(run, "d long, h long, at long, bytes int, anchor long, body long")


def _flagged(docs: DataFrame, wanted: DataFrame):
    """A column that is true for all documents in ``wanted`` (d) and few others: a bitmap of fixed size."""
    spot = F.pmod(F.xxhash64("d"), F.lit(BITMAP_BITS))
    rows = wanted.select((spot + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    flags = np.zeros(BITMAP_BITS // 8, np.uint8)  # at most BITMAP_BITS / 32768 rows of 4 KB; positions count from 1
    for r in rows:
        flags[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)

    @F.pandas_udf("boolean")
    def flag(x: pd.Series) -> pd.Series:
        return pd.Series(flags[x.to_numpy() >> 3] >> (x.to_numpy() & 7).astype(np.uint8) & 1 == 1)

    return docs.withColumn("flag", flag(spot))


def _with_text(docs: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """d, h, text and all ``rows`` of each document that has some, as arrays."""
    lists = rows.groupBy("d", "h").agg(*(F.collect_list(c).alias(c) for c in fields))
    return _flagged(docs, rows.select("d").distinct()).where("flag").select("d", "h", "text").join(lists, ["d", "h"])


def _index_spans(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Spans (d, h, at, bytes) of repeated windows in the open segments of ``rows``, by run-length indexes."""

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time
                raw = batch.column(2)[i].as_py().encode()
                at, n, key, is_open = (batch.column(c)[i].as_py() for c in range(3, 7))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array([batch.column(0)[i].as_py()] * len(at), pa.int64()), pa.array([batch.column(1)[i].as_py()] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(is_open, pa.bool_()), pa.array([raw[a : a + b] for a, b in zip(at, n, strict=True)], pa.binary())],
                    names=["anchor", "d", "h", "at", "open", "body"],
                )
        worker.trim()

    cuts = _with_text(docs, rows, ["at", "bytes", "anchor", "open"]).mapInArrow(cut, "anchor long, d long, h long, at long, open boolean, body binary")
    grouped = cuts.repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor")

    def settle(held: list[tuple]) -> pa.RecordBatch:
        index = build([x[5] for x in held])
        start, end = index.long_matches(length)
        own = np.searchsorted(index.starts, start, side="right") - 1  # no stretch of matches spans two strings
        out = [(*held[i][1:3], held[i][3] + a - index.starts[i], b - a + length - 1) for i, a, b in zip(own.tolist(), start.tolist(), end.tolist(), strict=True) if held[i][4]]
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "h", "at", "bytes"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= INDEX_BYTES and row[0] != held[-1][0]:  # groups stay whole
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield settle(held)
        del held
        worker.trim()

    return grouped.mapInArrow(run, "d long, h long, at long, bytes long")


def _window_spans(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The same by counting window hashes: for groups too large for one index."""

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column(2)[i].as_py().encode(), np.uint8)
                for at, n, is_open in zip(*(batch.column(c)[i].as_py() for c in (3, 4, 6)), strict=True):
                    part = raw[at : at + n]
                    p = np.arange(n - length + 1)
                    one, two = (Hashes(part, k).of(p, p + length).astype(np.int64) for k in (0, 1))
                    same = lambda v: pa.array(np.full(len(p), v))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(batch.column(0)[i].as_py()), same(batch.column(1)[i].as_py()), pa.array(p + at), same(is_open), pa.array(one), pa.array(two)], names=["d", "h", "at", "open", "one", "two"])

    windows = materialize(_with_text(docs, rows, ["at", "bytes", "anchor", "open"]).mapInArrow(cut, "d long, h long, at long, open boolean, one long, two long"), "windows")
    common = windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("one", "two")
    return windows.where("open").join(common, ["one", "two"]).select("d", "h", "at", F.lit(length).cast("long").alias("bytes"))


def _with_counts(rows: DataFrame, found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` joined with ``found`` (keys, c and more), of which c rows each have the keys.

    The HOT most frequent keys are broadcast, so their rows stay where they are; the others are shuffled. A key that
    is none of those holds at most a HOTth of the rows.
    """
    hot = materialize(found.where(F.col("c") > HOT).orderBy(F.desc("c"), *keys).limit(HOT), name, rows=HOT)
    cold = found.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Spans (d, h, at, bytes), overlapping, that cover what repeats in ``docs`` (d, h, text)."""
    every = materialize(_all_segments(docs, length, anchor), "segments")
    shared = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = materialize(shared, "anchors")  # as a table of its own, so that the join can split what is left of hot anchors
    rows = materialize(_with_counts(every, shared, ["anchor"], "hot_anchors").drop("c"), "shared")
    whole = rows.groupBy("anchor", "body").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "h", "at", "bytes")).alias("one"))
    whole = materialize(whole, "bodies")
    groups = whole.groupBy("anchor").agg(F.sum("one.bytes").alias("size"), F.count_if(F.col("c") == 1).alias("open"), F.count(F.lit(1)).alias("bodies")).where("open > 0").select("anchor", "size", F.col("bodies").alias("c"))
    groups = materialize(groups, "groups")
    repeated = whole.where("c > 1").select("anchor", "body", "c")
    full = _with_counts(rows, repeated, ["anchor", "body"], "hot_bodies").select("d", "h", "at", F.col("bytes").cast("long").alias("bytes"))
    parts = whole.select("one.*", "anchor", (F.col("c") == 1).alias("open"))
    asked = materialize(_with_counts(parts, groups, ["anchor"], "hot_groups").drop("c"), "asked")
    spans = full.unionByName(_index_spans(docs, asked.where(F.col("size") <= group_bytes), length))
    large = asked.where(F.col("size") > group_bytes)
    if not large.isEmpty():
        spans = spans.unionByName(_window_spans(docs, large, length))
    return spans


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Removed is each byte covered by a ``length``-byte string that also starts elsewhere in the table,
    the same text included. A null text counts as empty; texts under ``length`` bytes lose nothing.
    Repeated rows are repeats of each other and lose all they cover. Null doc_ids are kept. Long texts are taken in
    overlapping slices. Extra columns are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    spans = materialize(repeated_spans(source, length, **options), "spans")
    lists = spans.groupBy("d", "h").agg(F.collect_list("at").alias("at"), F.collect_list("bytes").alias("bytes"))
    flagged = _flagged(source, spans.select("d").distinct())
    touched = flagged.where("flag").select("d", "h", "text").join(lists, ["d", "h"], "left").select("d", "text", "at", "bytes")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = []
                for d, t, at, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = t.encode()
                    if not at:
                        out.append((d, len(raw), 0, 0, raw))
                        continue
                    at, end = np.array(at), np.array(at) + np.array(n)
                    by = np.argsort(at, kind="stable")
                    at, end = at[by], np.maximum.accumulate(end[by])
                    new = np.concatenate([[True], at[1:] > end[:-1]])
                    begin, end = at[new], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
                    keep = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True))
                    out.append((d, len(raw), len(raw) - len(keep), len(begin), keep))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["d", "n_bytes", "n_removed", "n_spans", "kept"])
        worker.trim()

    changed = touched.mapInArrow(run, "d long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    same = flagged.where("not flag").select("d", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return changed.unionByName(same).select(F.nullif("d", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
