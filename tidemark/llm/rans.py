"""Token-id files coded with a static range asymmetric numeral system (rANS).

Writing
  1. Documents are tokenised where they lie, into a table of ids. Each task adds its symbol counts; their
     sum over the whole corpus makes the shared frequency table.
  2. The table is range-partitioned by doc_id and sorted within the ranges, by Spark; tasks stream their
     range and cut it into blocks of whole documents, so that none holds more than a block. A block's ids go
     round robin to interleaved coder lanes that advance together as numpy vectors.
Reading needs only the files. A block is a header, a document index and segments; each segment starts
with a checkpoint (all lane states) and ends with a CRC-32 of its ids, so segments decode in parallel
and a damaged one is told apart.

Frequencies are scaled to 2**PRECISION; lane states stay in [2**31, 2**63) and shed 32-bit words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import worker
from .bpe import ForcedBoundaryBPE, encoder, vocabulary_dtype
from .storage import materialize, partitions, scratch_path

PRECISION = 20
LANES = 4096
BLOCK_IDS = 1 << 21
SEGMENT_STEPS = 256
MAGIC = 0x534E4152
_LOW = np.uint64(1 << 31)
_BITS = np.uint64(PRECISION)
_MASK = np.uint64((1 << PRECISION) - 1)
_WORD = np.uint64(32)


def scale(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**PRECISION, at least 1 for each symbol that occurs."""
    counts = np.asarray(counts, np.int64)
    total, size = int(counts.sum()), 1 << PRECISION
    if not total:
        return np.zeros(len(counts), np.int64)
    used = counts > 0
    if used.sum() > size:
        raise ValueError("more symbols than the table has room for")
    freq = np.where(used, np.maximum(1, (counts.astype(float) * size / total).astype(np.int64)), 0)
    over = int(freq.sum()) - size
    for i in np.argsort(-freq, kind="stable"):
        if over == 0:
            break
        step = -over if over < 0 else min(over, int(freq[i]) - 1)
        freq[i] += step if over < 0 else -step
        over += step if over < 0 else -step
    return freq


class Coder:
    """Encoder and decoder for one shared frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else np.zeros(0, np.uint64)
        self.limit = self.freq << np.uint64(63 - PRECISION)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """Final states and words of one segment; the words are in the order in which decoding takes them."""
        state = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = []
        for lo in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            part = ids[lo : lo + lanes]
            x = state[: len(part)]
            f = self.freq[part]
            full = x >= self.limit[part]
            if full.any():
                words.append(x[full].astype(np.uint32))
                x[full] >>= _WORD
            q = x // f
            x[:] = (q << _BITS) + (x - q * f) + self.start[part]
        words.reverse()
        return state, np.concatenate(words) if words else np.zeros(0, np.uint32)

    def decode(self, n: int, lanes: int, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.uint32)
        state, words, at, symbol = state.copy(), words.astype(np.uint64), 0, self.symbol
        for lo in range(0, n, lanes):
            x = state[: min(lanes, n - lo)]
            slot = x & _MASK
            s = symbol[slot]
            out[lo : lo + len(x)] = s
            x[:] = self.freq[s] * (x >> _BITS) + slot - self.start[s]
            dry = np.flatnonzero(x < _LOW)
            if len(dry):
                x[dry] = (x[dry] << _WORD) | words[at : at + len(dry)]
                at += len(dry)
        if at != len(words) or (state != _LOW).any():
            raise ValueError("damaged segment")
        return out


def pack_block(coder: Coder, lens: np.ndarray, ids: np.ndarray) -> bytes:
    """One independent block: header, document lengths, then segments."""
    lanes = int(min(LANES, max(1, len(ids) // 64)))
    step = lanes * SEGMENT_STEPS
    parts = [np.array([MAGIC, len(lens), len(ids), lanes, step], "<u8").tobytes(), lens.astype("<u8").tobytes()]
    for lo in range(0, len(ids), step):
        part = ids[lo : lo + step]
        state, words = coder.encode(part, lanes)
        parts += [np.array([len(words), zlib.crc32(part.astype("<u4").tobytes())], "<u8").tobytes(), state.astype("<u8").tobytes(), words.astype("<u4").tobytes()]
    return b"".join(parts)


def segments(data: bytes) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(ids, lanes, checksum, checkpoint, words) of each segment: units of parallel decoding."""
    magic, docs, n, lanes, step = np.frombuffer(data, "<u8", 5).tolist()
    if magic != MAGIC:
        raise ValueError("not a block")
    at = 40 + 8 * docs
    for lo in range(0, n, step):
        count, crc = np.frombuffer(data, "<u8", 2, at).tolist()
        state = np.frombuffer(data, "<u8", lanes, at + 16)
        words = np.frombuffer(data, "<u4", count, at + 16 + 8 * lanes)
        at += 16 + 8 * lanes + 4 * count
        yield min(step, n - lo), lanes, crc, state, words
    if at != len(data):
        raise ValueError("block has the wrong length")


def unpack_block(coder: Coder, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document lengths and ids."""
    out = []
    for n, lanes, crc, state, words in segments(data):
        ids = coder.decode(n, lanes, state, words)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum mismatch")
        out.append(ids)
    lens = np.frombuffer(data, "<u8", int(np.frombuffer(data, "<u8", 2)[1]), 40).astype(np.int64)
    return lens, np.concatenate(out) if out else np.zeros(0, np.uint32)


def write(docs: DataFrame, vocabulary: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, ranges: int | None = None) -> None:
    """Tokenise all texts, append ``end_id`` to each, and write ``path``/blocks, ``path``/table and ``path``/ranges.

    ``ranges`` (the session's shuffle partitions if not given) sets how many tasks encode; a task's memory does not depend on it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names, kinds = ["doc_id", "n", "ids", "symbols", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def tokenise(batches):
        worker.claim("rans")
        bpe = encoder(ForcedBoundaryBPE, vocabulary)
        counts = np.zeros(len(bpe.token_bytes), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = [np.append(x, bpe.dtype.type(end_id)) for x in bpe.encode_whole([x or "" for x in part.column(1).to_pylist()])]
                counts += np.bincount(np.concatenate(ids), minlength=len(counts))
                cols = [part.column(0), [len(x) for x in ids], [x.tobytes() for x in ids], [None] * len(ids), [None] * len(ids)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) if isinstance(x, list) else x for x, k in zip(cols, kinds, strict=True)], names=names)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, -1, None, used.tolist(), counts[used].tolist()), kinds, strict=True)], names=names)

    runs = materialize(docs.mapInArrow(tokenise, "doc_id long, n long, ids binary, symbols array<int>, counts array<long>"), "ids")
    table = (
        runs.where("n < 0").select(F.explode(F.arrays_zip("symbols", "counts")).alias("z"))
        .groupBy(F.col("z.symbols").alias("symbol")).agg(F.sum("z.counts").alias("n"))
    )
    counted = table.collect()  # at most one row per vocabulary entry
    counts = np.zeros(max((r["symbol"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r["symbol"]] = r["n"]
    freq = scale(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f], "symbol int, frequency long").coalesce(1).write.parquet(f"{path}/table")
    kind = vocabulary_dtype(vocabulary)

    def blocks(batches):
        from pyspark import TaskContext

        worker.claim("rans")
        coder, part, block, start, own, ids, size = Coder(freq), TaskContext.get().partitionId(), 0, 0, [], [], 0

        def packed() -> pa.RecordBatch:
            data = pack_block(coder, np.array([len(x) for x in ids], np.int64), np.concatenate(ids))
            values = zip((part, block, start, size, own, data), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in values], names=["part", "block", "start", "n", "docs", "data"])

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(data.as_buffer(), kind)
                if own and size + len(found) > BLOCK_IDS:
                    yield packed()
                    block, start, own, ids, size = block + 1, start + size, [], [], 0
                own.append(doc)
                ids.append(found)
                size += len(found)
        if own:
            yield packed()

    keys = [F.col("doc_id").asc_nulls_first(), F.col("n"), F.xxhash64("ids")]
    ordered = runs.where("n >= 0").repartitionByRange(ranges or partitions(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    schema = "part int, block int, start long, n long, docs array<long>, data binary"
    ordered.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    coded = spark.read.schema(schema).parquet(f"{path}/blocks")
    sizes = coded.groupBy("part").agg(F.sum("n").alias("n"))  # one row per range, here and in the window
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    sizes.select("part", before).coalesce(1).write.parquet(f"{path}/ranges")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the files alone: doc_id, start, n_tokens, ids (little-endian unsigned 32 bits)."""
    table = spark.read.schema("symbol int, frequency long").parquet(f"{path}/table").collect()  # bounded by the vocabulary
    freq = np.zeros(max((r["symbol"] for r in table), default=-1) + 1, np.int64)
    for r in table:
        freq[r["symbol"]] = r["frequency"]

    before = {r["part"]: r["before"] for r in spark.read.schema("part int, before long").parquet(f"{path}/ranges").collect()}  # one row per range

    def decode(batches):
        coder = Coder(freq)
        for batch in batches:
            for part, start, doc, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                start += before[part]
                lens, ids = unpack_block(coder, data)
                ends = np.cumsum(lens)
                ids = ids.astype("<u4")
                for lo in range(0, len(doc), 256):
                    hi = min(len(doc), lo + 256)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc[lo:hi], pa.int64()),
                            pa.array(start + ends[lo:hi] - lens[lo:hi], pa.int64()),
                            pa.array(lens[lo:hi], pa.int64()),
                            pa.array([ids[e - n : e].tobytes() for e, n in zip(ends[lo:hi].tolist(), lens[lo:hi].tolist(), strict=True)], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    blocks = spark.read.schema("part int, block int, start long, n long, docs array<long>, data binary").parquet(f"{path}/blocks")
    return blocks.select("part", "start", "docs", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, **columns) -> DataFrame:
    """Write the files to the shared folder and read them back.

    A null text counts as empty (its only id is the end id). Null doc_ids come first; rows that repeat
    a doc_id follow each other by length, then by a hash of their ids, and equal rows in any order: they
    spread over as many ranges as they need. A text longer than a block is a block of its own. Extra
    columns are ignored. An empty table gives files without blocks and an empty result.
    """
    path = scratch_path(docs.sparkSession, "rans")
    write(docs, vocabulary, path, **columns)
    return read(docs.sparkSession, path)
