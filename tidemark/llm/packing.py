"""Packing documents into fixed-length sequences by swap-based local search.

Only lengths take part. Pieces are dealt evenly into shards of bounded size (the deal ignores keys, so
no hot key fills a shard). Within a shard, best fit gives a start; then documents are moved or exchanged
one for one or two for one between underfull bins, always raising the sum of squared fills, until bins
empty and nothing improves. The emptier bins of all shards are then packed together in a second round.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker
from .bpe import WordSplitBPE, encoder
from .storage import materialize

CAPACITY = 2048
SHARD_PIECES = 50_000


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, goes to the fullest bin that takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []  # rooms: bit r is set if some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


class _Search:
    """Underfull bins, with an index from length to the bins that hold it."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = {b: list(x) for b, x in enumerate(bins)}
        self.fill = {b: sum(lengths[i] for i in x) for b, x in self.bins.items()}
        self.holders: dict[int, dict[int, int]] = defaultdict(dict)
        self.present = 0
        for b, items in self.bins.items():
            for i in items:
                self._note(lengths[i], b, 1)

    def _note(self, n: int, b: int, by: int) -> None:
        held = self.holders[n]
        held[b] = held.get(b, 0) + by
        if not held[b]:
            del held[b]
        self.present = self.present | 1 << n if held else self.present & ~(1 << n)

    def shift(self, a: int, b: int, give: list[int], take: list[int]) -> None:
        """a gives items of the lengths ``give`` to b and takes ``take``."""
        for source, target, wanted in ((a, b, give), (b, a, take)):
            for n in wanted:
                i = next(i for i in self.bins[source] if self.lengths[i] == n)
                self.bins[source].remove(i)
                self.bins[target].append(i)
                self._note(n, source, -1)
                self._note(n, target, 1)
                self.fill[source] -= n
                self.fill[target] += n
        for x in (a, b):
            if not self.bins[x]:
                del self.bins[x], self.fill[x]

    def donor(self, n: int, a: int, tries: int = 64) -> int | None:
        """An underfull bin, not fuller than a, that holds length n; of the first few, the emptiest."""
        best = None
        for b in self.holders[n]:
            if b != a and self.fill[b] <= self.fill[a] and (best is None or self.fill[b] < self.fill[best]):
                best = b
            tries -= 1
            if not tries:
                break
        return best

    def longest(self, least: int, most: int):
        """Lengths that some underfull bin holds, from most down to least."""
        left = (self.present & ((1 << (most + 1)) - 1)) >> least
        for _ in range(64):
            if not left:
                return
            top = left.bit_length() - 1
            yield least + top
            left ^= 1 << top

    def improve(self, a: int, emptiest: list[int]) -> bool:
        room = self.capacity - self.fill[a]
        own = sorted({self.lengths[i] for i in self.bins[a]}, reverse=True)
        best: tuple = (0,)
        for x in (0, *own):  # 0: take without giving
            if best[0] == room:
                break
            for y in self.longest(x + max(1, best[0] + 1), x + room):
                b = self.donor(y, a)
                if b is not None:
                    best = (y - x, b, [x] if x else [], [y])
                    break
        for b in emptiest:
            if best[0] == room:
                break
            if b == a or b not in self.bins or self.fill[b] > self.fill[a]:
                continue
            theirs = sorted(self.lengths[i] for i in self.bins[b])
            for x in own:
                lo, hi = 0, len(theirs) - 1
                while lo < hi:  # the largest sum of two that fits
                    gain = theirs[lo] + theirs[hi] - x
                    if gain > room:
                        hi -= 1
                    else:
                        if gain > best[0]:
                            best = (gain, b, [x], [theirs[lo], theirs[hi]])
                        lo += 1
        if not best[0]:
            return False
        self.shift(a, best[1], best[2], best[3])
        return True


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Passes over the underfull bins, fullest first, until none finds a step or no fewer bins are possible.

    Each step raises the sum of squared fills, so the search ends. The emptiest bins are chosen anew as bins empty.
    """
    done = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    search = _Search(lengths, [b for b in bins if sum(lengths[i] for i in b) < capacity], capacity)
    least = -(-sum(search.fill.values()) // capacity)  # underfull and filled from now on
    changed, filled = True, 0
    while changed and filled + len(search.bins) > least:
        changed = False
        emptiest = _emptiest(search)
        for a in sorted(search.bins, key=lambda b: -search.fill[b]):
            while a in search.bins and search.fill[a] < capacity and search.improve(a, emptiest):
                changed = True
                if not all(b in search.bins for b in emptiest):
                    emptiest = _emptiest(search)
            if a in search.bins and search.fill[a] == capacity:
                for i in search.bins[a]:
                    search._note(lengths[i], a, -1)
                done.append(search.bins.pop(a))
                del search.fill[a]
                filled += 1
    return done + list(search.bins.values())


def _emptiest(search: _Search) -> list[int]:
    return heapq.nsmallest(64, search.bins, key=search.fill.__getitem__)


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity)


def cut(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise every text, append ``end_id``, cut longer ones: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        worker.claim("pack")
        bpe = encoder(WordSplitBPE, vocabulary)
        for batch in batches:
            doc, rows = batch.column(0), []
            for i, ids in enumerate(bpe.encode_batch([x or "" for x in batch.column(1).to_pylist()])):
                ids = np.append(ids, bpe.dtype.type(end_id)).astype("<u4")
                rows += [(i, lo // capacity, lo, len(ids[lo : lo + capacity]), zlib.crc32(ids[lo : lo + capacity].tobytes())) for lo in range(0, len(ids), capacity)]
            at, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            cols = [doc.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _pack_shards(pieces: DataFrame, shard_pieces: int, capacity: int, stage: int) -> DataFrame:
    """Adds sequence_id, offset and fill; every shard is one partition of about ``shard_pieces`` rows."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema.fields)

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        lengths = rows["length"].to_pylist()
        bins = pack_lengths(lengths, capacity)
        first = (stage << 60) + (TaskContext.get().partitionId() << 32)
        order = np.concatenate([np.array(b) for b in bins])
        sizes = np.array([len(b) for b in bins])
        own = np.array(lengths)[order]
        ends = np.cumsum(own)
        begins = np.repeat(np.concatenate([[0], ends[np.cumsum(sizes)[:-1] - 1]]), sizes)
        fills = np.add.reduceat(own, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        out = rows.take(pa.array(order))
        out = out.append_column("sequence_id", pa.array(np.repeat(first + np.arange(len(bins)), sizes), pa.int64()))
        out = out.append_column("offset", pa.array(ends - own - begins, pa.int64()))
        out = out.append_column("fill", pa.array(np.repeat(fills, sizes), pa.int64()))
        yield from out.to_batches(50_000)

    n = pieces.count()
    return pieces.select(*names).repartition(max(1, -(-n // shard_pieces))).mapInArrow(run, f"{schema}, sequence_id long, offset long, fill long")


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty (one piece holding the end id). Null and repeated doc_ids are packed as
    they come, each row apart. Texts longer than a sequence are cut, however long. Ties in length are broken by
    the order of rows. Extra columns are ignored. An empty table gives an empty result.
    """
    pieces = materialize(cut(docs, vocabulary, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity), "pieces")
    whole = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = materialize(_pack_shards(pieces.where(F.col("length") < capacity), shard_pieces, capacity, 0), "packed")
    settled = first.where(F.col("fill") * 10 >= 9 * capacity).drop("fill")
    rest = _pack_shards(first.where(F.col("fill") * 10 < 9 * capacity), shard_pieces, capacity, 1).drop("fill")
    return whole.unionByName(settled).unionByName(rest)
