"""Near-duplicate components: minhash with tensored banding, links confirmed on full shingle sets.

Equal sets are collapsed first, so a group of copies is one node however large it is. Each node has two
small collections of minhash keys. A table is keyed by a pair, one key of each collection: groups**2 tables
from only 2 * groups * rows minhashes. Two nodes are candidates if they meet in a table. Keys that only one
node has can form no shared table, so pairs are formed of the others alone.

No table emits all its pairs. In each round, every table that still spans several components names one
leader; members outside its component get one candidate each, links are confirmed, and components merge.
Tables that lie within one component drop out. When rounds find little more, the nodes left are joined by
prefixes of their shingles, rarest first, which misses no link between them: a shingle in the prefix is
shared by few, and a table of many unlike texts costs no more than their prefixes. Parity words give an exact
bound on how far two sets differ; pairs that cannot be links are dropped before full sets are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import worker
from .components import components, relabel
from .shingles import PARITY_WORDS, TensorHasher, digest, parity, shingle_set
from .storage import bucketed, buckets, materialize, partitions

GROUPS, ROWS = 12, 3
PERCENT = 85
LAST = 2**63 - 1
SALT_EDGES = 64
LAST_ROUND = 0.05  # rounds end when one finds fewer links a live node
WORDS = [f"p{i}" for i in range(PARITY_WORDS)]
BITMAP_BITS = 1 << 22


def _signatures(docs: DataFrame, groups: int, rows: int) -> DataFrame:
    def run(batches):
        worker.claim("near")
        hasher = TensorHasher(groups, rows)
        known: dict[bytes, tuple] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [shingle_set(t) for t in part.column(1).to_pylist()]
                names = [digest(s) if len(s) else None for s in sets]
                keys = []
                for s, g in zip(sets, names, strict=True):
                    if g is None:
                        keys.append((None, None, np.zeros(PARITY_WORDS, np.int64)))
                        continue
                    if g not in known:
                        if len(known) >= 2000:
                            known.clear()
                        known[g] = (*hasher.keys(s), parity(s))
                    keys.append(known[g])
                arrays = [pa.array([k[i] for k in keys], pa.list_(pa.int64())) for i in (0, 1)]
                words = [pa.array(w) for w in np.array([k[2] for k in keys], np.int64).reshape(-1, PARITY_WORDS).T]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), *arrays, *words], names=["d", "n", "g", "a", "b", *WORDS])

    return docs.mapInArrow(run, "d long, n long, g binary, a array<long>, b array<long>" + "".join(f", {w} long" for w in WORDS))


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in ``wanted`` (node, g, d), bucketed by node. Texts are read again, not shuffled.

    A bitmap of fixed size spares most other documents; the join with ``wanted`` makes it exact.
    """
    spot = F.pmod(F.xxhash64("d"), F.lit(BITMAP_BITS))
    rows = wanted.select((spot + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    flags = np.zeros(BITMAP_BITS // 8, np.uint8)  # at most BITMAP_BITS / 32768 rows of 4 KB; bucket and bit positions count from 1
    for r in rows:
        at = (r["k"] - 1) * 4096
        flags[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def run(batches):
        for batch in batches:
            x = batch.column(1).to_numpy()
            keep = np.flatnonzero(flags[x >> 3] >> (x & 7).astype(np.uint8) & 1)
            for lo in range(0, len(keep), 200):
                sets = [shingle_set(t) for t in batch.column(0).take(pa.array(keep[lo : lo + 200])).to_pylist()]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["g", "hashes"])

    found = docs.select("text", spot.alias("spot")).mapInArrow(run, "g binary, hashes binary")
    n = buckets(docs.sparkSession)
    found = found.join(wanted.select("g", "node"), "g").select("node", "hashes").repartition(n, "node").dropDuplicates(["node"])
    return bucketed(found, "shingle_sets", "node", n)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, count: int) -> DataFrame:
    """The (u, v) of ``pairs`` (u, v, salt), ``count`` at most, whose full sets are similar enough.

    Members stream past their leader's set: one partition holds whole (leader, salt) groups in order,
    leader first, and a task keeps one set at a time. Salts split hot leaders. All partitions compare; the
    links, two numbers each, are written to as few files as they need.
    """
    members = pairs.join(sets.withColumnRenamed("node", "v"), "v").select("u", "salt", "v", "hashes")
    leaders = pairs.select("u", "salt").distinct().join(sets.withColumnRenamed("node", "u"), "u").select("u", "salt", F.lit(None).cast("long").alias("v"), "hashes")
    n = partitions(pairs.sparkSession)
    flow = members.unionByName(leaders).repartition(n, "u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())

    def run(batches) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            us, vs = [], []
            u_col, salt_col, v_col, h_col = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                u, v = (u_col[i].as_py(), salt_col[i].as_py()), v_col[i].as_py()
                hashes = _unpacked(h_col[i].as_py())
                if v is None:
                    leader, own = u, hashes
                    continue
                if u != leader:
                    raise ValueError("a group came without its leader")
                shared = int((own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes).sum())
                if 100 * shared >= percent * (len(own) + len(hashes) - shared):
                    us.append(u[0])
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return materialize(flow.mapInArrow(run, "u long, v long"), "confirmed", rows=count, apart=True)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, groups: int = GROUPS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Linked are rows with 100 * |intersection| >= percent * |union| of their shingle sets. Null, empty and
    blank texts have no shingles and stay alone. Null doc_ids come last in order (component_id is null
    only where no other id is reachable). Rows that repeat a doc_id are the same document: all of them
    are kept, or none. Extra columns are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = materialize(_signatures(source, groups, rows), "signatures")
    nodes = signed.where("g is not null").groupBy("g").agg(F.min("d").alias("d"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), *(F.first(w).alias(w) for w in WORDS))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("node", F.explode(F.concat(F.transform("a", lambda x: F.struct(F.lit(0).alias("side"), x.alias("key"))), F.transform("b", lambda x: F.struct(F.lit(1).alias("side"), x.alias("key"))))).alias("k")).select("node", "k.*")
    shared = keys.groupBy("side", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("side", "key")
    shared = materialize(shared, "shared")  # a table of its own, here and below: the join can then split hot keys
    side = lambda i: F.collect_list(F.when(F.col("side") == i, F.col("key"))).alias("ab"[i])
    held = keys.join(shared, ["side", "key"]).groupBy("node").agg(side(0), side(1)).where((F.size("a") > 0) & (F.size("b") > 0))
    held = materialize(held, "held")
    size = held.agg(F.sum(F.size("a") * F.size("b")).alias("tables"), F.count(F.lit(1)).alias("nodes")).first()
    found = nodes.select("g", "node", "d")
    if size["nodes"]:
        tables = F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y)))))
        labels = _merge(source, nodes, held.select("node", (F.size("a") * F.size("b")).alias("weight"), tables.alias("key")), size["tables"], percent)
        if labels is not None:
            found = relabel(found, labels, "node")
    lowest = found.groupBy("node").agg(F.min("d").alias("component_id"))
    named = found.join(lowest, "node").select("g", "component_id")
    out = signed.select("d", "n", "g").join(named, "g", "left").withColumn("component_id", F.coalesce("component_id", "d"))
    return out.select(
        F.nullif("d", F.lit(LAST)).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif("component_id", F.lit(LAST)).alias("component_id"),
        (F.col("d") == F.col("component_id")).alias("kept"),
    )


def _possible(left: str, right: str, percent: int) -> Column:
    """Can two nodes (n and parity words, prefixed) be similar enough? An exact bound on their sets' difference, never wrong about a link."""
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    differ = sum((F.bit_count(F.col(left + w).bitwiseXOR(F.col(right + w))) for w in WORDS), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def _merge(source: DataFrame, nodes: DataFrame, live: DataFrame, rows: int, percent: int) -> DataFrame | None:
    """(node, root) of linked nodes; ``live`` holds (node, weight, key) for ``rows`` tables in which a node may meet others.

    The first leaders are the members with the most such tables: what others were copied from shares the most.
    """
    live = live.withColumn("root", F.col("node"))
    labels, facts, sets, many, turn = None, None, None, 0, 0

    def merged(links: DataFrame, found: int) -> None:
        """Contract the components that ``links`` join."""
        nonlocal labels, live
        ends = links if labels is None else relabel(relabel(links, labels, "u"), labels, "v")
        step = components(ends, found)
        labels = step if labels is None else materialize(relabel(labels, step, "root").unionByName(step), "labels", rows=labels.count() + found)
        live = relabel(live, step, "root")

    while True:
        rank = F.struct((F.lit(0) if turn else -F.col("weight")).alias("w"), F.xxhash64("node", F.lit(turn)).alias("x"))
        pick = F.struct(rank.alias("r"), F.col("node").alias("u"), F.col("root").alias("top"))
        spanning = live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(pick).alias("lead"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
        spanning = materialize(spanning.select("key", "lead", "size"), "spanning", rows=rows)
        met = live.join(spanning, "key").select("node", "key", "root", "lead", "size")
        live = materialize(met, "live", rows=rows)
        rows = live.count()
        if not rows:
            return labels
        if facts is None:
            wanted = materialize(nodes.join(live.select("node").distinct(), "node", "left_semi").select("node", "g", "d", "n", *WORDS), "wanted", rows=rows)
            facts, sets, many = wanted.select("node", "n", *WORDS), _full_sets(source, wanted.select("node", "g", "d")), wanted.count()
        offers = live.where("root <> lead.top").select(F.col("lead.u").alias("u"), F.col("node").alias("v"), F.col("lead.r").alias("r"), "size").groupBy("u", "v", "r").agg(F.max("size").alias("size"))
        chosen = _plausible(offers, facts, percent).groupBy("v").agg(F.min_by(F.struct("u", "size"), "r").alias("to"))
        chosen = chosen.select("to.u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("to.size") / SALT_EDGES)).cast("int").alias("salt"))
        links = _confirm(materialize(chosen, "chosen", rows=rows), sets, percent, many)  # one pair a node at most
        found = links.count()
        live = live.select("node", "key", "root")
        if found:
            merged(links, found)
        turn += 1
        if found <= LAST_ROUND * many:
            break
    ends = live.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = live.join(materialize(ends, "spanning", rows=rows), "key").select("node", "root").distinct()
    rest = _by_prefix(materialize(left, "left", rows=rows), facts, sets, percent)
    count = rest.count()
    if count:
        links = _confirm(rest, sets, percent, count)
        if found := links.count():
            merged(links, found)
    return labels


def _plausible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (u, v, more) that the parity words leave possible."""
    named = lambda prefix: facts.select(*(F.col(c).alias(prefix + c) for c in ("node", "n", *WORDS)))
    met = pairs.join(named("u_"), F.col("u") == F.col("u_node")).join(named("v_"), F.col("v") == F.col("v_node"))
    return met.where(_possible("u_", "v_", percent)).select(*pairs.columns)


def _by_prefix(left: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Possible links (u, v, salt) between nodes of ``left`` (node, root) in different components; misses none.

    Shingles are put in one order, rarest first. If two sets are similar enough, the first shingle they share
    lies among the first n - ceil(2pn / (100 + p)) + 1 of the smaller one and the first m - ceil(pm / 100) + 1
    of the other. Shingles that one node alone holds come first and lead to no pair.
    """
    total = left.join(facts, "node").agg(F.sum("n")).first()[0] or 0
    each = sets.join(left, "node").select("node", "root", "hashes")

    def spread(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                n = len(h)
                same = lambda v: pa.array(np.full(n, v, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(batch.column(0)[i].as_py()), same(batch.column(1)[i].as_py()), same(n), pa.array(h)], names=["node", "root", "n", "h"])

    held = each.mapInArrow(spread, "node long, root long, n long, h long")
    common = materialize(held.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "common", rows=total)
    lists = held.join(common, "h").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("f", "h"))).alias("own"))  # as long as a text
    alone = F.col("n") - F.size("own")
    probe, index = (F.expr(f"n - (n * {a} + {b} - 1) div {b} + 1") for a, b in ((percent, 100), (2 * percent, 100 + percent)))
    entries = lists.select("node", "root", "n", (index - alone).alias("index"), F.posexplode(F.slice("own", F.lit(1), F.greatest(F.lit(0), probe - alone).cast("int"))).alias("i", "x"))
    entries = materialize(entries.select(F.col("x.h").alias("h"), "node", "root", "n", (F.col("i") < F.col("index")).alias("short")), "prefixes", rows=total)
    # Of each shingle, the component of one member drawn by hash is its main one; pairs have an end outside it.
    drawn = F.min(F.struct(F.xxhash64("node"), F.col("root").alias("main")))["main"].alias("main")
    mixed = entries.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), drawn).where("lo <> hi").select("h", "main")
    words = facts.select("node", *WORDS)
    entries = materialize(entries.join(materialize(mixed, "mixed", rows=total), "h").join(words, "node"), "entries", rows=total)
    c = F.col
    named = lambda prefix, rows: rows.select(*(c(x).alias(prefix + x) for x in entries.columns))
    short, long = named("u_", entries.where("short")), named("v_", entries)
    fits = (c("u_h") == c("v_h")) & (c("u_root") != c("v_root")) & (F.struct("u_n", "u_node") < F.struct("v_n", "v_node")) & _possible("u_", "v_", percent)
    outer = short.where("u_root <> u_main").join(long, fits).select("u_node", "v_node")
    inner = short.where("u_root = u_main").join(long.where("v_root <> v_main"), fits).select("u_node", "v_node")
    pairs = outer.unionByName(inner).select(c("u_node").alias("u"), c("v_node").alias("v")).distinct()
    return materialize(pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(8)).cast("int").alias("salt")), "rest", rows=total)
