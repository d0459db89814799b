import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, exact_dedup, fingerprint, near_dedup, repeats, rlbwt, shingles

from .common import PASSAGE, TEXTS, documents, edited, exact_groups, near_components, prose, repeats as brute_repeats


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_exact(spark):
    texts = [*TEXTS, *["same  text"] * 30, *["same\ttext "] * 2]
    docs = documents(spark, texts)
    want = exact_groups(pairs(docs))
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs, heavy=4, tracked=8).collect()}
    assert {k: (r["keep_id"], r["group_size"]) for k, r in got.items()} == want
    assert all(r["kept"] == (r["keep_id"] == k) for k, r in got.items())
    assert got[13]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.exact_dedup(docs.where("false")).count() == 0
    odd = docs.selectExpr("CASE WHEN doc_id > 20 THEN doc_id END AS doc_id", "text")
    assert exact_dedup.exact_dedup(odd.union(odd)).count() == 2 * len(texts)


def test_only_expressions_in_exact(spark):
    plan = exact_dedup.exact_dedup(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("few", [10**6, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_EDGES", few)
    r = random.Random(1)
    for edges in ([(1, 2), (3, 2), (4, 4)], [(i, i + 1) for i in range(40)], [(r.randrange(120), r.randrange(120)) for _ in range(80)]):
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for u, v in edges:
            parent[find(u)] = find(v)
        got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u long, v long"), len(edges)).collect()}
        groups: dict = {}
        for x in parent:
            groups.setdefault(find(x), set()).add(got.get(x, x))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_near(spark):
    base = prose(150, 21)
    texts = [*TEXTS, *[edited(base, 75, s) for s in range(12)], *[edited(base, 9, s) for s in range(8)], *[f"{PASSAGE} {prose(90, 100 + s)}" for s in range(10)], "a b c d", "A B  c\td", "e f"]
    docs = documents(spark, texts)
    want = near_components(pairs(docs))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0
    twice = near_dedup.near_duplicates(docs.union(docs)).collect()
    assert len(twice) == 2 * len(texts) and {r["doc_id"]: r["component_id"] for r in twice} == {k: v[1] for k, v in want.items()}


def test_near_rounds_and_rest_agree(spark, monkeypatch):
    """Without rounds after the first, everything left goes through the last join."""
    base = prose(100, 33)
    docs = documents(spark, [edited(base, 30 + s % 40, s) for s in range(60)])
    want = {k: v[1] for k, v in near_components(pairs(docs)).items()}
    for last in (10**9, 0.0):
        monkeypatch.setattr(near_dedup, "LAST_ROUND", last)
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == want


def test_near_writes_links_to_few_files(spark, monkeypatch):
    """All partitions compare sets, but the links go to as few files as they need, and none is lost."""
    from tidemark.llm import storage

    texts = [t for i in range(12) for t in (prose(100, 200 + i), prose(100, 200 + i) + " more")]
    docs = documents(spark, texts)
    want = {k: v[1] for k, v in near_components(pairs(docs)).items()}
    files, makers = [], []

    def seen(df, name, **options):
        made = storage.materialize(df.withColumn("maker", F.spark_partition_id()) if name == "confirmed" else df, name, **options)
        if name != "confirmed":
            return made
        files.append(len(made.inputFiles()))
        makers.append(made.select("maker").distinct().count())
        return made.drop("maker")

    monkeypatch.setattr(near_dedup, "materialize", seen)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == want
    assert len(set(want.values())) == 12 and max(makers) > 1 and set(files) == {1}


def test_parity_never_exceeds_the_difference():
    import numpy as np

    r = random.Random(5)
    for _ in range(50):
        a = shingles.shingle_set(prose(200, r.randrange(10**6)))
        b = np.unique(np.concatenate([a[r.randrange(20) :], shingles.shingle_set(prose(r.randrange(9, 60), r.randrange(10**6)))]))
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in shingles.parity(a) ^ shingles.parity(b))
        assert differ <= len(np.setxor1d(a, b))


def test_tables_find_similar_sets():
    hasher, found = shingles.TensorHasher(near_dedup.GROUPS, near_dedup.ROWS), 0
    for s in range(60):
        one, two = prose(400, s), edited(prose(400, s), 62, s)
        (a, b), (c, d) = hasher.keys(shingles.shingle_set(one)), hasher.keys(shingles.shingle_set(two))
        found += bool(set(a) & set(c)) and bool(set(b) & set(d))
    assert found == 60


def test_run_index():
    r = random.Random(5)
    for _ in range(40):
        strings = [bytes(r.choice(b"ab\0\xff"[: r.randint(1, 4)]) for _ in range(r.randint(0, 50))) for _ in range(r.randint(1, 7))]
        strings += [strings[0][3:] + b"q" + strings[-1]]
        index = rlbwt.build(strings)
        longest = index.matching_statistics()
        suffixes = [s[j:] for s in strings for j in range(len(s))]
        at = [int(index.starts[i]) + j for i, s in enumerate(strings) for j in range(len(s))]

        def common(a, b):
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            return k

        for x, p in enumerate(at):
            assert longest[p] == max((common(suffixes[x], s) for y, s in enumerate(suffixes) if y != x), default=0)
        assert index.lengths.sum() == len(index.text) and len(index.runs) == len(index.heads) == len(index.tails)


@pytest.mark.parametrize("group_bytes", [repeats.GROUP_BYTES, 1000])
def test_repeats(spark, group_bytes):
    r = random.Random(2)
    common = "".join(r.choices("abc dé", k=230))
    texts = [*TEXTS, common, "zz" + common + "yy", common[:190], "ab" * 500 + common[5:], common + common, "k" * 199, "k" * 201]
    texts += ["".join(r.choices("qrst", k=r.randint(0, 150))) + common[r.randint(0, 20) : r.randint(200, 230)] + "".join(r.choices("uvw", k=90)) for _ in range(60)]
    docs = documents(spark, texts)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in repeats.remove_repeats(docs, group_bytes=group_bytes).collect()}
    assert got == brute_repeats(pairs(docs))


def test_repeats_edges(spark):
    docs = documents(spark)
    assert repeats.remove_repeats(docs.where("false")).count() == 0
    twice = repeats.remove_repeats(docs.union(docs)).collect()
    assert len(twice) == 2 * len(TEXTS) and all(x["n_removed"] == x["n_bytes"] for x in twice if x["n_bytes"] >= 200)


def test_repeats_need_little_memory():
    """A worker's memory counts with its executor's: what the arrays of segments and of an index take at most."""
    texts = [prose(400, i // 3).encode() for i in range(600)]
    list(repeats._slices(texts, 200))
    repeats._scaled()
    tracemalloc.start()
    try:
        found = 0
        for group in repeats._slices(texts, 200):
            data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
            size = np.array([len(x[2]) for x in group])
            found += len(repeats.segments(data, np.cumsum(size) - size, 200, 64)[0])
        most = tracemalloc.get_traced_memory()[1]
        assert found and most < 16e6
        strings = [t[k : k + 230] for t in texts[:300] for k in range(0, 1000, 57)]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        index = rlbwt.build(strings)
        start, end = index.long_matches(200)
        most = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert len(start) and most < 64 * len(index.text)


def test_long_texts_are_cut_into_overlapping_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    docs = documents(spark, [prose(900, 1), prose(900, 1)[700:3000], prose(500, 4)])
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in repeats.remove_repeats(docs).collect()}
    assert got == brute_repeats(pairs(docs))


def test_fingerprints(spark):
    docs = documents(spark, [*TEXTS, prose(200, 50), prose(200, 51)])
    rows = sorted(pairs(docs))
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    texts = [t or "" for _, t in rows]
    prints: dict = {}
    for i, (k, t) in enumerate(rows):
        t, after = t or "", texts[(i + 1) % len(rows)]
        q = len(t) // 4
        want = t[: len(t) - q] + after[:q]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
        assert prints.setdefault(t, got[k]["fingerprint"]) == got[k]["fingerprint"]
    assert len(set(prints.values())) == len(prints)
    last = got[10 + 3 * len(TEXTS)]
    assert last["near_edited"] > 0.6 > 0.3 > last["near_next"]


def test_fingerprint_edges(spark):
    docs = documents(spark)
    assert fingerprint.fingerprints(docs.where("false")).count() == 0
    one = fingerprint.fingerprints(documents(spark, ["abcdefgh"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    twice = fingerprint.fingerprints(docs.union(docs)).collect()
    assert len(twice) == 2 * len(TEXTS)
    odd = docs.selectExpr("CASE WHEN doc_id > 12 THEN 5 END AS doc_id", "text")
    assert fingerprint.fingerprints(odd).count() == len(TEXTS)


def test_paragraphs_form_a_multiset(spark):
    """Order does not matter; inserting and deleting paragraphs adds and subtracts."""
    a, b, c = (prose(30, s) for s in (1, 2, 3))
    frame = spark.createDataFrame([(0, f"{a}\n{b}"), (1, f"{b}\n{a}"), (2, a), (3, b), (4, f"{a}\n{b}\n{a}"), (5, c)], "d int, text string")
    got = {r["d"]: r for r in fingerprint.collect(fingerprint.split_elements(frame, ["d"]), ["d"]).collect()}
    same = lambda x, y: (x["wide"], x["pairs"], x["near"]) == (y["wide"], y["pairs"], y["near"])
    assert same(got[0], got[1]) and not same(got[0], got[4])
    table = fingerprint.collect(fingerprint.split_elements(frame, ["d"]), ["d"]).select("d", F.struct("wide", "pairs", "near").alias("f"))
    joined = table.where("d = 2").select(F.col("f").alias("x")).join(table.where("d = 3").select(F.col("f").alias("y")))
    both = joined.select(fingerprint.combine(F.col("x"), F.col("y")).alias("z"), "y").select("z", fingerprint.combine(F.col("z"), F.col("y"), -1).alias("back")).first()
    assert same(both["z"], got[0]) and same(both["back"], got[2])
