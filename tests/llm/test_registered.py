"""Every registered query, called as the driver calls it, against brute force: all rows, all columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tidemark.llm import pii, quality

from .common import BYTE, WORD, base_spans, discovered_spans, documents, exact_groups, fingerprint as brute_fingerprint, likeness as brute_likeness, near_components, repeats as brute_repeats

SF = "/root/testdata/sf0.001"


def run(spark, name, sf=SF):
    return entry.queries()[name](spark, sf).collect()


def texts(spark, sf=SF):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture
def folder(spark, tmp_path):
    """Puts texts into a folder of tables, as the queries read them."""

    def make(rows=None):
        documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


def spans_as_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_op6(spark, folder):
    two_kinds = ["a@b.cd and c@d.ef at 10.0.0.1", "+1 (269) 555-3296 or 4111 1111 1111 1111, 1.2.3.4 and 5.6.7.8 and x@y.zz", "8.8.8.8", "nothing", None, ""]
    for sf in (SF, folder(two_kinds)):
        rows, got = texts(spark, sf), {r["doc_id"]: r for r in run(spark, "op6_pii", sf)}
        assert len(got) == len(rows)
        for k, t in rows:
            base, r = base_spans(t), got[k]
            assert {x: r[f"n_{x}"] for x in pii.KINDS} == {x: sum(s[0] == x for s in base) for x in pii.KINDS}, t[:80]
            assert r["base_sha256"] == hashlib.sha256(spans_as_text(base).encode()).hexdigest()
            every = [x.split(":") for x in r["spans"].split(",") if x]
            assert set(map(tuple, base)) <= {(x, int(a), int(b)) for x, a, b in every}
            assert every == sorted(every, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))


def test_discovery_against_plain_dictionaries(spark):
    """Contexts beyond any fixed distance, in tabs and lines, at both ends of a text, shared or not, of one kind or two."""
    far = " " * 300
    some = [f"please write to{far}user{i:03d}@mail.example.com\ttoday, or call\n+1 (269) 555-{3296 + i} tonight" for i in range(30)]
    some += ["please write to\nuser777@mail_example today", "or call 269 555 0199 tonight, 12 monkeys", f"to{far}x@y today", "9 9 9", "5@5 today 7", None, ""]
    some += [f"mixed 10.0.0.{i} or" for i in range(12)] + [f"mixed m{i}@example.org or" for i in range(8)] + ["mixed 99 or", "mixed ab@cd or"]
    some += [f"card no {n}" for n in ("4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220", "4539578763621486", "4716461583322103", "4024007136512380", "4111111111111112", "411111111111111")]
    for rows in (some, [t for _, t in texts(spark)]):
        docs = documents(spark, rows)
        got = {r["doc_id"]: {(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]} for r in pii.spans(docs).collect()}
        more = discovered_spans(rows)
        assert [got[10 + 3 * i] for i in range(len(rows))] == [set(base_spans(t)) | x for t, x in zip(rows, more)]
    assert sum(map(bool, discovered_spans(some))) > 3


def test_op2(spark):
    rows, got = texts(spark), {r["doc_id"]: r for r in run(spark, "op2_exact_dedup")}
    want = exact_groups(rows)
    assert len(got) == len(rows)
    for k, t in rows:
        r = got[k]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (*want[k], want[k][0] == k)
        assert r["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()


def test_op7(spark):
    rows, got = texts(spark), {r["doc_id"]: r for r in run(spark, "op7_repeats")}
    for k, (n, removed, spans, left) in brute_repeats(rows).items():
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, hashlib.sha256(left).hexdigest())
    assert len(got) == len(rows)


def test_op10(spark):
    rows, got = texts(spark), {r["doc_id"]: r for r in run(spark, "op10_near_dedup")}
    want = near_components(rows, 85)
    assert len(got) == len(rows)
    assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == {k: (n, c, k == c) for k, (n, c) in want.items()}


@pytest.fixture(scope="module")
def libraries():
    from tidemark.llm.bpe import load_tokenizer

    return {path: load_tokenizer(path) for path in (BYTE, WORD)}


def ids_of(library, text, *end):
    return np.array([*library.encode(text, add_special_tokens=False).ids, *end], "<u4")


def test_op3(spark, libraries):
    got, start = {r["doc_id"]: r for r in run(spark, "op3_rans")}, 0
    rows = texts(spark)
    assert len(got) == len(rows)
    for k, t in rows:
        ids = ids_of(libraries[BYTE], t, 0)
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op4(spark, libraries):
    rows, found = texts(spark), run(spark, "op4_packing")
    pieces = {(r["doc_id"], r["piece"]): r for r in found}
    assert len(pieces) == len(found)
    total, count = 0, 0
    for k, t in rows:
        ids = ids_of(libraries[WORD], t, 0)
        for lo in range(0, len(ids), 2048):
            part, r = ids[lo : lo + 2048], pieces[k, lo // 2048]
            assert (r["start"], r["length"], r["ids_crc32"]) == (lo, len(part), zlib.crc32(part.tobytes()))
            count += 1
        total += len(ids)
    assert count == len(found)
    at: dict = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and len(at) <= -(-total // 2048) + 2


def test_op9(spark, libraries):
    rows, got = texts(spark), {r["doc_id"]: r for r in run(spark, "op9_bpe")}
    assert len(got) == len(rows)
    for k, t in rows:
        ids = ids_of(libraries[BYTE], t)
        back = libraries[BYTE].decode(ids.tolist(), skip_special_tokens=False)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[k]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_op5(spark, folder):
    odd = ["a", "a\n", "a\n\n", "\n", "", None, "b\na", "a\nb", "one two three four five six seven\nshort", "日本語 " * 20 + "\n😀\x00\x1f", "x" * 100, "tab\tand\x0bothers here are all white space\r\n"]
    for sf in (SF, folder(odd)):
        rows, got = texts(spark, sf), {r["doc_id"]: r for r in run(spark, "op5_fingerprint", sf)}
        assert len(got) == len(rows)
        prints = [brute_fingerprint(t) for _, t in rows]
        as_text = lambda f: f"{f[0]}-{f[1]}/" + ".".join(map(str, f[2]))
        for i, (k, t) in enumerate(rows):
            j, q, r = (i + 1) % len(rows), len(t) // 4, got[k]
            edited = t[: len(t) - q] + rows[j][1][:q]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert r["fingerprint"] == as_text(prints[i]), t[:60]
            assert r["edited_fingerprint"] == as_text(brute_fingerprint(edited))
            assert abs(r["near_edited"] - brute_likeness(prints[i], brute_fingerprint(edited))) < 1e-9
            assert abs(r["near_next"] - brute_likeness(prints[i], prints[j])) < 1e-9


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op5_fingerprint", "op6_pii"])
def test_native_queries_use_expressions_only(spark, name, monkeypatch):
    """No plan on the way, of the result or of a table written before it, has Python in it."""
    from tidemark.llm import exact_dedup, fingerprint, pii as pii_module

    plans = []

    def watched(module):
        write = module.materialize

        def seen(df, *args, **kwargs):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return write(df, *args, **kwargs)

        monkeypatch.setattr(module, "materialize", seen)

    for module in (exact_dedup, fingerprint, pii_module):
        watched(module)
    plans.append(entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 2 and not any(x in plan for plan in plans for x in ("Python", "Arrow", "Pandas", "Cartesian", "MapPartitions"))


def test_rans_in_any_number_of_ranges(spark, libraries):
    """More ranges than documents, one id held by most rows, and no table left in the catalog."""
    from tidemark.llm import rans

    docs = documents(spark, ["same"] * 30 + [f"text {i}" for i in range(30)] + [None, ""])
    one = docs.selectExpr("CASE WHEN text = 'same' THEN 7 WHEN text IS NOT NULL THEN doc_id END AS doc_id", "text")
    for ranges in (1, 300):
        got, start = sorted(rans.round_trip(one, BYTE, ranges=ranges).collect(), key=lambda r: r["start"]), 0
        assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in one.collect()), key=lambda x: (x is not None, x or 0))
        for r in got:
            assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
            start += r["n_tokens"]
    assert not [t for t in spark.catalog.listTables() if "ids" in t.name or "run" in t.name]


def test_op1(spark):
    """Against a plain reading of these pages: paragraphs and the title within the one article element."""
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in run(spark, "op1_html_text")}
    assert set(got) == set(pages)
    for k, page in pages.items():
        body = re.search(r"<article>(.*?)(</article>|$)", re.sub(r"<!--.*?-->", "", page["html"], flags=re.S), re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        text = "\n".join(x for x in want if x)
        assert (got[k]["url"], got[k]["text"], got[k]["n_chars"]) == (page["url"], text, len(text))


def plain_statistics(text: str) -> list[float]:
    """The document statistics, each by its own plain loop."""
    import math

    words = (text or "").split()
    if not words:
        return [0.0] * len(quality.STATISTICS)
    data, w = text.encode(), len(words)
    out = [sum(b in members for b in data) / len(data) for members in quality._BYTE_CLASSES.values()]
    pairs = list(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    out += [math.log1p(len(data)), math.log1p(w), sum(len(x) for x in words) / w, max(len(x) for x in words), len(set(words)) / w, max(words.count(x) for x in set(words)) / w]
    out += [sum(a == b for a, b in pairs) / w, len(set(pairs)) / len(pairs) if pairs else 1.0]
    out += [sum(f(x) for x in words) / w for f in (lambda x: x[0].isupper(), str.isupper, lambda x: not x[-1].isalnum() and x[-1] not in ".,;:?\"')", lambda x: x[-1] in ".?", lambda x: not any(c.isalpha() for c in x))]
    return [*out, len(set(lines)) / len(lines), math.log1p(w / len(lines))]


def plain_trees(x, y, trees=80, depth=4, bins=64, rate=0.12, l2=1.0, least=2.0):
    """The same boosting with nested dictionaries, a loop for every split and no histogram: scores of a row."""
    base = np.log(y.mean() / (1 - y.mean()))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    raw, grown = np.full(len(y), base), []

    def grow(rows, g, h, level):
        if level == depth or not len(rows):
            return -rate * g[rows].sum() / (h[rows].sum() + l2)
        best = (1e-6, None, None)
        for j in range(x.shape[1]):
            for e in edges[j]:
                left = x[rows, j] <= e
                a, b, c, d = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                if b >= least and d >= least and (gain := a * a / (b + l2) + c * c / (d + l2) - (a + c) ** 2 / (b + d + l2)) > best[0] + 1e-9:
                    best = (gain, j, e)
        if best[1] is None:
            return grow(rows, g, h, level + 1)
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[left], g, h, level + 1), grow(rows[~left], g, h, level + 1)

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), 0)
        grown.append(tree)
        raw += [walk(tree, row) for row in x]
    return lambda row: 1 / (1 + np.exp(-(base + sum(walk(t, row) for t in grown))))


def test_boosting_against_plain_loops():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(120, 3)), 2)
    y = ((x[:, 0] + 0.3 * x[:, 1] ** 2 + rng.normal(size=120) * 0.3) > 0.2).astype(float)
    model = quality.fit(x, y, trees=6, depth=3, bins=16)
    slow = plain_trees(x, y, trees=6, depth=3, bins=16)
    assert np.allclose(model.score(x), [slow(row) for row in x], atol=1e-9)


def test_op8(spark):
    rows, got = texts(spark), {r["doc_id"]: r for r in run(spark, "op8_quality")}
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if not held(r["doc_id"])}
    found = dict(rows)
    ids = sorted(k for k in known if k in found)
    model = quality.fit(np.array([plain_statistics(found[k]) for k in ids]), np.array([float(known[k]) for k in ids]))
    want = model.score(np.array([plain_statistics(t) for _, t in rows]))
    assert len(got) == len(rows)
    for (k, _), w in zip(rows, want):
        assert got[k]["held_out"] == held(k) and abs(got[k]["score"] - w) < 1e-9 and got[k]["predicted"] == int(w >= 0.5)
    for t in ("", " \n", "a", "x" * 1000, "One two.\n\nthree THREE three, four!"):
        assert np.allclose(quality.statistics(t), plain_statistics(t))


def test_rows_without_doc_id_and_repeated_rows(spark):
    """Every operator treats them as its docstring says, beside long texts and columns whose names it uses itself."""
    from tidemark.llm import bpe, near_dedup, packing, repeats

    some = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta", None, "", "word " * 30000, "p q r s t u v " * 60]
    docs = documents(spark, some).withColumn("doc_id", F.when(F.col("doc_id") > 13, F.col("doc_id")))
    docs = docs.unionByName(docs)
    n = docs.count()
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.collect())
    want = ids(docs)
    assert ids(bpe.encode_decode(docs, BYTE)) == want
    assert ids(repeats.remove_repeats(docs)) == want
    near = near_dedup.near_duplicates(docs)
    assert ids(near) == want and all(r["component_id"] is None and r["kept"] for r in near.where("doc_id IS NULL").collect())
    pieces = packing.pack(docs, WORD)
    assert ids(pieces.where("piece = 0")) == want and pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    labels = spark.createDataFrame([(16, 1, 0), (16, 0, 0), (22, 0, 1), (None, 1, 0), (25, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score_documents(docs, labels)
    by_text = {}
    for r in scored.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert ids(scored) == want and all(len(v) == 1 for v in by_text.values()) and not scored.where("doc_id IS NULL AND held_out").count()
    assert pii.redact(docs).count() == n and pii.redact(docs.where("false")).count() == 0
    assert pii.redact(docs.where("doc_id IS NULL")).columns == docs.columns
