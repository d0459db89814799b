import html
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import bpe, html_text, packing, pii, quality, rans

from .common import BYTE, TEXTS, WORD, base_spans, documents, prose


@pytest.mark.parametrize("kind,path", [(bpe.ForcedBoundaryBPE, BYTE), (bpe.WordSplitBPE, WORD)])
def test_encoders_equal_the_library(kind, path):
    mine, texts = kind(path, cache_bytes=2000), [t or "" for t in TEXTS]  # a cache this small is dropped again and again
    texts += ["a  b   \n\n c", "?'s don't'll 's\t\tzqxj Zq", "\r\n \r\n a", " x　 　 y", "İstanbul ŉ ﬁ Σας ΣΑΣ", "x\x85y z", "a" * 5000, "'\n's ' s", "<|startoftext|>a", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|> c", "<|endoftext|", " <|endoftext|>\n\nX", "<|endoftext|><|startoftext|> Y"]
    library = bpe.load_tokenizer(path)
    for _ in range(2):
        for text, ids in zip(texts, mine.encode_batch(texts)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]


def test_cuts_are_forced_and_decoding_inverts():
    mine = bpe.ForcedBoundaryBPE(BYTE)
    for text in TEXTS:
        parts = mine.fragments(text or "")
        assert b"".join(parts) == (text or "").encode()
        assert all(mine.forced[a[-1] << 8 | b[0]] for a, b in zip(parts, parts[1:]))
    for text, whole in zip(TEXTS, mine.encode_whole([t or "" for t in TEXTS])):
        assert mine.decode(whole) == (text or "")
    assert mine.decode([]) == "" and mine.decode(mine.encode_batch(["😀"])[0][:1]) == "�"


def test_encode_decode_query(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, BYTE).collect()}
    library = bpe.load_tokenizer(BYTE)
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids) and bytes(got[r["doc_id"]]["ids"]) == np.array(ids, "<u4").tobytes()
        assert got[r["doc_id"]]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs.union(docs), BYTE).count() == 2 * len(TEXTS) and bpe.encode_decode(docs.where("false"), BYTE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 300_000])
def test_rans_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint16)
    coder = rans.Coder(rans.scale(np.bincount(ids, minlength=50_001)))
    data = rans.pack_block(coder, np.array([n]), ids)
    lens, back = rans.unpack_block(coder, data)
    assert (lens == [n]).all() and (back == ids).all()
    if n > 64:
        broken = bytearray(data)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            rans.unpack_block(coder, bytes(broken))
        parts = list(rans.segments(data))  # each decodes alone
        assert sum(len(coder.decode(k, lanes, state, words)) for k, lanes, _, state, words in parts) == n


def test_scale_keeps_rare_symbols():
    counts = np.array([10**12, 1, 0, 1])
    freq = rans.scale(counts)
    assert freq.sum() == 1 << rans.PRECISION and (freq[[1, 3]] >= 1).all() and freq[2] == 0


def test_rans_files(spark):
    docs = documents(spark)
    library, start = bpe.load_tokenizer(BYTE), 0
    got = {r["doc_id"]: r for r in rans.round_trip(docs.repartition(5), BYTE).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], bytes(got[r["doc_id"]]["ids"])) == (start, len(ids), ids.tobytes())
        start += len(ids)
    assert rans.round_trip(docs.where("false"), BYTE).count() == 0
    odd = docs.selectExpr("CASE WHEN doc_id > 12 THEN 5 END AS doc_id", "text")  # null and repeated ids
    assert sorted(r["n_tokens"] for r in rans.round_trip(odd, BYTE).collect()) == sorted(r["n_tokens"] for r in got.values())


def test_packing(spark):
    docs = documents(spark)
    library, rows = bpe.load_tokenizer(WORD), packing.pack(docs, WORD, shard_pieces=8).collect()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want = [(lo // 2048, lo, len(ids[lo : lo + 2048]), zlib.crc32(np.array(ids[lo : lo + 2048], "<u4").tobytes())) for lo in range(0, len(ids), 2048)]
        assert sorted((x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in rows if x["doc_id"] == r["doc_id"]) == want
    bins: dict = {}
    for x in rows:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.where("false"), WORD).count() == 0
    assert packing.pack(docs.union(docs), WORD).count() == 2 * len(rows)


def test_local_search_improves_and_loses_nothing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(600, 1300, 3000).tolist()
    first = packing.best_fit(lengths, 2048)
    bins = packing.local_search(lengths, first, 2048)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    squares = lambda found: sum(sum(lengths[i] for i in b) ** 2 for b in found)
    assert len(bins) <= len(first) and squares(bins) > squares(first)
    moved = packing.local_search([1000, 900, 1000, 1048], [[0, 1], [2], [3]], 2048)
    assert len(moved) == 2
    assert packing.pack_lengths([], 2048) == []


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a> site name</header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it work for all of you, dear readers.</div><!-- <p>no</p> -->
<article><h1>A  title &amp; more</h1><p>First <b>bold</b> words&nbsp;here,<br>a line.<p>Second &lt;tag&gt; &#233; &copy without end</p>
<table><tr><td>cell one</td><td>two</td></tr></table><p>Short.</p><form>Name <input> please</form></article>
<aside>Related stories that you might also like to read, chosen by our editors.</aside>
<section id="comments"><p>Great article, thank you very much for writing all of this down for us!</p></section>
<footer>&copy; 2024 somebody and all of the others who helped to make this site.</footer>"""


def test_html():
    tree = html_text.train_tree()
    assert html_text.main_text(PAGE, tree) == "A title & more\nFirst bold words here, a line.\nSecond <tag> é © without end\ncell one\ntwo\nShort."
    named = '<div class="page no-sidebar with-comments"><article class="post"><div class="article-header"><h1>Title</h1></div><p>Body text.</p><div class="socialShare">Share me</div></article><article class="comment">Mine!</article></div>'
    assert html_text.main_text(named, tree) == "Title\nBody text."
    plain = "<body><div><a href=x>Menu</a></div><p>" + prose(60, 1) + "</p><div>" + prose(40, 2) + "</div><p><a href=y>next page</a></p>"
    assert html_text.main_text(plain, tree) == prose(60, 1) + "\n" + prose(40, 2)
    for odd in (None, "", "<", "<p", "a < b", "<!--", "<script>", "</p></div>", "<p class='x", "\x00<p>\x00", "<" * 5000, "<p " + "a='" * 3000):
        html_text.main_text(odd, tree)
    long = "<article>" + "".join(f"<p>{prose(20, i)}</p>" for i in range(3000)) + "</article>"
    assert html_text.main_text(long, tree).count("\n") == 2999


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (3, "v", "", "")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and {(r["page_id"], r["n_chars"]) for r in got} == {(1, len(html_text.main_text(PAGE, html_text.train_tree()))), (None, 0), (3, 0)}
    assert html_text.extract(pages.where("false")).count() == 0


def test_html_against_a_simple_reading(spark):
    tree = html_text.train_tree()
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", re.sub(r"<!--.*?-->", "", r["html"], flags=re.S), re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert html_text.main_text(r["html"], tree) == "\n".join(x for x in want if x)


def test_trees_learn_and_score():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == (y[1500:] == 1)).mean() > 0.95
    slow = [model.base + sum(_walk(model, t, row) for t in range(len(model.feature))) for row in x[:50]]
    assert np.allclose(model.score(x[:50]), 1 / (1 + np.exp(-np.array(slow))))
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality.fit(x[:9], np.ones(9)).score(x) > 0.99).all()


def _walk(model, t, row):
    i = 0
    for _ in range(model.depth):
        i = 2 * i + 1 + int(row[model.feature[t, i]] > model.threshold[t, i])
    return model.value[t, i]


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.score_documents(docs, labels).collect()}
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert len(held) > 50 and np.mean([r["predicted"] == q for r, q in held]) > 0.95
    small = quality.score_documents(documents(spark), labels).collect()
    blank = [r["score"] for r in small if r["doc_id"] in (10, 13, 16)]
    assert len(small) == len(TEXTS) and len(set(blank)) == 1 and all(0 <= r["score"] <= 1 for r in small)
    assert {r["score"] for r in quality.score_documents(documents(spark), labels.where("false")).collect()} == {0.5}
    assert quality.score_documents(documents(spark).where("false"), labels).count() == 0


def test_base_spans(spark):
    import random

    r = random.Random(4)
    texts = [*TEXTS, "a@b.c_d@e.f x@y@z.w a@b", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004 0.1.7.7a", "4111-1111-1111-1111-2 411111111111111", "+44.20.7946.0958 +1 2 +123456789012345678 +1 ((((5555555", "9" * 500 + " " + "a" * 3000 + "@" + "b." * 600 + "c", " ".join(map(str, range(900)))]
    texts += ["".join(r.choice("ab1234567890.@+-() é😀") for _ in range(300)) for _ in range(80)]
    docs = documents(spark, texts)
    for row in pii.spans(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        mine = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in row["base"]]
        assert mine == base_spans(row["text"]), row["text"][:80]
        every = [tuple(s) for s in row["spans"]]
        assert every == sorted(every) and {tuple(s) for s in row["base"]} <= set(every)
    assert pii.spans(docs.where("false")).count() == 0 and pii.spans(docs.union(docs)).count() == 2 * len(texts)


def test_context_discovers_what_patterns_miss(spark):
    texts = [f"please write to user{i:03d}@mail.example.com today" for i in range(40)] + ["please write to user777@mail_example today", "nothing to see at 12 noon"]
    texts += [f"number {i}" for i in range(30)]
    got = {r["doc_id"]: r for r in pii.spans(documents(spark, texts)).collect()}
    assert not got[10 + 3 * 41]["spans"] and not got[10 + 3 * 50]["spans"]
    more = [f"card no {n} ok" for n in ("4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220", "4539578763621486", "4716461583322103", "4024007136512380")] + ["card no 4111111111111112 ok"]
    found = [r for r in pii.spans(documents(spark, more)).collect() if not r["base"]]
    assert [(s["kind"], s["start"], s["end"]) for r in found for s in r["spans"]] == [(pii.KINDS.index("card"), 8, 24)]


def test_context_discovers_unseen_shapes_and_runs(spark):
    texts = [f"please write to user{i:03d}@mail.example.com today" for i in range(40)] + ["please write to user777@mail_example today"]
    texts += [f"now call +1 (269) 555-{3296 + i} tonight" for i in range(20)] + ["now call 269 555 0199 tonight", "we met 12 guests tonight", "in 1999 77 people"]
    docs = documents(spark, texts)
    more = {r["text"]: [(pii.KINDS[s["kind"]], r["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.spans(docs).join(docs.select("doc_id", "text"), "doc_id").collect() if not r["base"]}
    assert more == {
        "please write to user777@mail_example today": [("email", "user777@mail_example")],
        "now call 269 555 0199 tonight": [("phone", "269 555 0199")],
        "we met 12 guests tonight": [],
        "in 1999 77 people": [],
    }


def test_redaction(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns and len(got) == len(TEXTS)
    assert got[10 + 3 * 17]["text"].startswith("mail [EMAIL], [IP] or 10.0.0.256; [PHONE]; [CARD] and ")
    assert all(got[r["doc_id"]]["text"] == r["text"] for r in docs.collect() if r["doc_id"] != 10 + 3 * 17)


def _features_used(tree) -> set:
    return set() if not isinstance(tree, tuple) else {html_text.FEATURES[tree[0]]} | _features_used(tree[2]) | _features_used(tree[3])


def test_the_tree_reads_words_and_links_of_both_neighbours():
    tree = html_text.train_tree()
    used = _features_used(tree)
    assert {"words", "links", "main", "outside", "aside", "named"} <= used and {"prev_words", "prev_links"} & used and {"next_words", "next_links"} & used
    rows = np.array([line.split() for line in html_text.LABELLED.strip().splitlines()], float)
    assert (html_text.classify(tree, rows[:, :-1]) == (rows[:, -1] == 1)).all() and set(rows[:, -1]) == {0, 1}


def test_names_are_a_weak_hint():
    tree, long, other = html_text.train_tree(), prose(60, 1), prose(50, 2)
    friendly = f"<body><div class='post share-friendly'><h1>The title here</h1><p>{long}</p><p>{other}</p></div></body>"
    assert html_text.main_text(friendly, tree) == f"The title here\n{long}\n{other}"
    assert html_text.main_text(f"<div class='share-friendly'><p>{long}</p><p>{other}</p></div>", tree) == f"{long}\n{other}"
    after = f"<body><main><h1>T</h1><p>{long}</p></main><div class='foo'><p>{other}</p><p>{prose(40, 3)}</p></div></body>"
    assert html_text.main_text(after, tree) == f"T\n{long}"
    for name in ("comments", "comment-body", "comments-area", "cookie-notice", "related-posts", "newsletter-signup-box", "ad", "sidebar-left", "post-footer", "SocialShare"):
        assert html_text.main_text(f"<article><p>{long}</p><div class='{name}'><p>{other}</p></div><p>End.</p></article>", tree) == f"{long}\nEnd.", name
        assert html_text.main_text(f"<div><p>{long}</p><p>{prose(45, 7)}</p></div><div id={name}><p>{other}</p></div>", tree) == f"{long}\n{prose(45, 7)}", name
    for name in ("entry-content", "no-sidebar", "without-comments", "article-header", "lead", "main-text"):
        assert html_text.main_text(f"<article><div class='{name}'><p>{long}</p><p>Ok.</p></div></article>", tree) == f"{long}\nOk.", name
    nested = f"<div class='layout with-sidebar sidebar-left'><article><p>{long}</p><section id='comments'><article><p>{other}</p></article></section></article></div>"
    assert html_text.main_text(nested, tree) == long


def test_html_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t", 7)], "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.first()["n_chars"] == len(got.first()["text"]) > 7
