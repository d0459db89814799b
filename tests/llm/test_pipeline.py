from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near_dedup, pii, quality
from tidemark.llm.storage import materialize

from .common import base_spans, documents, edited, exact_groups, near_components, prose, shingles

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        done = materialize(stage(spark, docs, SF), name)
        after = done.collect()
        ids = {r["doc_id"] for r in after}
        rows = [(r["doc_id"], r["text"]) for r in before]
        if name == "quality":
            x = [quality.statistics(t) for _, t in rows]
            assert ids == {k for (k, _), s in zip(rows, model.score(__import__("numpy").array(x))) if s >= 0.5}
        elif name == "exact":
            assert ids == {k for k, (keep, _) in exact_groups(rows).items() if k == keep}
        elif name == "near":
            assert ids == {k for k, (_, c) in near_components(rows, corpus_pipeline.NEAR_PERCENT).items() if k == c}
        elif name == "private":
            assert ids == {k for k, _ in rows}
            old = dict(rows)
            for r in after:
                text = old[r["doc_id"]]
                for _, a, b in base_spans(text):
                    assert text[a:b] not in r["text"]
                assert r["n_chars"] == len(r["text"]) and (base_spans(text) or pii.KINDS and r["text"] == text or "[" in r["text"])
        else:
            assert ids == {k for k, _ in rows} and done.columns[:3] == ["doc_id", "piece", "start"]
        if name != "sequences":
            assert done.columns == columns
        docs, before = done, after


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_empty_corpus(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_stage_links_from_eighty_percent(spark):
    texts = [t for s in range(25) for t in (prose(400, 500 + s), edited(prose(400, 500 + s), 50, s))]
    sets = [shingles(t) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.80 <= x < 0.85 for x in alike) > 15
    docs = documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {k for k, (_, c) in near_components(rows, 80).items() if k == c}
    assert want != {k for k, (_, c) in near_components(rows, near_dedup.PERCENT).items() if k == c}
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, docs, SF).collect()} == want


def odd(spark):
    """Repeated rows, doc_ids that name several texts, rows without doc_id, null and empty texts, clashing names."""
    base = documents(spark, [prose(60, 1), prose(60, 1), prose(60, 1) + " ", None, "", " ", prose(80, 2), edited(prose(80, 2), 79, 1), "call +1 (269) 555-3296 or a@b.cd", "one"])
    twice = base.unionByName(base)
    nameless = base.withColumn("doc_id", F.lit(None).cast("long"))
    same = base.withColumn("doc_id", F.lit(10).cast("long"))
    return twice.unionByName(nameless).unionByName(same).withColumn("_kept_id", F.lit(1)).withColumn("group_size", F.lit("x"))


def blank(text):
    return "".join((text or "").split())


def test_stages_keep_one_row_of_each_group(spark):
    docs = odd(spark)
    rows = docs.collect()
    for stage, same in ((corpus_pipeline.exact, blank), (corpus_pipeline.near, lambda t: " ".join((t or "").split()))):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        kept = got.collect()
        texts = [same(r["text"]) for r in kept]
        if stage is corpus_pipeline.exact:
            assert sorted(texts) == sorted({same(r["text"]) for r in rows})
            best = {}
            for r in rows:
                place = (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)
                best[blank(r["text"])] = min(best.get(blank(r["text"]), place), place)
            assert {blank(r["text"]): (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) for r in kept} == best
        else:
            worded = [t for t in texts if t]
            assert len(worded) == len(set(worded)) == 4  # the edited copy goes with its source
            assert all(r["doc_id"] == 10 for r in kept if r["text"] and r["text"].strip())
            blanks = {(r["doc_id"], r["text"]) for r in rows if not (r["text"] or "").strip()}
            assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept if not (r["text"] or "").strip()))) == sorted(map(str, blanks))


def test_row_by_row_stages_keep_every_odd_row(spark):
    docs = odd(spark)
    n = docs.count()
    clean = corpus_pipeline.private(spark, docs, SF)
    rows = clean.collect()
    assert clean.columns == docs.columns and len(rows) == n
    assert sum(r["text"] == "call [PHONE] or [EMAIL]" for r in rows) == 4 and sum(r["text"] is None for r in rows) == 4
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
    assert corpus_pipeline.sequences(spark, docs, SF).count() == n
    judged = corpus_pipeline.quality(spark, docs, SF)
    assert judged.columns == docs.columns
    fate = {}
    for r in judged.collect():
        fate[r["text"]] = fate.get(r["text"], 0) + 1
    before = [r["text"] for r in docs.collect()]
    assert all(k == before.count(t) for t, k in fate.items())
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run_releases_the_scratch_of_its_stages(spark):
    from tidemark.llm import storage

    before = storage.scratch_mark()
    packed = corpus_pipeline.run(spark, SF)
    names = [name.rsplit("/", 1)[-1].rsplit("-", 1)[0] for kind, name in storage._made[before:] if kind == "path"]
    assert [n for n in names if n in dict(corpus_pipeline.STAGES)] == ["quality", "exact", "near", "private"] and "signatures" not in names
    rows = packed.collect()
    at: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert rows and max(at.values()) <= 2048
    storage.release(spark, since=before)
    assert storage.scratch_mark() == before
