"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph is hashed to a wide vector of integers; a text's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo powers of two. So the order of paragraphs does not matter, and inserting or
deleting one adds or subtracts its vector. A vector has two parts:

* WIDE lanes modulo 2**31, cut from the paragraph's SHA-512, each from 32 bits of its own: 496 bits about a
  paragraph, so equal sums mean equal multisets.
* NEAR lanes: each word pair of the paragraph (of a short one: each trigram) adds 1 or -1, by its hash, to the lane
  that its hash names. They are additive too, and squared distances between the lanes of two texts are unbiased
  estimates of those between their multisets of word pairs, from which the likeness of two fingerprints follows.

Everything is DataFrame expressions; texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, partitions

WIDE = 16
BUCKETS, WAYS = 32, 4  # near lanes: rows of a partial sum, and lanes a row
NO_ID = -(2**63)
_MASK = (1 << 31) - 1
TOKEN = r"\n|\S{1,16}"
SHORT = 24


def split_elements(frame: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, wide, x): the sums of the wide lanes, and a row for each word pair (in paragraphs under SHORT code points:
    each trigram) of a paragraph, or a row with a null x if there is none.

    Paragraphs are what line feeds part, empty ones included; an empty text has no paragraph. Intermediate
    arrays are columns of their own, since lambdas look into them at every step.
    """
    part = lambda keep: F.array_join(F.filter("paragraphs", keep), "\n")
    short = F.transform(F.filter("paragraphs", lambda p: (F.char_length(p) < SHORT) & (p != "")), lambda p: F.concat(F.lit("  "), p))
    made = frame.select(*keys, F.when(F.col(text) != "", F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>")).alias("paragraphs"))
    made = made.select(
        *keys,
        F.transform("paragraphs", lambda p: F.sha2(p, 512)).alias("digests"),
        F.regexp_extract_all(part(lambda p: F.char_length(p) >= SHORT), F.lit(TOKEN), F.lit(0)).alias("tokens"),
        F.flatten(F.transform(short, lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))).alias("grams"),
    )
    pairs = F.transform("tokens", lambda w, i: F.when(w != "\n", F.xxhash64(w, F.coalesce(F.get("tokens", i + 1), F.lit("\n")))))
    grams = F.transform("grams", lambda g: F.xxhash64(g))
    # The lanes are summed here, once a text: beside an explode they would be summed for every row of it.
    made = made.select(*keys, F.array(*map(_lane_sum, range(WIDE))).alias("wide"), F.array_compact(F.concat(pairs, grams)).alias("x"))
    return made.select(*keys, "wide", F.explode_outer("x").alias("x"))


def _lane_sum(j: int) -> Column:
    """Lane j of all paragraphs: 32 bits of each digest, summed modulo 2**31."""

    def add(total: Column, digest: Column) -> Column:
        return (total + F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("long")).bitwiseAND(_MASK)

    return F.aggregate("digests", F.lit(0).cast("long"), add)


def collect(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Group elements into (keys, wide, pairs, near). Sums cannot overflow: a text has under 2**31 elements."""
    x = F.col("x")
    sign = 1 - F.shiftright(x, 7).bitwiseAND(1) * 2
    way = F.shiftright(x, 5).bitwiseAND(WAYS - 1)
    sums = [F.coalesce(F.sum(F.when(way == w, sign)), F.lit(0).cast("long")).alias(f"s{w}") for w in range(WAYS)]
    rows = frame.groupBy(*keys, "wide", x.bitwiseAND(BUCKETS - 1).alias("b")).agg(*sums, F.count("x").alias("pairs"))
    entry = F.when(F.col("b").isNotNull(), F.struct(F.col("b").alias("key"), F.array(*(f"s{w}" for w in range(WAYS))).alias("value")))
    found = rows.groupBy(*keys, "wide").agg(F.map_from_entries(F.collect_list(entry)).alias("lanes"), F.sum("pairs").alias("pairs"))
    zeros = F.array(*(F.lit(0).cast("long") for _ in range(WAYS)))
    near = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("lanes", b.cast("long")), zeros)))
    return found.select(*keys, "wide", "pairs", near.alias("near"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint (wide, pairs, near) of inserting (or with sign -1 deleting) the paragraphs of b into those of a."""
    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: (x + sign * y).bitwiseAND(_MASK))
    near = F.zip_with(a["near"], b["near"], lambda x, y: x + sign * y)
    return F.struct(wide.alias("wide"), (a["pairs"] + sign * b["pairs"]).alias("pairs"), near.alias("near"))


def as_text(wide: Column, pairs: Column, near: Column) -> Column:
    """The wide lanes in hexadecimal, eight digits each; then the number of pairs; then the near lanes."""
    return F.concat(F.array_join(F.transform(wide, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), ""), F.lit("-"), pairs.cast("string"), F.lit("/"), F.array_join(F.transform(near, lambda v: v.cast("string")), "."))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 - |A-B|^2 / (|A|^2 + |B|^2), estimated from the near lanes; 1 for equal fingerprints."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)
    gap = total(F.zip_with(a["near"], b["near"], lambda x, y: x - y))
    size = total(a["near"]) + total(b["near"])
    same = (a["wide"] == b["wide"]) & (a["pairs"] == b["pairs"]) & (a["near"] == b["near"])
    return F.when(same, 1.0).when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - gap / F.nullif(size, F.lit(0.0)))))


def _ordered(docs: DataFrame) -> DataFrame:
    """(d, h, n, prev_d, prev_h, prev_n) of each distinct row in order of d, then h; before the first comes the last.

    Only ids and lengths move: range partitions (by both, so that rows without an id spread too), a window in
    each, and their edges (one row per partition).
    """
    spark = docs.sparkSession
    sizes = materialize(
        docs.select("d", "h", F.char_length("text").cast("long").alias("n")).repartitionByRange(partitions(spark), "d", "h").withColumn("part", F.spark_partition_id()), "sizes"
    ).groupBy("part", "d", "h").agg(F.max("n").alias("n"))
    row = F.struct("d", "h", "n")
    edges = sizes.groupBy("part").agg(F.max(row).alias("last"))
    everything = Window.orderBy("part")  # one row per range partition
    edges = edges.select("part", F.coalesce(F.lag("last").over(everything), F.max("last").over(Window.partitionBy())).alias("before"))
    within = Window.partitionBy("part").orderBy("d", "h")
    prev = F.coalesce(F.lag(row).over(within), F.col("before"))
    return sizes.join(F.broadcast(edges), "part").select("d", "h", "n", prev.alias("prev")).select("d", "h", "n", F.col("prev.d").alias("prev_d"), F.col("prev.h").alias("prev_h"), F.col("prev.n").alias("prev_n"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars/4) code points replaced by the first as many (or all) of
    the next document's. A null text counts as empty; empty texts have the zero fingerprint and likeness 1
    to each other, 0 to texts that have words. Empty paragraphs count, so "a", "a\\n" and "a\\n\\n" differ.
    Texts of the same paragraphs in another order have equal fingerprints. Null doc_ids come first. Rows that
    repeat a doc_id follow each other by a hash of their texts; rows that repeat doc_id and text count once in
    the order, and each gets its output row. A single row is its own next document. Texts may be as long as a
    row may be; extra columns are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = materialize(_ordered(source), "order")
    rows = source.join(order, ["d", "h"]).groupBy("d", "h", "n", "prev_d", "prev_h", "prev_n").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    heads = rows.select(F.col("prev_d").alias("d"), F.col("prev_h").alias("h"), F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("head"))
    kept = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    both = rows.join(heads, ["d", "h"]).withColumn("edited", F.concat(kept, F.col("head")))
    keys = ["d", "h", "n", "prev_d", "prev_h", "copies", "edited_sha256", "which"]
    versions = F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("text"), F.lit(None).cast("binary").alias("sha")),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"), F.unhex(F.sha2("edited", 256)).alias("sha")),
    )
    split = both.select("d", "h", "n", "prev_d", "prev_h", "copies", F.explode(versions).alias("v"))
    split = split.select("d", "h", "n", "prev_d", "prev_h", "copies", F.col("v.sha").alias("edited_sha256"), F.col("v.which").alias("which"), F.col("v.text").alias("text"))
    prints = materialize(collect(split_elements(split, keys), keys), "fingerprints")
    own = F.struct("wide", "pairs", "near")
    text = prints.where("which = 0").select("d", "h", "n", "prev_d", "prev_h", "copies", own.alias("own"))
    edited = prints.where("which = 1").select("d", "h", "edited_sha256", own.alias("edit"))
    following = text.select(F.col("prev_d").alias("d"), F.col("prev_h").alias("h"), F.col("own").alias("next"))
    joined = text.join(edited, ["d", "h"]).join(following, ["d", "h"])
    printed = lambda c: as_text(F.col(f"{c}.wide"), F.col(f"{c}.pairs"), F.col(f"{c}.near"))
    return joined.select(
        F.nullif("d", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").alias("n_chars"),
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        printed("own").alias("fingerprint"),
        printed("edit").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
