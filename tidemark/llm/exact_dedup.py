"""Exact deduplication with a heavy-hitter split.

1. One scan turns each text into (doc_id, code points, digest); only that table is used afterwards.
2. A Misra-Gries frequent-items sketch (``approx_top_k``) names at most ``heavy`` candidate digests.
   It misses no digest that holds more than about 1/``tracked`` of the rows and is among the ``heavy`` most frequent.
3. The candidates are verified by an exact, map-side combined aggregate. The winners (at most
   ``heavy`` rows of about 100 bytes: a fixed bound) are broadcast, so rows of hot digests get their
   group's keeper without being shuffled.
4. All other digests are shuffled in the ordinary way: one aggregate, combined map-side, gives each group's
   keeper and size. A digest that occurs once is settled by it; only rows of repeated ones are joined to
   their group, a table of its own, so that adaptive execution can split a group however large it is.

All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

BLANKS = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", heavy: int = 256, tracked: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting blanks; the row with the most code points, then the
    smallest doc_id stays. A null text counts as empty (all empty texts are one group). A null doc_id
    loses ties against any other. Rows that repeat the winner's doc_id are the same document: all of
    them are ``kept``. A text is hashed whole, however long. Extra columns are ignored. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digests = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.char_length(text).cast("long").alias("n"),
            F.unhex(F.sha2(F.regexp_replace(text, BLANKS, ""), 256)).alias("digest"),
        ),
        "digests",
    )
    rank = F.struct((-F.col("n")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"))
    top = digests.agg(F.expr(f"approx_top_k(hex(digest), {heavy}, {tracked})").alias("top"))
    candidates = top.select(F.explode("top").alias("t")).select(F.unhex("t.item").alias("digest"))
    winners = (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(rank)["c"].alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    winners = materialize(winners.coalesce(1), "winners")
    hot = digests.join(F.broadcast(winners), "digest")
    cold = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = materialize(cold.groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    alone = groups.where("group_size = 1").select("digest", F.col("best.c").alias("doc_id"), F.col("best.c").alias("keep_id"), "group_size")
    shared = cold.join(groups.where("group_size > 1").select("digest", F.col("best.c").alias("keep_id"), "group_size"), "digest")
    columns = ["digest", "doc_id", "keep_id", "group_size"]
    return hot.select(*columns).unionByName(shared.select(*columns)).unionByName(alone).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
