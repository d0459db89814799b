"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
back as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.pii import redact
from tidemark.llm.quality import scorer, train
from tidemark.llm.storage import materialize, release, scratch_mark

#: SQL cannot express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None
#: Near copies in the corpus are texts of similarity 0.8 or more (op10's own contract is 0.85). With 15 groups a pair
#: of exactly 0.8 shares a table with probability 0.99996.
NEAR_PERCENT, NEAR_GROUPS = 80, 15


def _one_of_each(docs: DataFrame, operator: Callable[..., DataFrame], **options) -> DataFrame:
    """The rows of ``docs`` that ``operator`` keeps: exactly one of each of its groups.

    A doc_id names one row. Where some doc_id occurs more than once (or more than one row has none), rows that repeat doc_id and
    text count once, and the others get numbers of their own in the order of doc_id, then a hash of the text.
    """
    key, rows = "doc_id", docs
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        key = "_row_number"
        order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
        ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_rows = docs.dropDuplicates(["doc_id", "text"]).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        rows = materialize(sorted_rows.withColumn(key, F.monotonically_increasing_id()), "numbered")
    kept = operator(rows, id_col=key, **options).where("kept").select(F.col("doc_id").alias("_kept_id"))
    return rows.join(kept, rows[key].eqNullSafe(kept["_kept_id"]), "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, trained on this corpus's labels, rejects (a score under 0.5).

    Rows are judged one by one, by their text alone: equal texts share their fate, null and empty texts are scored as blank
    ones, null doc_ids and repeated rows stay as many as they are. Without labels every document stays. Columns are those of
    ``docs``, whatever their names; an empty table stays empty.
    """
    score = scorer(train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(score(F.col("text")) >= 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that are equal but for white space.

    The one with the most code points stays, then the smallest doc_id. Null and empty texts are one group. A null doc_id loses
    ties; of rows that repeat doc_id and text one counts. Columns are those of ``docs``; an empty table stays empty.
    """
    return _one_of_each(docs, exact_dedup)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, of smallest doc_id, of each component of near-duplicates (similarity from 0.8 on, five words a shingle).

    Texts without words are like nothing and stay. A null doc_id loses ties; of rows that repeat doc_id and text one counts.
    Columns are those of ``docs``; an empty table stays empty.
    """
    return _one_of_each(docs, near_duplicates, percent=NEAR_PERCENT, groups=NEAR_GROUPS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets, and count characters anew if there is a column n_chars.

    All rows stay, repeated ones and those without a doc_id too; a null text stays null, with its count as it was. Overlapping
    spans are replaced as one. Columns are those of ``docs``; an empty table stays empty.
    """
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row gives its pieces, repeated ones and those without a doc_id too; a null or empty text is one piece with the end
    id alone. An empty table gives no pieces.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("private", private), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of ``sf_dir``; what a stage wrote on its way goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = scratch_mark()
        result = stage(spark, docs, sf_dir)
        done = scratch_mark()
        docs = materialize(result, name)
        release(spark, since=before, until=done)
    return STAGES[-1][1](spark, docs, sf_dir)
