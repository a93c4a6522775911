"""Corpus cleaning from raw documents to packed sequences: four filters and the packing, each a Spark job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.decontaminate import leaked_documents
from quantloom.llm.document_dedup import SENT_SETS, similar_documents
from quantloom.llm.line_dedup import dedup_lines
from quantloom.llm.packing import pack_documents
from quantloom.llm.queries import table
from quantloom.llm.storage import discard, fresh_path, free_name, materialize, text_or_empty
from quantloom.llm.tokens import default_tokenizer
from quantloom.llm.toxicity import score_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; all columns stay as they are.

    Each row is judged by its own text, so repeated rows and equal ids make no difference; a null text is scored
    as an empty one. A column of the documents may have the score's name. No documents give none.
    """
    score = free_name("toxicity", docs.columns)
    return score_documents(docs, table(spark, sf_dir, "labels"), score).where(F.col(score) < 0.5).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches, ``n_chars`` counted anew where lines went.

    Documents with no words left go; those that had none before stay, as do null texts and rows without a
    doc_id. Of repeated rows the second loses all lines with words, and so goes. No documents give none.
    """
    gone = free_name("removed_lines", docs.columns)
    thin = dedup_lines(docs, column=gone).where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.size(gone) == 0))
    return thin.withColumn("n_chars", F.when(F.size(gone) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of five-word shingles, by chains), the document with the least id.

    Pairs come from SimHash fingerprints of those shingles and are checked exactly; pairs as alike whose fingerprints are
    further apart are found by an exact join, so that no link is lost.
    Texts without words, null ones too, form one group. Of rows with equal doc_id and text one stays; rows with
    equal doc_id and other texts are judged apart. Rows without a doc_id go where a document with an id is alike.
    No documents give none.
    """
    found = similar_documents(docs)
    others = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("gone_hash")).distinct()
    others = materialize(others, "others")
    # Sent to every task up to a bound: a shuffled join would move all texts, whatever the number of those that go.
    others = F.broadcast(others) if others.count() <= SENT_SETS else others
    left = docs.join(others, docs["doc_id"].eqNullSafe(others["gone"]) & (F.xxhash64(text_or_empty()) == others["gone_hash"]), "left_anti")
    repeated = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    if repeated.isEmpty():
        return left
    same = docs["doc_id"].eqNullSafe(repeated["again"])
    return left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none, and rows without a doc_id stay. Rows with equal doc_id go together if one
    of them holds a passage. No documents give none, and an empty benchmark leaves all.
    """
    leaks = leaked_documents(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("gone")).distinct()
    leaks = materialize(leaks, "leaks")
    return docs.join(leaks, docs["doc_id"] == leaks["gone"], "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids.

    A null or empty text is its end id alone. Repeated rows are packed each. No documents give no pieces.
    """
    return pack_documents(docs, default_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again by the next. What a stage
    left is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(before)
        docs = before = spark.read.parquet(path)
    return docs
