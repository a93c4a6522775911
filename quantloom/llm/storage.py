"""Helpers of the corpus operators: tables in the shared folder, free names, texts and hashes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import discard, fresh_path, materialize, shared_folder

__all__ = ["crc_bucket", "discard", "free_name", "fresh_path", "materialize", "shared_folder", "small_batches", "text_or_empty"]

#: Rows with whole texts that go to a Python worker at once.
BATCH = 1024


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as keep it apart from the names ``taken``."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Let no more than ``BATCH`` rows go to a Python worker at once from now on. Spark's own 10,000 are meant for numbers:
    with whole texts they are held several times over, on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
