"""Packing documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, small_batches, text_or_empty
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def least_slack(left: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, count) of the multiset of remaining lengths whose sum comes closest to ``capacity`` without
    passing it. Bit s of ``reach`` says that s is a sum of the lengths seen so far; each copy of a length is
    one step of the dynamic programme, and the steps are walked back for the counts. Lengths go from the
    longest down and the search ends as soon as the capacity itself is reached, which nothing can better.
    """
    reach, full, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted(left, reverse=True):
        for _ in range(min(left[length], capacity // length)):
            wider = (reach | reach << length) & full
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, before in reversed(steps):
        if not before >> at & 1:
            used[length] += 1
            at -= length
    return list(used.items())


def fill_windows(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (1 to ``capacity``). A pattern is used as often as its counts allow."""
    places: dict[int, list[int]] = {}
    for i, length in enumerate(lengths.tolist()):
        places.setdefault(length, []).append(i)
    left = {k: len(v) for k, v in places.items()}
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = 0
    while left:
        pattern = least_slack(left, capacity)
        for _ in range(min(left[k] // c for k, c in pattern)):
            at = 0
            for length, count in pattern:
                for _ in range(count):
                    i = places[length].pop()
                    window[i], offset[i] = n, at
                    at += length
                left[length] -= count
            n += 1
        left = {k: v for k, v in left.items() if v}
    return window, offset


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids: as many whole windows as a document fills, then what is left over."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(6)]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode(part.column(1).to_pylist(), end_id), strict=True):
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        for column, value in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), n, row), strict=True):
                            column.append(value)
                        row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, group_size: int = 8192) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Each document is cut into whole windows and one rest; groups of about ``group_size`` pieces, dealt by a
    hash of the piece so that no key is hot, are packed on their own, so at most a window or so in a group
    stays slack. Only the pieces' numbers are shuffled, never ids. Sequence ids are unique, not gapless.

    A null text counts as empty and yields one piece with the end id alone. Rows with equal or null doc_id
    are packed each for itself. An empty table yields no rows.
    """
    small_batches(docs.sparkSession)
    pieces = materialize(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_size))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        window, offset = fill_windows(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(key[0] << 32) + window, offset=offset)[[x.split()[0] for x in PACKED.split(", ")]]

    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(pack, PACKED)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """The packed ids themselves: (sequence_id, ids array<long>), for documents with unique ids."""

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = encoder(tokenizer).encode(rows["text"].tolist(), end_id)
            cut = [np.frombuffer(x, "<u4")[s : s + n].astype("int64") for x, s, n in zip(ids, rows["start"], rows["length"], strict=True)]
            yield pd.DataFrame({"sequence_id": rows["sequence_id"], "offset": rows["offset"], "ids": cut})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    joined = packed.join(texts, "doc_id").select("sequence_id", "offset", "start", "length", "text")
    cut = joined.mapInPandas(slices, "sequence_id long, offset long, ids array<long>")
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
