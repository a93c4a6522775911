"""Token-id files: concatenated ids with Elias-Fano coded document boundaries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import fresh_path, materialize, text_or_empty
from .tokens import encoder

MAGIC = b"QLTK0002"
SAMPLE = 256
#: Documents of a file that are read at a time.
READ = 1024


def _sample_type(high_bytes: int) -> str:
    return "<u4" if high_bytes < 1 << 29 else "<u8"


class EliasFano:
    """A non-decreasing sequence of n integers in 0..universe: the low bits packed, the high bits in unary, and the
    place of every 256th high bit, so that an entry is found without a table of them.

    About 2 + log2(universe / n) bits an entry, and an eighth for the samples. ``select`` finds one entry,
    ``select_range`` neighbours; both look at the high bits between two samples only.
    """

    HEAD = struct.Struct("<QQQQQQ")

    def __init__(self, n: int, universe: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.width, self.low, self.high, self.samples = n, universe, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n, universe = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1) if width else np.zeros((n, 0))
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        marks = np.zeros(n + (universe >> width) + 1, np.uint8)
        places = ((values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        marks[places] = 1
        return cls(n, universe, width, low, np.packbits(marks, bitorder="little"), places[::SAMPLE].astype(_sample_type(-(-len(marks) // 8))))

    def _lows(self, first: int, n: int) -> np.ndarray:
        if not self.width:
            return np.zeros(n, np.uint64)
        at = first * self.width
        bits = np.unpackbits(self.low[at // 8 : -(-(at + n * self.width) // 8)], bitorder="little")[at % 8 :][: n * self.width]
        return (bits.reshape(n, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select_range(self, first: int, n: int) -> np.ndarray:
        """Entries first to first + n - 1."""
        if not (0 <= first and 0 <= n and first + n <= self.n):
            raise IndexError((first, n))
        if not n:
            return np.zeros(0, np.uint64)
        begin, end = first // SAMPLE, (first + n - 1) // SAMPLE + 1
        start = int(self.samples[begin])
        stop = int(self.samples[end]) if end < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :]
        skip = first - begin * SAMPLE
        ones = np.flatnonzero(bits)[skip : skip + n] + start
        return ((ones - np.arange(first, first + n)).astype(np.uint64) << np.uint64(self.width)) | self._lows(first, n)

    def select(self, i: int) -> int:
        """Entry i."""
        return int(self.select_range(i, 1)[0])

    def to_bytes(self) -> bytes:
        head = self.HEAD.pack(self.n, self.universe, self.width, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple["EliasFano", int]:
        n, universe, width, a, b, c = cls.HEAD.unpack_from(data)
        at, kind = cls.HEAD.size, _sample_type(b)
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, universe, width, low, high, np.frombuffer(data, kind, c, at + a + b)), at + a + b + c * np.dtype(kind).itemsize


def write_shard(docs: list[int | None], ids: list[bytes], wide: bool) -> bytes:
    """One file: a head, the ends of the documents, their ids (nulls first, the rest ascending), the token ids."""
    nulls = sum(d is None for d in docs)
    known = np.array([d for d in docs if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = EliasFano.encode(np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)).to_bytes()
    names = EliasFano.encode(known.astype(np.uint64) - np.uint64(base % 2**64)).to_bytes()
    tokens = b"".join(ids) if wide else np.frombuffer(b"".join(ids), "<u4").astype("<u2").tobytes()
    return MAGIC + struct.pack("<BQqQ", 4 if wide else 2, nulls, base, len(tokens)) + ends + names + tokens


class Shard:
    """Reads what ``write_shard`` wrote: ``doc_ids``, ``starts``, ``start(i)``, ``tokens(i)``."""

    HEAD = struct.Struct("<BQqQ")

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        view = memoryview(data)
        self.size, self.nulls, base, n_bytes = self.HEAD.unpack_from(view, 8)
        at = 8 + self.HEAD.size
        self.ends, used = EliasFano.from_bytes(view[at:])
        self.names, more = EliasFano.from_bytes(view[at + used :])
        self.base = base
        self.ids = np.frombuffer(view[at + used + more :][:n_bytes], f"<u{self.size}")

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self, first: int, n: int) -> list[int | None]:
        """Ids of the documents first to first + n - 1."""
        nulls = max(0, min(n, self.nulls - first))
        known = self.names.select_range(first + nulls - self.nulls, n - nulls)
        return [None] * nulls + (known.astype(np.int64) + self.base).tolist()

    def starts(self, first: int, n: int) -> np.ndarray:
        """First places of the documents first to first + n - 1, and the end of the last."""
        ends = self.ends.select_range(max(0, first - 1), n + min(first, 1)).astype(np.int64)
        return ends if first else np.concatenate([np.zeros(1, np.int64), ends])

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.start(i) : self.ends.select(i)]


def _save(path: str, data: bytes) -> None:
    files, name = fs.FileSystem.from_uri(path)
    with files.open_output_stream(name) as out:
        out.write(data)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, shard_tokens: int = 1 << 22) -> DataFrame:
    """Write the ids of all rows (doc_id, text) to files in ``folder``, a location that all executors reach, in
    ascending doc_id order, and return the manifest (part, seq, file, n_docs, n_tokens).

    Rows are dealt by ranges of doc_id, so a file holds neighbours and files follow each other in order; a
    task closes a file at ``shard_tokens`` ids, which bounds its memory. A file's name holds the attempt, and
    only files of the manifest count, so a task that is run again leaves nothing wrong behind. Ids take two
    bytes where the vocabulary allows it. A null text counts as empty; rows with a null doc_id come first;
    rows with equal doc_id stay side by side in any order; an empty table leaves an empty manifest.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, tool = TaskContext.get(), encoder(tokenizer)
        wide = tool.tokenizer.get_vocab_size() > 65536
        state: dict = {"docs": [], "ids": [], "n": 0, "seq": 0}

        def close() -> pa.RecordBatch:
            name = f"tokens-{task.partitionId():06d}-{state['seq']:06d}-{task.taskAttemptId()}.ef"
            _save(f"{folder}/{name}", write_shard(state["docs"], state["ids"], wide))
            row = [[task.partitionId()], [state["seq"]], [name], [len(state["docs"])], [state["n"]]]
            state.update(docs=[], ids=[], n=0, seq=state["seq"] + 1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "seq", "file", "n_docs", "n_tokens"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), tool.encode(part.column(1).to_pylist(), end_id), strict=True):
                    state["docs"].append(doc)
                    state["ids"].append(ids)
                    state["n"] += len(ids) // 4
                    if state["n"] >= shard_tokens:
                        yield close()
        if state["docs"]:
            yield close()

    files, name = fs.FileSystem.from_uri(folder)
    files.create_dir(name, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return materialize(ordered.mapInArrow(write, "part long, seq long, file string, n_docs long, n_tokens long"), "manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32) of each document. ``start`` counts the ids of
    all documents before it, over all files; the manifest has one row a file, so its running sum is small."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py())
                for first in range(0, len(shard), READ):
                    n = min(READ, len(shard) - first)
                    at = shard.starts(first, n)
                    ids = shard.ids[at[0] : at[-1]].astype("<u4")
                    cuts = (at - at[0]).tolist()
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    columns = [pa.array(x, pa.int64()) for x in (shard.doc_ids(first, n), at[:-1], np.diff(at), crc)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([path.rpartition("/")[2]] * n)], names=["doc_id", "at", "n_tokens", "ids_crc32", "file"])

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("before"))
    found = spark.read.format("binaryFile").load(folder).select("path", "content")
    rows = found.mapInArrow(read, "doc_id long, at long, n_tokens long, ids_crc32 long, file string")
    return rows.join(starts, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents to token-id files in the shared folder and read them back; see the two functions above."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-files")
    return read_token_files(spark, folder, write_token_files(docs, tokenizer, folder, end_id))
