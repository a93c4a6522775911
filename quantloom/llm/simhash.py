"""SimHash fingerprints and their near-duplicates through a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import materialize, text_or_empty

SEGMENT_BITS, GROUPS = 2, 4


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """64-bit hashes of all runs of ``shingle`` words, repeats included; a shorter text is hashed whole."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[shingle - 1 :], strict=False) if len(words) >= shingle else [(0, at)]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((digest(view[a:b], 42) for a, b in spans), np.uint64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles, repeats included."""
    return majority_bits(shingle_hashes(text, shingle))


def majority_bits(hashes: np.ndarray) -> int:
    """Signed long whose bits are set where over half of the 64-bit hashes have them set."""
    total, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; a null text counts as empty."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint(t, shingle) for t in part], dtype="int64")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), of(text_or_empty()).alias("fp"))


def segment_counts(fp: Column) -> Column:
    """Bit counts of all 2-bit segments, each in its own two bits of a long (00, 01 or 10): the embedding."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    low = fp.bitwiseAND(odd)
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))


def lower_bound(a: Column, b: Column) -> Column:
    """Manhattan distance of two embeddings, which no Hamming distance of the fingerprints falls below. Counts
    0, 1, 2 are written in unary as 00, 01, 11, and the differing bits are counted."""
    unary = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x5555555555555555)))
    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def grid_cells(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, counts, cell) with one row for each grid cell that can hold a partner. The embedding's 32
    coordinates form groups; a Manhattan distance of at most ``radius`` leaves all but ``radius`` groups
    equal, so partners share the cell given by some such choice of groups and their coordinates."""
    width = 64 // GROUPS
    mask = (1 << width) - 1
    cells = []
    for i, kept in enumerate(combinations(range(GROUPS), GROUPS - radius)):
        bits = sum(mask << (width * g) for g in kept)
        bits -= 1 << 64 if bits >> 63 else 0
        cells.append(F.struct(F.lit(i).alias("c"), F.col("counts").bitwiseAND(F.lit(bits)).alias("at")))
    return distinct.withColumn("counts", segment_counts(F.col("fp"))).select("fp", "counts", F.explode(F.array(*cells)).alias("cell")).select("fp", "counts", "cell.c", "cell.at")


def fingerprint_links(distinct: DataFrame, radius: int = 2, crowd: int = 48) -> DataFrame:
    """Links (u, v) that join all fingerprints within ``radius`` bits of each other, for ``radius`` at most 2.

    ``distinct`` has each fingerprint once, so copies cost nothing. Cells with up to ``crowd`` fingerprints
    are joined with themselves, filtered by the Manhattan lower bound and verified by Hamming distance. A
    crowded cell would make pairs by the square; there each fingerprint is joined instead to the points one
    bit away and itself: two fingerprints are within two bits exactly if they share such a point. Its rows
    grow with the cell, and the links (u: fingerprint, v: least fingerprint at the point) connect just those
    that a chain of links connects.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    cells = materialize(grid_cells(distinct, radius), "cells")
    sizes = materialize(cells.groupBy("c", "at").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cell-sizes")
    small = cells.join(sizes.where(F.col("n") <= crowd).select("c", "at"), ["c", "at"])
    small = materialize(small, "cell-members")
    a, b = small.alias("a"), small.alias("b")
    same = (F.col("a.c") == F.col("b.c")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.fp") < F.col("b.fp"))
    near = (lower_bound(F.col("a.counts"), F.col("b.counts")) <= radius) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius)
    pairs = a.join(b, same & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    crowded = cells.join(sizes.where(F.col("n") > crowd).select("c", "at"), ["c", "at"]).select("fp").distinct()
    if radius == 1:
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseAND(F.lit(_mask_without(i))) for i in range(64)])
        tags = F.transform(flips, lambda x, i: F.struct(x.alias("point"), i.alias("bit")))
    else:
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_bit(i))) for i in range(64)])
        tags = F.transform(flips, lambda x: F.struct(x.alias("point"), F.lit(0).alias("bit")))
    points = crowded.select("fp", F.explode(tags).alias("p")).select("fp", "p.point", "p.bit")
    least = materialize(points.groupBy("point", "bit").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v < top").select("point", "bit", "v"), "points")
    stars = points.join(least, ["point", "bit"]).where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()
    return pairs.distinct().unionByName(stars)


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64 if i == 63 else 0)


def _mask_without(i: int) -> int:
    return ~_bit(i)


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text): documents whose fingerprints are
    linked by a chain of steps of at most ``radius`` bits share a component, named by its least doc_id.

    Null and empty texts have the fingerprint 0 and are linked like any other; texts shorter than a shingle
    are hashed whole. Rows with equal doc_id are each judged; a null doc_id is never a component's name
    unless all its documents are null. An empty table yields no rows.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    group = components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(group, distinct["fp"] == group["node"], "left")
    named = materialize(named.select("fp", "least", F.coalesce("component", "fp").alias("component")), "classes")
    names = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "class-names")
    classes = materialize(named.join(names, "component").select("fp", "component_id"), "class-ids")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
