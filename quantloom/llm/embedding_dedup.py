"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .storage import materialize


@dataclass(frozen=True, slots=True)
class Hashing:
    """``tables`` tables of ``width``-quantised Gaussian projections, ``projections`` in each.

    With a cosine of 0.95 two unit vectors lie 0.316 apart. A width of 6 times that keeps them together in one
    projection with probability 0.867, so a table of p projections keeps them with 0.867^p; closer pairs do
    better. Unrelated vectors stay together in one projection with probability 0.464.
    """

    tables: int = 28
    projections: int = 12
    width: float = 1.9
    seed: int = 20
    dense: int = 2048

    @classmethod
    def for_rows(cls, n: int, missed: float = 0.004) -> "Hashing":
        """As many projections as leave a vector about four unrelated ones in its bucket, however many rows
        there are, and as many tables as miss a pair at 0.95 with a probability of ``missed`` at most."""
        p = max(4, round(log(max(n, 4) / 4) / log(1 / 0.464)))
        return cls(tables=ceil(log(missed) / log(1 - 0.867**p)), projections=p)

    def signatures(self, unit: np.ndarray) -> np.ndarray:
        a, b = _directions(self, unit.shape[1])
        cells = np.floor((unit @ a + b) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.projections)
        mixed = np.zeros(cells.shape[:2], np.uint64)
        for j in range(self.projections):
            mixed = (mixed ^ cells[:, :, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return mixed.view(np.int64)

    def met_before(self, unit: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Whether rows i and j share a bucket of a table before ``table``."""
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = self.signatures(unit[used])
        x, y = at[: len(i)], at[len(i) :]
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 4096):
            part = slice(k, k + 4096)
            out[part] = ((keys[x[part]] == keys[y[part]]) & (np.arange(self.tables) < table[part, None])).any(axis=1)
        return out


@lru_cache(maxsize=8)
def _directions(h: Hashing, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(h.seed)
    n = h.tables * h.projections
    return rng.standard_normal((dim, n)), rng.uniform(0, h.width, n)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _least_labels(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the least id that links (i, j) reach."""
    label = ids.copy()
    while True:
        now = label.copy()
        np.minimum.at(now, i, label[j])
        np.minimum.at(now, j, label[i])
        if (now == label).all():
            return label
        label = now


#: Buckets of up to this many vectors are compared many at a time; larger ones one by one.
SMALL = 64


def _compare_small(rows: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray, h: Hashing, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of many small buckets: links of each row not already seen in an earlier table, and for each row
    the least id that it is connected to inside its bucket. Pairs are looked at in memory, a piece at a time."""
    n, ids, weights = len(rows), rows["key"].to_numpy(), rows["copies"].to_numpy()
    unit, side, cut = unit_rows(rows["vector"]), rows["side"].to_numpy(), (rows["low"] != rows["high"]).to_numpy()
    ends = np.repeat(starts + sizes, sizes)
    after, found = ends - np.arange(n) - 1, []
    bounds = np.searchsorted(np.cumsum(after), np.arange(200_000, after.sum() + 200_000, 200_000)) + 1
    for first, last in zip([0, *bounds], bounds, strict=False):
        i = np.repeat(np.arange(first, min(last, n)), after[first:last])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[first:last]) - after[first:last], after[first:last])
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
        near &= ~cut[i] | (side[i] != side[j])
        found.append((i[near], j[near]))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    counts = np.zeros(n, np.int64)
    if len(i):
        new = ~h.met_before(unit, i, j, rows["tab"].to_numpy()[i])
        np.add.at(counts, i[new], weights[j[new]])
        np.add.at(counts, j[new], weights[i[new]])
    return counts, _least_labels(ids, i, j)


def _compare_large(rows: pd.DataFrame, h: Hashing, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for the rows of one bucket, or of two parts of a crowded one, a block of rows at a time."""
    n, ids, weights = len(rows), rows["key"].to_numpy(), rows["copies"].to_numpy()
    unit, side, table = unit_rows(rows["vector"]), rows["side"].to_numpy(), int(rows["tab"].iat[0])
    crossed = bool((rows["low"] != rows["high"]).iat[0])
    before = h.signatures(unit)[:, :table]
    counts, linked = np.zeros(n, np.int64), np.zeros((n, n), bool)
    for at in range(0, n, 128):
        block = slice(at, min(n, at + 128))
        near = unit[block] @ unit.T >= least
        near[np.arange(near.shape[0]), np.arange(block.start, block.stop)] = False
        if crossed:
            near &= side[block, None] != side[None, :]
        linked[block] = near
        i, j = np.nonzero(near)
        if len(i) and table:
            new = np.concatenate([~(before[i[k : k + 65536] + at] == before[j[k : k + 65536]]).any(axis=1) for k in range(0, len(i), 65536)])
            i, j = i[new], j[new]
        counts[block] += np.bincount(i, weights[j], block.stop - block.start).astype(np.int64)
    label = ids.copy()
    some = np.flatnonzero(linked.any(axis=1))
    inner, own = linked[np.ix_(some, some)], label[some]
    while len(some):
        better = np.minimum(own, np.where(inner, own[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (better == own).all():
            break
        own = better
    label[some] = own
    return counts, label


def vector_links(distinct: DataFrame, least: float, h: Hashing) -> DataFrame:
    """(key, n, near): the new links of a vector in some bucket (n), or a link to another vector (near).

    ``distinct`` (key, copies, vector) has each usable vector once. Vectors are dealt by table and bucket. A
    bucket of over ``h.dense`` vectors is cut into parts by a hash of the key, and each pair of parts is a
    group of its own, so no task holds more than two parts at a time however large the bucket; all pairs of
    a bucket are compared, but pairs are counted where they are found and never written out.
    """

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for _, same in rows.groupby(rows["vector"].str.len()):
                for at in range(0, len(same), 2000):
                    some = same.iloc[at : at + 2000]
                    keys = h.signatures(unit_rows(some["vector"]))
                    yield pd.DataFrame({"key": some["key"].repeat(h.tables), "tab": np.tile(np.arange(h.tables), len(some)), "bucket": keys.ravel(), "dim": some["vector"].str.len().repeat(h.tables)})

    places = materialize(distinct.mapInPandas(hashed, "key long, tab int, bucket long, dim int"), "buckets")
    place = ["tab", "bucket", "dim"]
    sizes = materialize(places.groupBy(*place).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    parts = F.ceil(F.col("size") / h.dense).cast("int")
    placed = places.join(sizes, place).withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.withColumn("with", other).select("key", *place, F.least("mine", "with").alias("low"), F.greatest("mine", "with").alias("high"), (F.col("mine") > F.col("with")).alias("side"))
    full = materialize(placed, "placed").join(distinct, "key")
    group = [*place, "low", "high"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def result(keys: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
            some, off = counts > 0, labels != keys
            n = np.concatenate([counts[some], np.zeros(off.sum(), np.int64)])
            near = pd.array([*[None] * int(some.sum()), *labels[off].tolist()], dtype="Int64")
            return pd.DataFrame({"key": np.concatenate([keys[some], keys[off]]), "n": n, "near": near})

        def finish(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            change = (rows[group] != rows[group].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(change)
            sizes = np.diff([*starts.tolist(), len(rows)])
            for a, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                one = rows.iloc[a : a + size]
                yield result(one["key"].to_numpy(), *_compare_large(one, h, least))
            fit = (sizes > 1) & (sizes <= SMALL)
            small = rows[np.repeat(fit, sizes)]
            for _, same in small.groupby("dim"):
                own = (same[group] != same[group].shift()).any(axis=1).to_numpy()
                at = np.flatnonzero(own)
                yield result(same["key"].to_numpy(), *_compare_small(same, at, np.diff([*at.tolist(), len(same)]), h, least))

        for rows in batches:
            last = (rows[group] == rows[group].iloc[-1]).all(axis=1).to_numpy()
            first = len(rows) - int(last[::-1].cumprod().sum())
            if kept and first == 0 and (kept[-1][group].iloc[-1] == rows[group].iloc[-1]).all():
                kept.append(rows)
                continue
            yield from finish(pd.concat([*kept, rows.iloc[:first]]))
            kept = [rows.iloc[first:]]
        if kept:
            yield from finish(pd.concat(kept))

    dealt = full.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group)
    return dealt.mapInPandas(compare, "key long, n long, near long")


def near_vectors(vectors: DataFrame, least: float = 0.95, hashing: Hashing | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Vectors are linked at a cosine of ``least`` or more; a component is named by its least vec_id and that
    vector is kept. Null and zero vectors and those with null or non-finite components link with nothing;
    vectors of different lengths are never compared. Equal vectors are compared once and counted by their
    number. Rows with equal vec_id are separate vectors that link as any others. A row with a null vec_id has
    no links and is its own component. An empty table yields no rows. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    good = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    marked = rows.select("vec_id", "vector", good.alias("good")).withColumn("vector", F.when(F.col("good"), F.col("vector")))
    classes = marked.where("good").groupBy("vector").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("copies"))
    distinct = materialize(classes.select(F.monotonically_increasing_id().alias("key"), "vec", "copies", "vector"), "vectors")
    h = hashing or Hashing.for_rows(distinct.count())
    found = materialize(vector_links(distinct.select("key", "copies", "vector"), least, h), "vector-links")
    counts = materialize(found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0"), "link-counts")
    groups = components(found.where("near is not null").select(F.col("key").alias("u"), F.col("near").alias("v")))
    named = distinct.join(counts, "key", "left").join(groups.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("vector", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
    named = materialize(named, "vector-classes")
    names = named.groupBy("component").agg(F.min("vec").alias("component_id"))
    out = marked.join(named.join(names, "component").select("vector", "n_links", "component_id"), "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
