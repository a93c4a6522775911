"""Nearest vectors by inner product from balanced posting lists, whose centroids are searched by a graph in memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding_dedup import usable
from .storage import materialize


@dataclass(frozen=True)
class Plan:
    """How lists are made: about ``rows`` vectors each, ``most_lists`` of them at most (lists grow beyond). Centroids are
    fitted to ``sample`` vectors. A vector goes to up to ``replicas`` lists whose centroids are at most ``closure`` times
    farther than the nearest. The share ``recall`` of the sample's own neighbours sets the distance ratio up to which
    a query looks into lists. ``part`` rows and ``chunk`` queries of a list meet in one group. ``floor_rows`` of the sample tell how good a vector must
    be to matter to a query, before its lists are read."""

    rows: int = 512
    most_lists: int = 4096
    sample: int = 20_000
    replicas: int = 3
    closure: float = 1.1
    recall: float = 0.96
    degree: int = 24
    floor_rows: int = 8192
    part: int = 8192
    chunk: int = 2048
    seed: int = 7


def balanced_leaves(points: np.ndarray, leaves: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Row numbers of ``leaves`` parts of equal size (but for one row): halved again and again along the line between
    two means, which are those of the halves in turn. Parts next to each other in the list are near."""

    def halve(rows: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [rows]
        part = points[rows]
        line = part[rng.integers(len(part))] - part[rng.integers(len(part))]
        cut = len(rows) * (n // 2) // n
        for _ in range(8):
            order = np.argsort(part @ line, kind="stable")
            line = part[order[cut:]].mean(0) - part[order[:cut]].mean(0)
        return halve(rows[order[:cut]], n // 2) + halve(rows[order[cut:]], n - n // 2)

    return halve(np.arange(len(points)), leaves)


@dataclass(frozen=True)
class Lists:
    """Centroids of the lists, links between near ones, the ratio that prunes a query's lists, and the sample with the
    lists that hold each of its rows (the number of lists where there are fewer).

    Vectors are divided by ``norm``, the largest length, and get one more component that makes them unit vectors;
    queries are unit vectors with a zero there. The nearest by distance is then the largest by inner product.
    """

    centroids: np.ndarray
    links: np.ndarray
    norm: float
    ratio: float
    sample: np.ndarray
    held: np.ndarray
    plan: Plan

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.norm
        square = np.einsum("ij,ij->i", x, x)
        if query:
            x, more = x / np.sqrt(square)[:, None], np.zeros(len(x))
        else:
            more = np.sqrt(np.maximum(0, 1 - square))
        return np.column_stack([x, more]).astype(np.float32)

    def search(self, x: np.ndarray, ratio: float, slack: float = 1.04) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, squared distance), by row and distance, of the lists whose centroids are at most ``ratio`` times
        as far as the nearest one found. From some entries on, centroids within ``slack`` times that bound pass on to
        those they are linked with until no new one is within it."""
        k, found = len(self.centroids), []
        square = np.einsum("ij,ij->i", self.centroids, self.centroids)
        entries = np.unique(np.linspace(0, k - 1, 16).astype(int))
        for at in range(0, len(x), 512):
            some = x[at : at + 512]
            own = np.einsum("ij,ij->i", some, some)
            far = np.full((len(some), k), np.inf, np.float32)
            done = np.zeros((len(some), k), bool)
            row, node = np.repeat(np.arange(len(some)), len(entries)), np.tile(entries, len(some))
            while len(row):
                for i in range(0, len(row), 100_000):
                    r, c = row[i : i + 100_000], node[i : i + 100_000]
                    far[r, c] = own[r] - 2 * np.einsum("ij,ij->i", some[r], self.centroids[c]) + square[c]
                bound = np.maximum(far.min(1, keepdims=True), 1e-12) * (ratio * slack) ** 2
                row, node = np.nonzero((far <= bound) & ~done)
                done[row, node] = True
                new = np.unique((row[:, None] * k + self.links[node]).ravel())
                row, node = new // k, new % k
                fresh = np.isinf(far[row, node])
                row, node = row[fresh], node[fresh]
            far = np.maximum(far, 0)
            row, node = np.nonzero(far <= np.maximum(far.min(1, keepdims=True), 1e-12) * ratio**2)
            order = np.lexsort((node, far[row, node], row))
            found.append((row[order] + at, node[order], far[row, node][order]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def places(self, x: np.ndarray) -> np.ndarray:
        """The lists that each vector is kept in, the number of lists where there are fewer than ``replicas``. The nearest
        one first; another one within the closure only if it is not nearer to a list already chosen than to the
        vector, as that list stands for it then."""
        row, node, far = self.search(self.lifted(x, False), self.plan.closure)
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        turn = np.arange(len(row)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        chosen = np.full((len(x), self.plan.replicas), -1)
        chosen[row[first], 0] = node[first]
        count = np.ones(len(x), np.int64)
        for t in range(1, int(turn.max(initial=0)) + 1):
            at = np.flatnonzero((turn == t) & (count[row] < self.plan.replicas))
            if not len(at):
                continue
            r, c = row[at], node[at]
            ok = np.ones(len(at), bool)
            for j in range(self.plan.replicas):
                there = np.flatnonzero((chosen[r, j] >= 0) & ok)
                gap = self.centroids[c[there]] - self.centroids[chosen[r[there], j]]
                ok[there] = np.einsum("ij,ij->i", gap, gap) > far[at[there]]
            r, c = r[ok], c[ok]
            chosen[r, count[r]] = c
            count[r] += 1
        return np.where(chosen < 0, len(self.centroids), chosen)

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each vector is kept in."""
        held = self.places(x)
        row, turn = np.nonzero(held < len(self.centroids))
        return row, held[row, turn]

    def probed(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the lists that a query looks into."""
        row, node, _ = self.search(self.lifted(q, True), self.ratio)
        return row, node

    def floor(self, q: np.ndarray, row: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
        """For each query, which looks into the lists ``node`` of ``row``, a score that its k-th best vector there has at
        least: that of the k-th best of some rows of the sample that are kept in those lists."""
        some, held = self.sample[: self.plan.floor_rows], self.held[: self.plan.floor_rows]
        out = np.full(len(q), -np.inf)
        for at in range(0, len(q) if len(some) >= k else 0, 256):
            n = min(256, len(q) - at)
            open_ = np.zeros((n, len(self.centroids) + 1), bool)
            mine = (row >= at) & (row < at + n)
            open_[row[mine] - at, node[mine]] = True
            there = open_[:, held[:, 0]]
            for j in range(1, held.shape[1]):
                there |= open_[:, held[:, j]]
            score = np.where(there, q[at : at + n] @ some.T, -np.inf)
            best = np.partition(score, len(some) - k, axis=1)[:, len(some) - k]
            out[at : at + n] = best - 1e-9 * np.linalg.norm(q[at : at + n], axis=1) * self.norm
        return out


def fit_lists(sample: np.ndarray, rows: int, norm: float, plan: Plan, k: int = 20) -> Lists:
    """Lists for a table of ``rows`` vectors, from a sample of them, on the driver; sample and lists have fixed bounds."""
    rng = np.random.default_rng(plan.seed)
    bare = Lists(np.zeros((1, 1)), np.zeros((1, 1)), norm, 1.0, sample, np.zeros((0, 1), int), plan)
    points = bare.lifted(sample, False)
    n = max(1, min(plan.most_lists, -(-rows // plan.rows), len(points) // 4))
    centroids = np.array([points[leaf].mean(0) for leaf in balanced_leaves(points, n, rng)], np.float32)
    square = np.einsum("ij,ij->i", centroids, centroids)
    near = np.argsort(square[None, :] - 2 * centroids @ centroids.T, axis=1, kind="stable")[:, : plan.degree + 1]
    ring = np.arange(n)[:, None]
    lists = replace(bare, centroids=centroids, links=np.hstack([near, (ring + 1) % n, (ring - 1) % n]))
    lists = replace(lists, held=lists.places(sample))
    asked = rng.choice(len(points), min(len(points), 200), replace=False)
    return replace(lists, ratio=_ratio(lists, asked, k))


def _ratio(lists: Lists, asked: np.ndarray, k: int) -> float:
    """The least ratio, in steps of a hundredth, up to which the asked rows of the sample look into a list with each of
    the share ``recall`` of their k nearest in it. The whole table is denser, so its neighbours are nearer."""
    sample = lists.sample
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0
    nearest = np.argpartition(-score, k - 1, axis=1)[:, :k]
    q = lists.lifted(sample[asked], True)
    far = np.stack([((v - lists.centroids) ** 2).sum(1) for v in q])
    times = np.column_stack([np.sqrt(far / np.maximum(far.min(1, keepdims=True), 1e-12)), np.full(len(q), np.inf)])
    need = times[np.arange(len(q))[:, None, None], lists.held[nearest]].min(2).ravel()
    return float(np.ceil(np.quantile(need, lists.plan.recall) * 100) / 100)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _counts(rows: DataFrame, lists: Lists, dim: int, query: bool) -> np.ndarray:
    """Rows in each list, or queries that look into it: a row a list and task, added up by Spark."""
    sent = rows.sparkSession.sparkContext.broadcast(lists)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = sent.value
        n = np.zeros(len(lists.centroids), np.int64)
        for batch in batches:
            x = _vectors(batch.column("vector"), dim)
            n += np.bincount((lists.probed(x) if query else lists.placed(x))[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"list": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})

    out = np.zeros(len(lists.centroids), np.int64)
    for r in rows.select("vector").mapInArrow(count, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():
        out[r["list"]] = r["n"]
    return out


def _dealt(rows: DataFrame, lists: Lists, dim: int, parts: np.ndarray, chunks: np.ndarray, k: int, query: bool) -> DataFrame:
    """Rows by group (list, part, chunk): a vector in one part of its lists with each chunk of queries, a query in one
    chunk with each part."""
    sent = rows.sparkSession.sparkContext.broadcast((lists, parts, chunks))
    vector = rows.schema["vector"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, parts, chunks = sent.value
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                x = _vectors(batch.column("vector"), dim)
                row, node = lists.probed(x) if query else lists.placed(x)
                floor = pa.array(lists.floor(x, row, node, k + 1)) if query else None
                key = batch.column("key").to_numpy(zero_copy_only=False)
                mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                mine, other = (chunks, parts) if query else (parts, chunks)
                own = mixed[row] % np.maximum(1, mine[node])
                times = other[node]  # a list nobody asks has no chunks: its rows go nowhere
                row, node, own = np.repeat(row, times), np.repeat(node, times), np.repeat(own, times)
                with_ = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                part, chunk = (with_, own) if query else (own, with_)
                columns = {"list": pa.array(node, pa.int32()), "part": pa.array(part, pa.int32()), "chunk": pa.array(chunk, pa.int32())}
                more = floor if query else batch.column("least")
                columns |= {"key": batch.column("key").take(pa.array(row)), "more": more.take(pa.array(row)), "vector": batch.column("vector").take(pa.array(row))}
                yield pa.RecordBatch.from_pydict(columns)

    return rows.select("key", "least", "vector").mapInArrow(deal, f"list int, part int, chunk int, key long, more {'double' if query else 'long'}, vector {vector}")


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, dim)), *([np.stack(vectors.to_numpy()).astype(np.float64)] if len(vectors) else [])])


def _best(rows: pd.DataFrame, queries: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """The k best vectors of a group for each of its queries, without those below the query's floor. Scores are summed
    in one fixed order, so that they are the same in every list."""
    x, q, out = _matrix(rows["vector"], dim), _matrix(queries["vector"], dim), []
    least, key, asked, floor = rows["more"].to_numpy(), rows["key"].to_numpy(), queries["key"].to_numpy(), queries["more"].to_numpy()
    for at in range(0, len(q) if len(x) else 0, 256):
        score = q[at : at + 256] @ x.T
        bound = floor[at : at + 256]
        if len(x) > k:
            kth = np.partition(score, len(x) - k, axis=1)[:, len(x) - k]
            bound = np.maximum(bound, kth - 1e-9 * np.abs(kth))
        i, j = np.nonzero(score >= bound[:, None])
        exact = (q[at + i] * x[j]).sum(1)
        order = np.lexsort((least[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        out.append(pd.DataFrame({"asked": asked[at + i[keep]], "key": key[j[keep]], "least": least[j[keep]], "score": exact[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"asked": [], "key": [], "least": [], "score": []}).astype({"asked": "int64", "key": "int64", "least": "int64"})


def _looked_up(classes: DataFrame, queries: DataFrame, lists: Lists, dim: int, k: int) -> DataFrame:
    """(asked, key, least, score): the k + 1 best classes in the lists that each query looks into."""
    asked, held = _counts(queries, lists, dim, True), _counts(classes, lists, dim, False)
    parts, chunks = -(-held // lists.plan.part), -(-asked // lists.plan.chunk)
    rows, probes = _dealt(classes, lists, dim, parts, chunks, k, False), _dealt(queries, lists, dim, parts, chunks, k, True)
    group = ["list", "part", "chunk"]
    met = rows.groupBy(*group).cogroup(probes.groupBy(*group)).applyInPandas(lambda r, q: _best(r, q, dim, k + 1), "asked long, key long, least long, score double")
    once = met.repartition(F.col("asked")).groupBy("asked", "key", "least").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "least"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")


def _searched(classes: DataFrame, dim: int, k: int, plan: Plan) -> DataFrame:
    """(asked, key, least, score): for each class of equal vectors that is asked for, the k + 1 best classes found. A
    query whose lists hold fewer, while there are more, looks into all lists."""
    vector = F.col("vector")
    largest = classes.agg(F.max(F.array_max(F.transform(vector, lambda v: F.abs(v.cast("double")))))).first()[0]
    unit = F.aggregate(vector, F.lit(0.0), lambda s, v: s + (v.cast("double") / largest) * (v.cast("double") / largest))
    n, norm = classes.agg(F.count(F.lit(1)), F.sqrt(F.max(unit)) * largest).first()
    place = F.xxhash64(F.lit(plan.seed), "key")
    share = min(1.0, 2 * plan.sample / n)
    drawn = classes.where(F.pmod(place, F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy(place, "key").limit(plan.sample).select("vector").toPandas()
    lists = fit_lists(np.stack(drawn["vector"].to_numpy()).astype(np.float64), n, norm, plan, k)
    queries = classes.where("asked")
    found = materialize(_looked_up(classes, queries, lists, dim, k), "found")
    enough = found.groupBy("asked").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k + 1, n)).select(F.col("asked").alias("key"))
    short = materialize(queries.join(enough, "key", "left_anti"), "short")
    if short.isEmpty():
        return found
    again = _looked_up(classes, short, replace(lists, ratio=np.inf), dim, k)
    return found.join(short.select(F.col("key").alias("asked")), "asked", "left_anti").unionByName(again)


def nearest_vectors(vectors: DataFrame, asked: Column, k: int = 20, plan: Plan | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``vectors`` (vec_id, embedding) for which ``asked`` holds: the ``k``
    other rows with the largest inner product that are found, largest first, equal scores by vec_id.

    Scores are the inner products of the vectors as they are, in double precision. Rows without a vec_id take no
    part, nor do null and zero vectors and those with null or non-finite components; vectors of different lengths
    never meet. Rows with the query's own vec_id are the query. Of equal vectors one is searched for and kept in the
    lists, and they are told apart again at the end, where the k + 1 least ids are all that a query can need. With
    fewer than ``k`` others a query has as many; an empty table yields no rows. Other columns are not read, but those
    that ``asked`` names.

    Lists are fitted to a bounded sample, and every row is in one or more of them. A list with more than ``plan.part``
    rows or ``plan.chunk`` queries is cut into groups, which together compare all rows with all queries of it.
    """
    plan = plan or Plan()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    classes = rows.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.max("asked").alias("asked"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("key"), "least", "copies", "asked", "vector"), "vectors")
    sizes = sorted(r[0] for r in classes.where("asked").select(F.size("vector")).distinct().collect())
    found = vectors.sparkSession.createDataFrame([], "asked long, key long, least long, score double")
    for dim in sizes:
        found = found.unionByName(_searched(classes.where(F.size("vector") == dim), dim, k, plan))
    found = materialize(found, "found")
    copied = materialize(rows.join(classes.where("copies > 1").select("key", "vector"), "vector").select("key", "vec_id", "asked"), "copies")
    turn = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    ids = copied.withColumn("turn", turn).where(F.col("turn") <= k + 1).groupBy("key").agg(F.collect_list("vec_id").alias("ids"))
    single = classes.where("asked and copies = 1").select(F.col("least").alias("query_id"), F.col("key").alias("asked"))
    queries = single.unionByName(copied.where("asked").select(F.col("vec_id").alias("query_id"), F.col("key").alias("asked")).distinct())
    named = found.join(ids, "key", "left").select("asked", "score", F.explode(F.coalesce("ids", F.array("least"))).alias("vec_id"))
    pairs = queries.join(named, "asked").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
