import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm.centroids import LARGEST, Screen, exact_clusters
from quantloom.llm.posting_lists import Plan, balanced_leaves, fit_lists, nearest_vectors
from quantloom.llm.queries import op11_nearest_vectors, op12_periodic_runs, op13_exact_clusters, with_planted_runs
from quantloom.llm.runs import find_runs, periodic_runs, z_function


def plain_runs(words, least_words=24, least_periods=3):
    """All runs by comparing every word with that of every period before it."""
    n, found = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_periods * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, size):
    words = []
    while len(words) < size:
        stretch = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 40]))]
        again = stretch * rng.choice([1, 1, 3, 4, 9, 30])
        words += again[: rng.randrange(1, len(again) + 1)]
    return words


def test_z_function():
    rng = random.Random(1)
    for _ in range(800):
        a = np.array([rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 40))], np.int64)
        n = len(a)
        assert z_function(a).tolist() == [next((k for k in range(n - i) if a[k] != a[i + k]), n - i) for i in range(n)]


@pytest.mark.parametrize(("least_words", "least_periods"), [(24, 3), (6, 3), (12, 4), (1, 3)])
def test_runs_equal_those_of_all_pairs(least_words, least_periods):
    rng = random.Random(least_words)
    for _ in range(60):
        texts = [repetitive(rng, rng.choice([0, 10, 60, 300])) for _ in range(4)]
        bounds = np.cumsum([0, *map(len, texts)])
        start, end, period = find_runs(np.array([ord(w) for t in texts for w in t], np.int64), bounds, least_words, least_periods)
        for t, i, j in zip(texts, bounds, bounds[1:], strict=False):
            mine = (start >= i) & (end <= j) & (start < j)
            got = list(zip((start[mine] - i).tolist(), (end - start)[mine].tolist(), period[mine].tolist(), strict=True))
            assert got == plain_runs(t, least_words, least_periods)


def test_half_a_million_equal_words():
    start, end, period = find_runs(np.zeros(500_000, np.int64), np.array([0, 500_000]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [500_000], [1])


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_run_query_on_odd_and_planted_texts(spark, odd, tmp_path):
    rng = random.Random(9)
    some = spark.createDataFrame([(i, " ".join(repetitive(rng, 200)), "de", "x", 1, "y") for i in range(20, 90)], odd.schema)
    docs = odd.unionByName(some).unionByName(odd.where("doc_id = 5")).unionByName(odd.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for r in docs.collect():
        words = planted(r["doc_id"], [w.decode() for w in (r["text"] or "").encode().split()])
        runs = [(0, 30_000, 1)] if len(words) == 30_000 else plain_runs(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        listed, left = "".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((r["doc_id"], len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(listed), sha(left)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r["n_runs"] > 1 for r in got) and any(zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in got)


def test_planted_texts(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)]
    got = {r["doc_id"]: r["text"].split() for r in with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: planted(i, t.split()) for i, t in rows}


def test_runs_of_nothing(spark, none):
    assert periodic_runs(none).count() == 0


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(64 * x) < LARGEST for x in v)]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "z", r[1]))
    centres = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, nearest(v), far(v, centres[nearest(v)])) for i, v in kept]
    inertia = {c: sum(d for _, o, d in out if o == c) for c in range(len(centres))}
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in out]


def vectors_with_odd_rows(seed=3, n=300):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 64), (n + 3, [float("nan")] * 64), (n + 4, [1.0] * 63 + [None]), (n + 5, [1.0] * 63), (n + 6, [float("inf")] + [1.0] * 63), (None, [2.0] * 64)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1]), (8, [3e30] * 64), (9, (np.array(rows[9][1]) / 8).tolist())]
    return rows


SCHEMA = "vec_id long, embedding array<float>, cluster string, label int, vector int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", 0, 1) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("coarse", [False, True])
def test_clusters_equal_plain_integers(spark, tmp_path, coarse):
    rows = [(i, v and [round(x) / 64 if x is not None and math.isfinite(x) else x for x in v]) if coarse else (i, v) for i, v in vectors_with_odd_rows()]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_exact_clusters(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_clusters(rows), key=str)


def test_few_or_no_vectors_to_cluster(spark):
    rows = vectors_with_odd_rows()[:3]
    assert sorted(map(tuple, exact_clusters(frame(spark, rows)).collect())) == sorted(plain_clusters(rows))
    assert exact_clusters(frame(spark, [(1, None), (2, [1.0])])).count() == 0


def test_screen_holds_the_exact_values():
    rng = np.random.default_rng(1)
    for t in range(120):
        d, k, m = int(rng.integers(1, 70)), int(rng.integers(1, 20)), int(rng.choice([2, 5, 100, 2**12, 2**22]))
        x, c = rng.integers(-m, m + 1, (200, d)), rng.integers(-m, m + 1, (k, d))
        if t % 3 == 0:
            x, c = x[:1] + rng.integers(-1, 2, x.shape), x[:1] + rng.integers(-1, 2, c.shape)
            c[-1] = c[0]
        screen, true = Screen.of(c.tolist()), (c * c).sum(1) - 2 * (x @ c.T)
        low, high = screen.intervals(x)
        assert (low <= true).all() and (true <= high).all()
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        cluster, distance = screen.nearest(x)
        assert (cluster == full.argmin(1)).all() and (distance == full.min(1)).all()


def plain_nearest(rows, every=20, k=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            best = sorted((-math.fsum(x * y), i) for i, y in good if len(x) == len(y) and i != q)[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


EVERYTHING = Plan(rows=16, recall=1.0, part=16, chunk=4, replicas=2, sample=120)


def test_nearest_equal_all_pairs_where_all_lists_are_searched(spark):
    rows = [(i, v) for i, v in vectors_with_odd_rows() if i != 8 and i != 9 or v[0] < 1e3]
    rows = [r for r in rows if r[0] is None or r[0] < 1000 or r[0] % 2 == 0]
    rows += [(5000 + i, [float(i + 1), 2.0]) for i in range(45)]
    got = by_query(nearest_vectors(frame(spark, rows), F.col("vec_id") % 20 == 0, plan=EVERYTHING).collect())
    want = plain_nearest(rows)
    assert set(got) == set(want)
    found = 0
    for q, best in want.items():
        assert len(got[q]) == len(best)
        found += len({i for i, _ in got[q]} & {i for i, _ in best})
    assert found >= 0.97 * sum(map(len, want.values()))
    copies = [1000 + i for i in range(0, 60, 2)]  # equal scores: the least ids first
    for q in (1000, 1040):
        assert [i for i, _ in got[q]][:20] == ([7, 7] + [i for i in copies if i != q])[:20]


def test_registered_search_finds_nine_in_ten(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x[:2000] += 1.5 * rng.normal(size=64)  # a third of the rows lie close together
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = by_query(op11_nearest_vectors(spark, str(tmp_path)).collect())
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 6000, 20):
        score = x @ x[q]
        score[q] = -9
        hits += len(set(np.argsort(-score)[:20].tolist()) & {i for i, _ in got[q]})
        assert all(abs(s - score[i]) < 1e-12 for i, s in got[q]) and len(got[q]) == 20
    assert hits >= 0.9 * 300 * 20


def test_search_of_lengths_that_differ(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16)) * rng.lognormal(0, 1, 1500)[:, None]
    got = by_query(nearest_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0).collect())
    x, hits = x.astype(np.float32).astype(float), 0
    for q in range(0, 1500, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & {i for i, _ in got[q]})
    assert hits >= 0.9 * 75 * 20


def test_a_query_with_nearly_empty_lists_still_gets_its_rows(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(600, 8)) + 9, [[-5.0] * 8, [-5.0] * 7 + [-4.0]]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = by_query(nearest_vectors(frame(spark, rows), F.col("vec_id") % 200 == 0, plan=Plan(rows=8, replicas=1, recall=0.5)).collect())
    want = plain_nearest(rows, 200)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert got[600][0][0] == 601 and [i for i, _ in got[600]] == [i for i, _ in want[600]]


def test_search_of_few_or_no_rows(spark):
    few = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.5])]
    assert by_query(nearest_vectors(frame(spark, few), F.col("vec_id") == 0).collect()) == {0: [(1, 1.0), (2, -1.0)]}
    assert nearest_vectors(frame(spark, few[:1]), F.col("vec_id") == 0).count() == 0
    assert nearest_vectors(frame(spark, [(0, None)]), F.col("vec_id") == 0).count() == 0


def test_parts_are_balanced_and_the_graph_finds_the_near_centroids():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaves = balanced_leaves(x, 50, rng)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(3000)) and max(map(len, leaves)) - min(map(len, leaves)) <= 8
    lists = fit_lists(x, 3000 * 40, 1.0, Plan(rows=400))
    q = lists.lifted(x[:500], True)
    row, node, _ = lists.search(q, 1.2)
    far = ((q[:, None] - lists.centroids[None]) ** 2).sum(2)
    want = far <= far.min(1, keepdims=True) * 1.2**2 * (1 - 1e-5)
    got = np.zeros_like(want)
    got[row, node] = True
    assert (want & ~got).sum() <= 0.01 * want.sum()
