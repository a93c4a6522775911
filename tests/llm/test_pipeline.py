import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import document_dedup
from quantloom.llm.document_dedup import close_pairs, parities, shingle_prefixes, simhash_pairs
from quantloom.llm.graph import components
from quantloom.llm.queries import QUERIES
from quantloom.llm.simhash import fingerprint


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labels and a benchmark beside which the stages run."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "a passage of the benchmark that no text of these holds"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


#: Ids that stay in each stage of the odd documents below; the last document has no id.
ODD_LEFT = {"toxicity": [None, 1, 2, 3, 4, 5, 6, 7, 8, 9], "line_dedup": [None, 1, 2, 3, 4, 6, 7, 8], "simhash_dedup": [1, 2, 6, 7, 8], "decontamination": [None, 1, 2, 3, 4, 5, 6, 7, 8, 9]}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_clashing_names(spark, odd, none, tables, name, stage):
    more = lambda d: d.selectExpr("doc_id", "text", "lang", "fp", "component_id", "removed_lines", "7 AS toxicity", "8 AS line_owner", "'k' AS gone", "9 AS rows", "length(text) AS n_chars")
    docs = more(odd.unionByName(odd.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long"))))
    got = stage(spark, docs, tables)
    if name == "packing":
        assert {r["doc_id"] for r in got.collect()} == {None, *range(1, 10)}
    else:
        rows = got.collect()
        assert got.columns == docs.columns
        assert sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i)) == ODD_LEFT[name]
        assert all((r["toxicity"], r["line_owner"], r["gone"], r["rows"], r["removed_lines"]) == (7, 8, "k", 9, "n") for r in rows)
    assert stage(spark, more(none), tables).count() == 0


def test_near_duplicate_stage_tells_rows_of_one_id_apart(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (2, long), (2, "another text that stands for itself here"), (3, "third text with its own words only"), (3, "third text with its own words only")]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, left)) == sorted([rows[0], rows[2], rows[3]])


def test_run_keeps_clean_documents_and_drops_planted_ones(spark, tmp_path):
    clean = [(i, " ".join(f"word{i}x{j}" for j in range(60))) for i in range(1, 40)]
    item = " ".join(f"bench{j}" for j in range(30))
    planted = [(50, clean[0][1]), (51, clean[1][1] + " more"), (52, " ".join(f"own{j}" for j in range(40)) + " " + item), (53, " ".join(f"rude{j}" for j in range(40)) + " you idiot")]
    docs = [(i, t, "en", "src", len(t)) for i, t in clean + planted] + [(i, f"text number{i} of {i * 7} " + ("you idiot" if i % 2 else "fine words"), "en", "src", 1) for i in range(100, 200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(100, 200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i, _ in clean} <= left and not left & {50, 51, 52, 53} and not any(i % 2 for i in left if i >= 100)


def test_near_duplicate_stage_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = ["", None, " \n", "Three short words", "three  SHORT words", "three short word"]
    for n in (7, 12, 40, 100, 250, 1000):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, 5, 9):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = rng.choice(words)
                texts.append(" ".join(copy).upper() if edits == 2 else " ".join(copy))
    line = " ".join(words[:30])
    texts += [f"{line} {i} {' '.join(rng.choice(words) for _ in range(i % 12))}" for i in range(60)]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert left == {i for i in range(len(texts)) if find(i) == i}
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id < 0"), "").count() == 0


def test_near_duplicate_stage_pairs_by_simhash(spark):
    rng = random.Random(5)
    texts = []
    for i in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(400)]
        texts += [" ".join(base), " ".join([*base, "more"]), " ".join(base[2:])]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, text_hash long, text string")
    sets = shingle_prefixes(docs, 5, Fraction(4, 5)).selectExpr("doc_id AS id", "n", "fp")
    want = {i: fingerprint(t, 5) for i, t in enumerate(texts)}
    assert {r["id"]: r["fp"] for r in sets.collect()} == want
    bits = lambda a, b: ((want[a] ^ want[b]) & (1 << 64) - 1).bit_count()
    got = {tuple(r) for r in simhash_pairs(sets).collect()}
    assert got and all(u < v and bits(u, v) <= 2 for u, v in got)
    links = spark.createDataFrame(sorted(got), "u long, v long")
    every = [(a, b) for b in want for a in want if a < b and bits(a, b) <= 2]
    assert sorted(map(tuple, components(links).collect())) == sorted(map(tuple, components(spark.createDataFrame(every, "u long, v long")).collect()))


def test_stages_send_whole_texts_in_small_batches(spark, odd, tables):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for name, stage in corpus_pipeline.STAGES:
        if name in ("toxicity", "simhash_dedup", "packing"):
            spark.conf.set(key, 10_000)
            stage(spark, odd.withColumn("n_chars", F.length("text")), tables)
            assert int(spark.conf.get(key)) <= 1024
    spark.conf.unset(key)


def test_parities_rule_out_unlike_sets_and_lose_no_similar_pair(spark):
    rng, t = np.random.default_rng(3), Fraction(4, 5)
    sets = [np.zeros(0, np.int64)]
    for n in (1, 5, 9, 60, 64, 65, 70, 120, 128, 130, 500, 512, 520, 2000):
        base = rng.integers(-(1 << 63), 1 << 63, n, np.int64)
        for kept in (1, 0.97, 0.9, 0.88, 0.8, 0.5, 0):
            own = rng.integers(-(1 << 63), 1 << 63, n, np.int64)
            sets += [np.unique(np.concatenate([base[: round(n * kept)], own[round(n * kept) :]])), base[: max(1, round(n * kept))]]
    assert all(len(parities(x)) * 64 >= len(x) for x in sets)
    table = spark.createDataFrame([(i, len(x), parities(x).tolist()) for i, x in enumerate(sets)], "id long, n int, odd array<long>")
    alike = lambda x, y: len(shared := np.intersect1d(x, y)) * 9 >= 4 * (len(x) + len(y)) and len(shared) > 0
    pairs = [(u, v) for v in range(1, len(sets)) for u in range(1, v)]
    got = {tuple(r) for r in close_pairs(spark.createDataFrame(pairs, "u long, v long"), table, t).collect()}
    similar = {(u, v) for u, v in pairs if alike(sets[u], sets[v])}
    far = {(u, v) for u, v in pairs if min(len(sets[u]), len(sets[v])) >= 60 and 2 * len(np.intersect1d(sets[u], sets[v])) < len(sets[u])}
    assert similar <= got and len(similar) > 100
    assert len(far) > 1000 and len(far & got) < len(far) / 100


def test_near_duplicate_stage_makes_sets_only_of_pairs_that_parities_leave(spark, monkeypatch):
    rng, made = random.Random(2), []
    write = document_dedup.materialize

    def noted(df, name):
        out = write(df, name)
        made.extend([out.count()] if name == "candidate-sets" else [])
        return out

    monkeypatch.setattr(document_dedup, "materialize", noted)
    passage = [f"p{i}" for i in range(12)]
    texts = [" ".join([*(f"w{rng.randrange(10**9)}" for _ in range(60)), *passage[: 6 + i % 6]]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(range(40))
    assert 0 < sum(made) <= 6


def test_near_duplicate_stage_leaves_texts_where_they_are(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        docs = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, "other words")], "doc_id long, text string")
        left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert "BroadcastHashJoin" in left._jdf.queryExecution().sparkPlan().toString()
        assert {r["doc_id"] for r in left.collect()} == {1, 3}
    finally:
        spark.conf.set(key, before)
