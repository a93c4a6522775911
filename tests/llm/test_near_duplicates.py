import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quantloom.llm.decontaminate import find_leaks, leaked_documents
from quantloom.llm.embedding_dedup import Hashing, near_vectors
from quantloom.llm.graph import components
from quantloom.llm.line_dedup import dedup_lines, least_overlap, may_match, prefix_pairs, sketch, token_set
from quantloom.llm.simhash import fingerprint, fingerprint_links, near_duplicates


def groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 900)] + [(7, 7)] + [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(150)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = groups([e for e in edges if e[0] != e[1]])
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  \n", "one", "One TWO", "a b c d e f g a b c", "é É x\x0by z"])
def test_fingerprint(text):
    assert fingerprint(text) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2])
@pytest.mark.parametrize("crowd", [3, 10_000])
def test_links_connect_what_is_near(spark, radius, crowd):
    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(rng.choice([1, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    signed = sorted(x - (1 << 64 if x >> 63 else 0) for x in prints)
    links = [(r["u"], r["v"]) for r in fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, crowd).collect()]
    want = groups([(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= radius])
    assert groups(links) == want


def test_near_duplicates_take_odd_texts(odd, none):
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 6: 6, 7: 7, 8: 8, 9: 6}
    assert near_duplicates(none).count() == 0


def plain_line_dedup(rows, t):
    seen, removed = [], {}
    for doc, text in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n")):
            s = frozenset(line.lower().encode().split())
            if s:
                if any(len(s & o) >= t * len(s | o) for o in seen):
                    removed.setdefault(doc, []).append(k)
                seen.append(s)
    return removed


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(25)]
    rows = []
    for doc in range(80):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line) if rng.random() < 0.9 else "")
        rows.append((doc, "\n".join(lines)))
    got = {r["doc_id"]: r["removed_lines"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["removed_lines"]}
    assert got == plain_line_dedup(rows, Fraction(4, 5))


def test_line_dedup_of_a_large_group_of_near_copies(spark):
    """Leaders settle most lines; edits are few, many and too many."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for doc in range(500):
        line = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            line[rng.randrange(40)] = f"v{rng.randrange(400)}"
        rows.append((doc, " ".join(line) + f"\nown{doc} w1 w2 w{doc % 7}"))
    got = {r["doc_id"]: r["removed_lines"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["removed_lines"]}
    assert got == plain_line_dedup(rows, Fraction(4, 5))


@pytest.mark.parametrize("ids", [[2**62, -(2**62), 7, 2**40], [3, 3, 3, 9]])
def test_line_dedup_takes_any_ids(spark, ids):
    texts = ["alpha beta gamma delta epsilon\nzeta eta", "alpha beta gamma delta epsilon\nown words", "kappa\nalpha beta gamma delta epsilon", "zeta eta\nkappa"]
    rows = list(zip(ids, texts, strict=True))
    order = {t: F.xxhash64(F.lit(t)) for t in texts}
    hashes = spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(order.values())]).first()
    ranked = sorted(range(4), key=lambda i: (ids[i], hashes[i]))
    want = plain_line_dedup([(n, texts[i]) for n, i in enumerate(ranked)], Fraction(4, 5))
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("line_owner", F.lit(1)), column="gone").collect()
    assert {r["text"] for r in got} == {"\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in want.get(n, [])) for n, i in enumerate(ranked)}
    assert all(r["line_owner"] == 1 for r in got) and sum(len(r["gone"]) for r in got) == sum(map(len, want.values()))


def test_line_pairs_are_filtered_by_whole_numbers(spark):
    """The join's condition has no division, and rules out exactly what the least overlap does."""
    t, none = Fraction(4, 5), F.lit(None).cast("array<int>")
    sets = spark.range(2).select(F.col("id").alias("sid"), F.lit(5).alias("n"), F.lit(0).cast("long").alias("b1"), F.lit(0).cast("long").alias("b2"), none.alias("prefix"))
    plan = prefix_pairs(sets, spark.range(1).select(F.col("id").alias("late")), t)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and not any("FLOOR" in line or " / " in line for line in joins)
    sizes = spark.range(4, 40).select(F.col("id").cast("int").alias("n"))
    a = sizes.select("n", F.lit(0).cast("long").alias("b1"), F.lit(0).cast("long").alias("b2")).alias("a")
    b = sizes.crossJoin(spark.range(63).select((F.expr("shiftleft(1L, cast(id as int))") - 1).alias("b1"), F.lit(0).cast("long").alias("b2"))).alias("b")
    na, nb, differ = F.col("a.n"), F.col("b.n"), F.bit_count(F.col("b.b1"))
    want = (nb * 5 >= na * 4) & (na * 5 >= nb * 4) & (differ <= na + nb - 2 * least_overlap(na, nb, t))
    both = a.crossJoin(b).where((na + nb - differ) % 2 == 0)  # parities differ in an even number more or fewer than tokens do
    assert both.where(want).count() > 0 and both.where(want != may_match(na, nb, "a", "b", t)).count() == 0


def test_line_words_are_made_and_sorted_by_compiled_code(spark):
    """The word set is a column of its own, and the sort's array has no nulls."""
    lines = spark.createDataFrame([(0, "a b b c")], "sid long, line string")
    levels = F.expr("array_repeat(1, 65536)")
    done = sketch(lines, levels, Fraction(4, 5))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert not any("sort_array" in line and "array_distinct" in line for line in plan.splitlines())
    assert "coalesce(" in plan and done.first()["n"] == lines.select(F.size(token_set(F.col("line")))).first()[0] == 3


def test_line_dedup_repeated_row_keeps_one(spark):
    rows = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (None, "one two three")], "doc_id long, text string")
    assert sorted(r["text"] for r in dedup_lines(rows).collect()) == ["", "one two three", "one two three"]


def test_line_dedup_takes_odd_texts(odd, none):
    got = {r["doc_id"]: r for r in dedup_lines(odd).collect()}
    assert len(got) == 9 and got[2]["text"] is None and got[4]["text"] == " \t\n " and got[5]["text"] == ""
    assert got[5]["removed_lines"] == [0, 1] and got[9]["removed_lines"] == [0] and got[1]["removed_lines"] == []
    assert got[1]["fp"] == "fp" and dedup_lines(none).count() == 0


def test_leaks_exact_edited_and_absent(spark):
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, words(rng.randint(14, 50))) for i in range(30)] + [(90, ["Two", "words"]), (91, [])]
    docs, want = [], set()
    for doc in range(60):
        text = words(80)
        if doc % 3 == 0:
            i, item = items[doc // 3]
            part = [w.upper() for w in item] if doc % 2 else list(item)
            if len(item) > 40 and doc % 2:
                part[1] = "edit"
            at = rng.randrange(60)
            text[at:at] = part
            want.add((doc, i))
        docs.append((doc, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "some two WORDS here")]
    got = leaked_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want | {(102, 90)}


def test_leaks_of_nothing(spark, odd, none):
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert find_leaks(none, items).count() == 0 and find_leaks(odd, items.where("item_id < 0")).count() == 0


@pytest.mark.parametrize("dense", [2048, 8])
def test_vectors_equal_brute_force(spark, dense):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    x = np.vstack([c + rng.normal(0, s, (12, 16)) for c, s in zip(centres, np.linspace(0.02, 0.4, 20))]).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, x[0].tolist()), (904, [None] + [1.0] * 15)]
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95, Hashing(dense=dense)).collect()}
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if i < 900 or i == 903}
    links = {(a, b) for a in good for b in good if a != b and good[a] @ good[b] >= 0.95}
    found = sum(r["n_links"] for r in got.values())
    assert 0.97 * len(links) <= found <= len(links)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (900, 901, 902, 904))
    want = groups(links)
    wrong = [i for i, r in got.items() if r["component_id"] != want.get(i, i)]
    assert not wrong if found == len(links) else len(wrong) <= 0.03 * len(got)


def test_vectors_with_equal_ids_are_separate(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS vector", "2 AS key", "3 AS copies", "4 AS n_links")
    got = sorted(tuple(r) for r in near_vectors(frame).collect() if r["vec_id"] is not None)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
    assert [tuple(r) for r in near_vectors(frame).collect() if r["vec_id"] is None] == [(None, 0, None, True)]


def test_projections_follow_the_rows():
    few, many = Hashing.for_rows(10_000), Hashing.for_rows(10_000_000)
    assert few.projections < many.projections and few.tables < many.tables
    assert all((1 - 0.867**h.projections) ** h.tables <= 0.004 for h in (few, many))


def test_vectors_of_nothing(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_leaks_equal_brute_force_over_all_windows(spark):
    rng = random.Random(12)
    words = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    items = [(i, words(rng.choice([5, 20, 49, 50]))) for i in range(12)] + [(50, ["a", "b"] * 10)]
    docs = []
    for i, item in items:
        for moved in (0, 1, 3, 6, 10, 25):
            part = item[moved:] + item[:moved]
            if moved == 3 and len(part) > 30:
                part[30:30] = words(1)
            docs.append((len(docs), words(rng.randrange(30)) + part + words(rng.randrange(30))))
        docs.append((len(docs), item[: len(item) - 1]))
    docs += [(500, ["a", "b"] * 40), (501, words(60)), (0, items[3][1])]
    counted = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = set()
    for d, text in docs:
        for i, item in items:
            n, k = len(item), min(5, len(item))
            for at in range(max(1, len(text) - n + 1)):
                a, b = counted(text[at : at + n], k), counted(item, k)
                if a and (a & b).total() >= 0.8 * (a | b).total():
                    want.add((d, i, at))
    got = find_leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["start_word"]) for r in got.collect()} == want
