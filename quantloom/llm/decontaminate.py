"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[ \t\n\x0B\f\r]+"
BLOCKS = 11
#: Up to this many shingles of items are sent to every task; beyond it, both sides are shuffled.
SENT_SHINGLES = 1_000_000


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.translate(text, UPPER, LOWER), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def shingle_hashes(words: str, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, repeats included."""
    last = F.size(words) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(size)]))


def simhash(hashes: DataFrame) -> DataFrame:
    """(key, fp) of ``hashes`` (key, h): a bit is set if it is set in over half of a key's shingle hashes."""
    bits = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]
    sums = hashes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *bits)
    fp = F.lit(0).cast("long")
    for i in range(64):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0)))
    return sums.select("key", fp.alias("fp"))


def block_values(fp: Column) -> list[tuple[Column, int]]:
    """The fingerprint's blocks with their widths: 9 of 6 bits and 2 of 5."""
    out, at = [], 0
    for i in range(BLOCKS):
        width = 6 if i < 64 - 5 * BLOCKS else 5
        out.append((F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1), width))
        at += width
    return out


def weighted_similarity(a: Column, b: Column) -> Column:
    """Shared weight over all weight, a shingle weighing as often as it occurs."""
    times = lambda x, of: F.size(F.filter(of, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(x, a), times(x, b)))
    return shared / (F.size(a) + F.size(b) - shared)


def similar_windows(windows: DataFrame, items: DataFrame, radius: int, least: float) -> DataFrame:
    """(key, item_id, similarity) for distinct windows (key, n, hashes) and items (item_id, n, hashes) of equal
    size. Of 11 blocks, two fingerprints within 21 bits have one that differs in one bit at most; items are
    entered under every such value of every block, so all fingerprints within ``radius`` (21 or less) meet."""
    if radius >= 2 * BLOCKS:
        raise ValueError(f"radius must be below {2 * BLOCKS}")
    prints = lambda x, key: simhash(x.select(F.col(key).alias("key"), F.explode("hashes").alias("h")))
    mine = materialize(prints(windows, "key").join(windows, "key"), "window-prints")
    its = materialize(prints(items, "item_id").withColumnRenamed("key", "item_id").join(items, "item_id"), "item-prints")
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), v.alias("value")) for i, (v, _) in enumerate(block_values(F.col("fp")))]))
    near = [F.struct(F.lit(i).alias("block"), v.bitwiseXOR(flip).alias("value")) for i, (v, width) in enumerate(block_values(F.col("fp"))) for flip in [0, *(1 << j for j in range(width))]]
    a = mine.select("key", "n", "fp", own.alias("at")).select("key", "n", "fp", "at.block", "at.value").alias("a")
    b = its.select("item_id", "n", "fp", F.explode(F.array(*near)).alias("at")).select("item_id", "n", "fp", "at.block", "at.value").alias("b")
    meet = (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.n") == F.col("b.n"))
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    pairs = a.join(b, meet & close).select("key", "item_id").distinct()
    both = pairs.join(mine.select("key", F.col("hashes").alias("x")), "key").join(its.select("item_id", F.col("hashes").alias("y")), "item_id")
    return both.withColumn("similarity", weighted_similarity(F.col("x"), F.col("y"))).where(F.col("similarity") >= least).select("key", "item_id", "similarity")


def window_starts(places: Column, length: Column, size: Column, least: float) -> Column:
    """Starts of all windows of ``size`` shingles, in a text of ``length`` of them, that hold as many of ``places``
    (in order) as a similarity of ``least`` needs: of two sides with n shingles, least / (1 + least) * n."""
    width = F.least(size, length)
    need = F.greatest(F.lit(1), F.ceil((width + size) * (least / (1 + least)) - 1e-9).cast("int"))
    last = F.size(places) - need
    firsts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    spans = F.transform(firsts, lambda j: F.struct(F.greatest(F.lit(0), F.get(places, j + need - 1) - width + 1).alias("from"), F.least(F.get(places, j), length - width).alias("to")))
    fit = F.filter(spans, lambda x: x["from"] <= x["to"])
    return F.array_distinct(F.flatten(F.transform(fit, lambda x: F.sequence(x["from"], x["to"]))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 20) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) of the windows of ``docs`` (doc_id, text) that match
    an item of ``benchmark`` (item_id, text).

    Words are split at ASCII white space, A-Z lower-cased. A window has as many words as the item, or all of a
    shorter text. Of all windows at every start, those are fingerprinted that hold as many shingles (of
    ``shingle`` words) of the item, in whatever order, as ``least`` needs at the least: the screen loses
    nothing. Fingerprints within ``radius`` bits are found by blocks, and the similarity of the shingles, weighted by how often
    they occur, must reach ``least``. Two sets of shingles at 0.8 differ in 9.7 of 64 bits on average with a
    deviation of 2.9, so a radius of 20 lies 3.6 deviations beyond.

    Items of fewer words than a shingle are compared as a whole; items without words, and null texts, match
    nothing. Rows with a null id are left out; rows with equal ids count as one each. Empty tables yield no rows.
    """
    items = benchmark.where("item_id is not null").select("item_id", words_of(text_or_empty()).alias("words")).where(F.size("words") > 0)
    items = materialize(items.select("item_id", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(shingle)).alias("k")), "items")
    texts = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text")).withColumn("row", F.xxhash64("text"))
    found = None
    for k in [r[0] for r in items.select("k").distinct().orderBy("k").collect()]:
        mine = materialize(items.where(F.col("k") == k).select("item_id", "n", shingle_hashes("words", k).alias("hashes")), "item-shingles")
        places = mine.select("item_id", "n", F.explode("hashes").alias("h")).distinct()
        few = places.count() <= SENT_SHINGLES
        hashed = texts.select("doc_id", "row", words_of(F.col("text")).alias("words")).select("doc_id", "row", shingle_hashes("words", k).alias("hashes"))
        # explode_outer: for explode, Spark adds a filter on the array's size and computes the array anew for it
        spread = hashed.select("doc_id", "row", "hashes", F.posexplode_outer("hashes").alias("p", "h"))
        if few:  # the array goes along at no cost, as its size is taken for matches only
            met = spread.join(F.broadcast(places), "h")
        else:
            met = spread.select("doc_id", "row", F.size("hashes").alias("len"), "p", "h").join(places, "h")
        size = (lambda: F.size("hashes")) if few else (lambda: F.col("len"))
        hits = met.select("doc_id", "row", "item_id", "n", size().alias("len"), "p").groupBy("doc_id", "row", "item_id", "n", "len").agg(F.sort_array(F.collect_set("p")).alias("ps"))
        wanted = hits.select("doc_id", "row", "n", window_starts(F.col("ps"), F.col("len"), F.col("n") - k + 1, least).alias("starts")).where(F.size("starts") > 0)
        wanted = materialize(wanted, "window-starts")
        whole = texts.join(F.broadcast(wanted) if wanted.count() <= SENT_SHINGLES else wanted, ["doc_id", "row"])
        whole = whole.select("doc_id", "n", "starts", words_of(F.col("text")).alias("words")).select("doc_id", "n", "starts", shingle_hashes("words", k).alias("hashes"))
        cut = whole.select("doc_id", "n", "hashes", F.explode_outer("starts").alias("start")).select("doc_id", "n", "start", F.slice("hashes", F.col("start") + 1, F.col("n") - k + 1).alias("hashes"))
        keyed = materialize(cut.select("doc_id", "n", "start", "hashes", F.xxhash64("n", "hashes").alias("key")), "windows")
        distinct = materialize(keyed.select("key", "n", "hashes").dropDuplicates(["key"]), "distinct-windows")
        matches = materialize(similar_windows(distinct, mine, radius, least), "window-matches")
        rows = keyed.select("doc_id", "n", "start", "key").join(matches, "key").select("doc_id", "item_id", F.col("start").alias("start_word"), F.col("n").alias("n_words"), "similarity").distinct()
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return texts.select("doc_id").join(benchmark.select("item_id").limit(0), F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    return found


def leaked_documents(docs: DataFrame, benchmark: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, similarity): one row for each document and item it holds."""
    found = find_leaks(docs, benchmark, **limits)
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.min("start_word").alias("first_word"), F.max("similarity").alias("similarity"))
