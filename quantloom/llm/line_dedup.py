"""Near-duplicate lines by an exact set-similarity join, with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, free_name, materialize, text_or_empty

#: Word hashes are counted in this many buckets.
BUCKETS = 1 << 16
#: Up to this many ids are sent to every task; beyond it, both sides are shuffled.
SENT_IDS = 1_000_000
#: A line looks for leaders by this many of its prefix tokens, the most frequent ones.
LED_BY = 8


@dataclass(frozen=True, slots=True)
class Numbered:
    """Documents with a number each, in order; a line's id is that number and ``bits`` bits for its place."""

    docs: DataFrame
    number: Column
    bits: int


def numbered(docs: DataFrame) -> Numbered:
    """Numbers for all rows with a doc_id, in order of doc_id. Where ids are distinct and near enough to each
    other they serve as they are. Else rows are sorted once by doc_id and text hash, numbered within their
    partition, and written; a partition's first number comes from one row a partition."""
    doc = F.col("doc_id").cast("long")
    known = docs.where(doc.isNotNull())
    low, high, rows = known.agg(F.min(doc), F.max(doc), F.count(F.lit(1))).first()
    bits = 31  # enough for any text
    if not rows:
        return Numbered(docs, doc, bits)
    if high - low >= 1 << (62 - bits):  # look how long the longest text is
        bits = max(1, (known.agg(F.max(F.octet_length("text"))).first()[0] or 0).bit_length())
    if high - low < 1 << (62 - bits) and known.groupBy(doc.alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return Numbered(docs, doc - F.lit(low), bits)
    if rows >= 1 << (62 - bits):
        raise ValueError(f"{rows} rows with lines of up to {bits} bits do not fit into one long")
    name, order = free_name("line_owner", docs.columns), [doc.asc_nulls_first(), F.xxhash64("text")]
    dealt = materialize(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    part, first, starts = F.shiftright(name, 33), 0, []
    for p, n in sorted(tuple(r) for r in dealt.groupBy(part).agg(F.count(F.lit(1))).collect()):
        starts += [F.lit(p), F.lit(first)]
        first += n
    return Numbered(dealt, F.create_map(*starts)[part] + F.col(name).bitwiseAND((1 << 33) - 1), bits)


def spaced(text: Column) -> Column:
    """Lower-cased, and with plain spaces for the other white space inside lines. Looking whether a text holds
    any of it costs much less than replacing, which most texts need not."""
    other = "\t\x0b\f\r"
    plain = low = F.lower(text)
    for c in other:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.when(reduce(or_, (text.contains(c) for c in other)), plain).otherwise(low)


def lines_of(some: Numbered) -> DataFrame:
    """(sid, line) of every line with words. The outer form of explode keeps Spark from splitting each text once
    more for a filter on the number of lines."""
    texts = some.docs.where("doc_id is not null").select(some.number.alias("num"), spaced(text_or_empty()).alias("text"))
    lines = texts.select("num", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    sid = F.shiftleft("num", some.bits).bitwiseOR(F.col("line_no").cast("long"))
    return lines.select(sid.alias("sid"), F.btrim("line").alias("line")).where("line <> ''")


def token_set(line: Column) -> Column:
    """Hashes of the distinct words. Splitting at one plain character needs no regular expression."""
    words = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(words), F.xxhash64(F.lit("")))


def rarity(docs: DataFrame) -> Column:
    """How often words occur, for all of the corpus, in an array of fixed size: for each of 2^16 buckets of word
    hashes, half a power of two a step, 63 at most. Words are taken between spaces and in their own case, so that two at
    a line's end may count as one: any fixed order gives a right join, and rarity only makes its candidates few."""
    words = docs.select(F.explode_outer(F.split(text_or_empty(), " ")).alias("word"))
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(63), F.floor(2 * F.log2(F.col("n") + 1))).cast("int")
    found = dict(counts.select("bucket", level).collect())
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(BUCKETS))), ",").cast("array<int>")


def _ceil(numerator: Column, denominator: int) -> Column:
    return F.floor((numerator + (denominator - 1)) / denominator).cast("int")


def least_overlap(a: Column, b: Column, t: Fraction) -> Column:
    """Sets of sizes a and b have a Jaccard similarity of t or more exactly if they share this many tokens."""
    return _ceil((a + b) * t.numerator, t.numerator + t.denominator)


def least_partner_overlap(n: Column, t: Fraction) -> Column:
    """A set of n and a similar one that is not smaller share at least this many tokens."""
    return _ceil(n * (2 * t.numerator), t.numerator + t.denominator)


def sketch(lines: DataFrame, levels: Column, t: Fraction) -> DataFrame:
    """(sid, k1, k2, n, b1, b2, prefix) of every line: a key of its token set, its size, the parities of its
    tokens in 128 bits, and its rarest tokens in order, as many as a partner must share one of. A token here
    is its rarity and 57 bits of its hash in one long, which sorts fast; the prefix keeps 31 bits of each, and
    tokens that then coincide cost a candidate, no result. Sets that can only equal their partners have no prefix."""
    zero = F.lit(0).cast("long")
    rank = lambda h: F.get(levels, h.bitwiseAND(BUCKETS - 1)).cast("long")
    packed = lambda h: F.coalesce(F.shiftleft(rank(h), 57).bitwiseOR(F.shiftrightunsigned(h, 7)), zero)  # noqa: E731  rarest first, then by hash
    # two readers of the set keep it a column of its own, which compiled code makes; inside the lambda's array it would be
    # interpreted. Without nulls, which there are none of, the sort compares plain numbers
    tokens = lines.select("sid", token_set(F.col("line")).alias("tokens"))
    ordered = tokens.select("sid", F.sort_array(F.transform("tokens", packed)).alias("ordered"), F.size("tokens").alias("n"))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    half = lambda k: F.aggregate("ordered", zero, lambda acc, h: F.when(h.bitwiseAND(64) == k, acc.bitwiseXOR(bit(h))).otherwise(acc))
    n = F.col("n")
    some = n * (t.denominator - t.numerator) >= t.numerator
    prefix = F.when(some, F.transform(F.slice("ordered", 1, n - _ceil(n * t.numerator, t.denominator) + 1), lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int")))
    b1, b2 = (F.when(some, half(part)).otherwise(zero) for part in (0, 64))
    return ordered.select("sid", F.xxhash64("ordered").alias("k1"), F.hash("ordered").alias("k2"), "n", b1.alias("b1"), b2.alias("b2"), prefix.alias("prefix"))


def only_with(big: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``big`` whose ``column`` is among ``ids`` (one column of that name, distinct)."""
    return big.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, column, "left_semi")


def verified(pairs: DataFrame, some: Numbered, t: Fraction) -> DataFrame:
    """Of the pairs (late, early) of line ids, those whose token sets, read again from the texts, are similar."""
    ids = materialize(pairs.select(F.explode(F.array("late", "early")).alias("sid")).distinct(), "line-ids")
    owners = materialize(ids.select(F.shiftright("sid", some.bits).alias("num")).distinct(), "line-owners")
    texts = only_with(some.docs.select("doc_id", "text", some.number.alias("num")), owners, "num")
    lines = only_with(lines_of(Numbered(texts, F.col("num"), some.bits)), ids, "sid")
    # the sets are made once a line: in the condition on pairs they would be made anew wherever it names them
    lines = materialize(lines.select("sid", token_set(F.col("line")).alias("words")), "candidate-lines")
    a, b = lines.select(F.col("sid").alias("late"), F.col("words").alias("x")), lines.select(F.col("sid").alias("early"), F.col("words").alias("y"))
    both = pairs.join(a, "late").join(b, "early")
    found = both.where(F.size(F.array_intersect("x", "y")) >= least_overlap(F.size("x"), F.size("y"), t)).select("late", "early")
    found = materialize(found.select("late").distinct(), "similar-lines")
    discard(ids, owners, lines)
    return found


def differing(a: str, b: str) -> Column:
    """In how many parities rows ``a`` and ``b`` differ."""
    return F.bit_count(F.col(f"{a}.b1").bitwiseXOR(F.col(f"{b}.b1"))) + F.bit_count(F.col(f"{a}.b2").bitwiseXOR(F.col(f"{b}.b2")))


def may_match(na: Column, nb: Column, a: str, b: str, t: Fraction) -> Column:
    """Parity filter and length filter for rows ``a`` and ``b`` of na and nb tokens: the tokens in which two sets
    differ are at least as many as the parities that differ, and na + nb less twice the least overlap at most. Joins look
    at very many pairs, so this is whole numbers only, and the filter that nearly all pairs fail comes first."""
    alike = differing(a, b) * (t.denominator + t.numerator) <= (na + nb) * (t.denominator - t.numerator)
    return alike & (nb * t.denominator >= na * t.numerator) & (na * t.denominator >= nb * t.numerator)


def leader_pairs(sets: DataFrame, t: Fraction) -> DataFrame:
    """(late, early): each line with the nearest by parities (then the earliest) of the lines that are the first of
    over two with one of its ``LED_BY`` last prefix tokens, if the filters do not rule it out. Near copies share most of
    their prefix tokens, above all the frequent ones, so a line of a large group meets several of the group's first lines
    here and is nearly always settled by the nearest, without pairs among the group; a line that its leader does not
    settle is left to the prefix join."""
    last = F.slice("prefix", F.greatest(F.size("prefix") - (LED_BY - 1), F.lit(1)), F.lit(LED_BY))
    tokens = sets.where("prefix is not null").select("sid", "n", "b1", "b2", F.explode(last).alias("token"))
    first = tokens.groupBy("token").agg(F.min("sid").alias("early"), F.count(F.lit(1)).alias("lines")).where("lines > 2")
    first = materialize(first.select("token", "early"), "leaders")
    heads = only_with(sets.select(F.col("sid").alias("early"), "n", "b1", "b2"), first.select("early").distinct(), "early")
    led = materialize(first.join(heads, "early"), "leader-lines")
    a, b = tokens.alias("a"), (F.broadcast(led) if led.count() <= SENT_IDS else led).alias("b")
    near = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("b.early") < F.col("a.sid")) & may_match(F.col("a.n"), F.col("b.n"), "a", "b", t))
    found = near.groupBy(F.col("a.sid").alias("late")).agg(F.min(F.struct(differing("a", "b").alias("differ"), "b.early")).alias("best"))
    return found.select("late", "best.early")


def prefix_pairs(sets: DataFrame, settled: DataFrame, t: Fraction) -> DataFrame:
    """(late, early): pairs of lines, the later not among ``settled`` (late), that share a prefix token where
    enough tokens are left in both (positional filter), whose sizes are close enough (length filter) and whose
    parities do not rule them out. The smaller set needs a shared token among its first few only, so its side of
    the join is shorter."""
    few = F.broadcast(settled) if settled.count() <= SENT_IDS else settled
    marked = sets.where("prefix is not null").join(few, sets["sid"] == settled["late"], "left").select("sid", "n", F.col("late").isNotNull().alias("done"), "b1", "b2", "prefix")
    # size, place and a bit for settled lines in one number: rows are many and should be short
    low = F.shiftleft(F.col("pos").cast("long"), 1).bitwiseOR(F.col("done").cast("long"))
    sizes = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(low).alias("m")
    larger = marked.select("sid", "n", "done", "b1", "b2", F.posexplode_outer("prefix").alias("pos", "token")).select("sid", sizes, "b1", "b2", "token")
    first = F.slice("prefix", F.lit(1), F.col("n") - least_partner_overlap(F.col("n"), t) + 1)
    smaller = marked.select("sid", "n", "done", "b1", "b2", F.posexplode_outer(first).alias("pos", "token")).select("sid", sizes, "b1", "b2", "token")
    a, b = larger.alias("a"), smaller.alias("b")
    (na, pa), (nb, pb) = ((F.shiftright(f"{x}.m", 32), F.shiftright(F.col(f"{x}.m").bitwiseAND((1 << 32) - 1), 1)) for x in ("a", "b"))
    order = (na > nb) | ((na == nb) & (F.col("a.sid") > F.col("b.sid")))
    open_ = F.when(F.col("a.sid") > F.col("b.sid"), F.col("a.m")).otherwise(F.col("b.m")).bitwiseAND(1) == 0
    enough = F.least(na - pa, nb - pb) * (t.denominator + t.numerator) >= (na + nb) * t.numerator
    joined = a.join(b, (F.col("a.token") == F.col("b.token")) & may_match(na, nb, "a", "b", t) & order & open_ & enough)
    return joined.select(F.greatest("a.sid", "b.sid").alias("late"), F.least("a.sid", "b.sid").alias("early")).distinct()


def late_lines(some: Numbered, similarity: Fraction) -> DataFrame:
    """(sid) of every line that an earlier line matches; see ``dedup_lines``."""
    marks = materialize(sketch(lines_of(some), rarity(some.docs), similarity), "line-marks")
    keys = marks.groupBy("k1", "k2", "n").agg(F.min("sid").alias("first"), F.count(F.lit(1)).alias("lines")).where("lines > 1")
    keys = materialize(keys.select("k1", "k2", "n", "first"), "line-sets")
    copies = materialize(marks.select("sid", "k1", "k2", "n").join(keys, ["k1", "k2", "n"]).where("sid <> first").select("sid"), "line-copies")
    sets = marks.join(F.broadcast(copies) if copies.count() <= SENT_IDS else copies, "sid", "left_anti").select("sid", "n", "b1", "b2", "prefix")
    sets = materialize(sets, "first-lines")
    discard(marks, keys)
    led = verified(materialize(leader_pairs(sets, similarity), "near-leaders"), some, similarity)
    found = verified(materialize(prefix_pairs(sets, led, similarity), "line-pairs"), some, similarity)
    firsts = materialize(led.unionByName(found), "matched-firsts")
    late = materialize(copies.unionByName(firsts.withColumnRenamed("late", "sid")), "late-lines")
    discard(copies, sets, led, found, firsts)
    return late


def dedup_lines(docs: DataFrame, similarity: Fraction = Fraction(4, 5), column: str = "removed_lines") -> DataFrame:
    """Every row of ``docs`` with its columns, ``text`` without the lines that match an earlier line, and
    ``column``, the numbers (from 0) of the lines taken out; a column of that name is replaced.

    Lines are the stretches between line feeds, in order of doc_id and place; their words are split at ASCII
    white space, lower-cased. A line goes if the word set of any earlier line, itself kept or
    not, has a Jaccard similarity of ``similarity`` or more with its own; the first of equal lines stays.
    Lines without words match nothing and stay. The join is exact; words are compared by 64-bit hashes.

    Null texts stay null. Rows with a null doc_id are returned as they are and match nothing. Rows with equal
    doc_id are separate documents in a fixed order, that of their texts' hashes, so a repeated row loses the
    lines that its first copy keeps. Ids may be any longs. An empty table yields no rows.
    """
    some = numbered(docs)
    late = late_lines(some, similarity)
    owner = free_name("line_owner_of", docs.columns)
    place = F.col("sid").bitwiseAND((1 << some.bits) - 1).cast("int")
    gone = late.groupBy(F.shiftright("sid", some.bits).alias(owner)).agg(F.sort_array(F.collect_set(place)).alias(column))
    gone = materialize(gone, "removed-lines")
    kept = [F.col(c) for c in docs.columns if c.lower() != column.lower()]
    out = some.docs.select(*kept, F.when(F.col("doc_id").isNotNull(), some.number).alias(owner + "_"))
    out = out.join(F.broadcast(gone) if gone.count() <= SENT_IDS // 4 else gone, F.col(owner + "_") == F.col(owner), "left").drop(owner, owner + "_")
    thin = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(column, i)), "\n")
    text = F.when(F.col(column).isNull(), F.col("text")).otherwise(thin)
    return out.withColumn("text", text).withColumn(column, F.coalesce(column, F.array().cast("array<int>")))
