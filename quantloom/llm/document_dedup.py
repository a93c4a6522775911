"""Near-duplicate documents: SimHash fingerprints within two bits, an exact check of their word shingles, and an exact
set-similarity join for the pairs that are alike but further apart in bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .line_dedup import least_overlap
from .simhash import fingerprint_links, majority_bits, shingle_hashes
from .storage import discard, materialize, small_batches, text_or_empty

#: Shingle hashes are counted in this many buckets.
BUCKETS = 1 << 16
#: Up to this many set ids are sent to every task; beyond it, both sides are shuffled.
SENT_SETS = 500_000
#: Bits of a shingle's hash by which sets meet; hashes that coincide in them cost a candidate, no result.
MET_BITS = 40
#: Texts whose sets a Python worker holds at once.
SLICE = 256


def rarity(docs: DataFrame, shingle: int) -> np.ndarray:
    """How common shingles are, by 2^16 buckets of their hashes, counted over all documents: 0 where a bucket
    has about as many as most have, more for each step of four deviations above it. Any fixed order of shingles
    gives a right join; this one leaves those that very many documents share to the end."""

    def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for part in (p["text"].iloc[i : i + SLICE] for p in parts for i in range(0, len(p), SLICE)):
            found = np.concatenate([shingle_hashes(text, shingle) for text in part])
            total += np.bincount((found & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    found = docs.select(text_or_empty().alias("text")).mapInPandas(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS)
    for bucket, n in found.collect():
        total[bucket] = n
    usual = np.median(total)
    return np.floor(4 * np.log2(1 + np.maximum(0, total - usual) / (4 * np.sqrt(usual) + 1))).astype(np.int64)


def shingle_set(text: str, shingle: int) -> tuple[int, np.ndarray]:
    """One signed long that names the text's set of shingles, and their distinct hashes in order."""
    found = np.unique(shingle_hashes(text, shingle)).view(np.int64)
    sig = xxhash.xxh64_intdigest(found.tobytes(), 7)
    return sig - (1 << 64 if sig >> 63 else 0), found


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of the hashes falls into each of some buckets, 64 a long: as many buckets as hashes, rounded
    up to a power of two, 64 at least. Longs that lie half the length apart give, xored, those of half the buckets."""
    bits = 1 << max(6, (len(found) - 1).bit_length())
    odd = np.bincount(found & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _with_sets(texts: DataFrame, shingle: int, **kinds: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, text_hash, sig, n, fp, names of ``kinds``) of every row of ``texts`` (doc_id, text_hash, text): the set's
    name, size and SimHash, and each of ``kinds`` taken of the hashes."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p.iloc[i : i + SLICE] for p in parts for i in range(0, len(p), SLICE)):
            sets = [shingle_set(t, shingle) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "text_hash": part["text_hash"].array, "sig": [s for s, _ in sets], "n": [len(x) for _, x in sets], "fp": [majority_bits(x.view(np.uint64)) for _, x in sets], **{kind: [of(x) for _, x in sets] for kind, of in kinds.items()}})

    return texts.mapInPandas(each, ", ".join(["doc_id long, text_hash long, sig long, n int, fp long", *(f"{kind} array<long>" for kind in kinds)]))


def shingle_prefixes(texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """(doc_id, text_hash, sig, n, fp, prefix, odd) of every row: one long that names the text's set of shingles, its size,
    its SimHash, its rarest hashes in order, as many as a similar set must share one of, and its parities. A text without
    words has the empty set."""
    levels = rarity(texts, shingle)

    def prefix(found: np.ndarray) -> np.ndarray:
        n = len(found)
        order = np.lexsort((found, levels[found & (BUCKETS - 1)]))
        return found[order[: n + (-n * least.numerator // least.denominator) + 1 if n else 0]]

    return _with_sets(texts, shingle, prefix=prefix, odd=parities)


def _can_match(n: Column, pos: Column, m: Column, at: Column, least: Fraction) -> Column:
    """Whether sets of ``n`` and ``m`` hashes whose first shared hash is at ``pos`` and ``at`` may be similar."""
    sizes = (F.least(n, m) * least.denominator) >= (F.greatest(n, m) * least.numerator)
    return sizes & (F.least(n - pos, m - at) >= least_overlap(n, m, least))


def close_pairs(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Those of ``pairs`` (u, v) of ``sets`` (id, n, odd) that their sizes and parities do not rule out. A bucket's parities
    differ only if a hash of one set alone falls there, so no more of them differ than hashes in a similar pair may: a
    ninth of both at 0.8, where sets with nothing in common differ in half their buckets. No similar pair is lost."""
    a, b = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"odd_{x}")) for x in ("u", "v"))
    nu, nv, fewer = F.col("nu"), F.col("nv"), F.least(F.size("odd_u"), F.size("odd_v"))
    sizes = (F.least(nu, nv) * least.denominator) >= (F.greatest(nu, nv) * least.numerator)
    # Sets that differ so little in size have as many longs or twice as many, for any ``least`` of a half or more.
    halved = lambda x, i: F.when(F.size(x) == fewer, x[i]).otherwise(x[i].bitwiseXOR(x[i + fewer]))
    differ = F.aggregate(F.sequence(F.lit(0), fewer - 1), F.lit(0), lambda total, i: total + F.bit_count(halved(F.col("odd_u"), i).bitwiseXOR(halved(F.col("odd_v"), i))))
    both = pairs.join(a, "u").join(b, "v").where(sizes)
    return both.where(differ <= nu + nv - 2 * least_overlap(nu, nv, least)).select("u", "v")


def _similar(pairs: DataFrame, sets: DataFrame, owners: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Those of ``pairs`` (u, v) of ``sets`` (id, n, odd) that have a similarity of ``least`` or more. Hashes are made again
    from the texts of their ``owners`` (id, sig, least), and only of those in pairs that parities leave."""
    met = materialize(pairs.distinct(), "met-pairs")
    pairs = materialize(close_pairs(met, sets, least), "set-pairs")
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    ids = materialize(owners.join(ids, "id").select("id", "sig", F.col("least").alias("owner")), "set-ids")
    few = ids.count() <= SENT_SETS
    docs = ids.select("owner").distinct()
    some = texts.join(F.broadcast(docs) if few else docs, texts["doc_id"].eqNullSafe(docs["owner"]), "left_semi")
    full = _with_sets(some, shingle, hashes=lambda x: x).select("sig", "n", "hashes")
    sigs = ids.select("id", "sig")
    full = materialize(full.join(F.broadcast(sigs) if few else sigs, "sig").dropDuplicates(["id"]), "candidate-sets")
    a = full.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("hashes").alias("x"))
    b = full.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("hashes").alias("y"))
    both = pairs.join(a, "u").join(b, "v")
    shared = F.size(F.array_intersect("x", "y"))
    links = materialize(both.where(shared >= least_overlap(F.col("nu"), F.col("nv"), least)).select("u", "v"), "set-links")
    discard(met, pairs, ids, full)
    return links


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """(u, v): pairs of ``sets`` (id, n, fp) whose fingerprints differ in at most two bits, by the grid join of
    fingerprints. Sets of one fingerprint are paired with their least, and fingerprints by their least sets."""
    prints = materialize(sets.where("n > 0").select("id", "fp"), "set-fingerprints")
    first = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    equal = prints.join(first, "fp").where("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v"))
    near = fingerprint_links(first.select("fp"))
    a, b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_id")) for x in ("u", "v"))
    near = near.join(a, "u").join(b, "v").select(F.least("u_id", "v_id").alias("u"), F.greatest("u_id", "v_id").alias("v"))
    return equal.unionByName(near)


def _apart(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) that ``group`` (node, component) does not have in one component."""
    a, b = (group.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of")) for x in ("u", "v"))
    return pairs.join(a, "u", "left").join(b, "v", "left").where("u_of is null or v_of is null or u_of <> v_of").select("u", "v")


def set_links(sets: DataFrame, owners: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Links (u, v) that connect all of the distinct ``sets`` (id, n, fp, prefix, odd) that a chain of pairs with a
    similarity of ``least`` or more connects. ``owners`` (id, sig, least) names a doc_id of each set, and ``texts``
    (doc_id, text) has its text.

    Pairs within two bits by SimHash are checked first and make the first components. A similarity of ``least``
    can go with ten bits and more, where fingerprints tell little, so the rest is found in an exact way: two
    similar sets share a hash of their prefixes. Of each shared hash, the sets are compared with its least and
    its greatest set, but for those that SimHash has connected, in rows that grow with the group. What this
    connects needs no more comparing inside: all other pairs are made, but those within one component, and a
    group's pairs start from the sets outside its least component.
    """
    t = least
    near = _similar(simhash_pairs(sets), sets, owners, texts, shingle, t)
    known = materialize(components(near), "simhash-groups")
    met = F.col("h").bitwiseAND((1 << MET_BITS) - 1).alias("h")
    entries = sets.where("n > 0").select("id", "n", F.posexplode("prefix").alias("pos", "h")).select("id", "n", "pos", met)
    # Most hashes occur once; they are left out by counts, in the smallest rows, before sets meet by hash.
    shared = materialize(entries.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h"), "shared-shingles")
    cells = materialize(entries.join(shared, "h"), "shingle-cells")
    own = F.struct("id", "n", "pos")
    outer = materialize(cells.groupBy("h").agg(F.min(own).alias("lo"), F.max(own).alias("hi")), "cell-ends")
    ends = cells.join(outer, "h").select("id", "n", "pos", F.explode(F.array("lo", "hi")).alias("to"))
    stars = ends.where((F.col("id") != F.col("to.id")) & _can_match(F.col("n"), F.col("pos"), F.col("to.n"), F.col("to.pos"), t))
    stars = stars.select(F.least("id", "to.id").alias("u"), F.greatest("id", "to.id").alias("v")).distinct()
    links = near.unionByName(_similar(_apart(stars, known), sets, owners, texts, shingle, t))
    group = materialize(components(links), "set-groups")
    named = cells.join(group, cells["id"] == group["node"], "left").select("h", "id", "n", "pos", F.coalesce("component", "id").alias("g"))
    named = materialize(named, "named-cells")
    mixed = materialize(named.groupBy("h").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("h", "g0"), "mixed-cells")
    rest = materialize(named.join(mixed, "h"), "mixed-members")
    a, b = rest.where("g <> g0").alias("a"), rest.alias("b")
    apart = (F.col("a.h") == F.col("b.h")) & (F.col("a.g") != F.col("b.g")) & ((F.col("b.g") == F.col("b.g0")) | (F.col("a.id") < F.col("b.id")))
    pairs = a.join(b, apart & _can_match(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), t))
    more = _similar(pairs.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")), sets, owners, texts, shingle, t)
    discard(shared, cells, outer, known, group, named, mixed, rest)
    return links.unionByName(more)


def similar_documents(docs: DataFrame, shingle: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """(doc_id, text_hash, component_id) of every row of ``docs`` (doc_id, text): documents linked by a chain of pairs whose
    sets of word shingles have a Jaccard similarity of ``least`` or more share a component, named by its least
    doc_id.

    ``text_hash`` (xxhash64) tells rows of equal doc_id apart. Words are as for fingerprints: between ASCII white space, A-Z lower-cased. Texts shorter than a shingle
    count as one shingle; null texts and texts without words are alike. Rows with equal doc_id are each judged;
    a null doc_id is never a component's name unless all its documents are null. No rows give no rows.
    """
    text = text_or_empty()
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    marked = materialize(shingle_prefixes(texts, shingle, least).withColumn("row", F.monotonically_increasing_id()), "shingle-sets")
    # A set is named by the number of its first row: such numbers are packed better than hashes where sets meet.
    names = materialize(marked.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("row").alias("id"), F.count(F.lit(1)).alias("rows")), "distinct-sets")
    copies = materialize(names.where("rows > 1").select("sig", F.col("id").alias("first")), "copied-sets")
    few = F.broadcast(copies) if copies.count() <= SENT_SETS else copies
    sets = marked.join(few, "sig", "left").where("first is null or row = first").select(F.col("row").alias("id"), "n", "fp", "prefix", "odd")
    group = components(set_links(sets, names.select("id", "sig", "least"), texts, shingle, least))
    named = names.join(group, names["id"] == group["node"], "left")
    named = materialize(named.select("sig", "least", F.coalesce("component", "id").alias("component")), "set-classes")
    ids = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "class-names")
    classes = materialize(named.join(ids, "component").select("sig", "component_id"), "class-ids")
    return marked.select("doc_id", "text_hash", "sig").join(classes, "sig").select("doc_id", "text_hash", "component_id")
