"""Toxicity scores from a classifier that is held to score a sentence alike when identity terms are swapped."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import crc_bucket, materialize, small_batches, text_or_empty

# Terms for groups of people, in rings of one kind and language; a swap takes the next in the ring.
IDENTITY_RINGS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["she", "he"], ["female", "male"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab"], ["gay", "straight", "lesbian", "bisexual", "transgender"], ["immigrants", "refugees", "natives"], ["disabled", "blind", "deaf"], ["old", "young"],
    ["frauen", "männer"], ["muslime", "christen", "juden"], ["schwule", "lesben"], ["ausländer", "flüchtlinge"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["noirs", "blancs", "arabes"], ["immigrés", "réfugiés"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["negros", "blancos"], ["inmigrantes", "refugiados"],
]
SWAP = {a: ring[(i + 1) % len(ring)] for ring in IDENTITY_RINGS for i, a in enumerate(ring)}
WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """Words, and the beginnings of longer words (marked by a tilde), which catch inflected forms."""
    out = set(words)
    for k in STEMS:
        out.update([w[:k] + "~" for w in words if len(w) > k])
    return out


@dataclass(slots=True)
class Model:
    """A logistic model over present features; ``index`` has the chosen ones."""

    index: dict[str, int]
    weights: np.ndarray
    bias: float
    tables: list[tuple[int, dict[str, int]]] = field(default_factory=list)

    def hits(self, words: set[str]) -> list[int]:
        if not self.tables:
            self.tables = [(0, {f: i for f, i in self.index.items() if f[-1] != "~"})]
            self.tables += [(k, {f[:-1]: i for f, i in self.index.items() if f[-1] == "~" and len(f) == k + 1}) for k in STEMS]
        found = set()
        for k, known in self.tables:
            if known:
                found.update(known[w] for w in (words & known.keys() if not k else {w[:k] for w in words if len(w) > k} & known.keys()))
        return sorted(found)

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.hits(words_of(text))].sum())
        return 1 / (1 + np.exp(-z)) if z > -500 else 0.0


def fit(rows: list[list[int]], labels: np.ndarray, swaps: list[tuple[list[int], list[int]]], size: int, ridge: float = 2e-5, fairness: float = 1.0, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean logistic loss + ridge * |w|^2 + fairness * mean squared difference of the
    logits of each sentence and its swapped form, by Adam."""
    lengths = np.array([len(r) for r in rows])
    flat, owner = np.concatenate([np.asarray(r, np.int64) for r in rows]), np.repeat(np.arange(len(rows)), lengths)
    pair_of, pair_at, sign = [], [], []
    for i, (a, b) in enumerate(swaps):
        for f in set(a) ^ set(b):
            pair_of.append(i)
            pair_at.append(f)
            sign.append(1.0 if f in a else -1.0)
    pair_of, pair_at, sign = np.array(pair_of, np.int64), np.array(pair_at, np.int64), np.array(sign)
    rate0 = (labels.sum() + 0.5) / (len(labels) + 1)
    x = np.zeros(size + 1)
    x[-1] = np.log(rate0 / (1 - rate0))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, x[flat], len(rows)) + x[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / len(rows)
        g = np.append(np.bincount(flat, error[owner], size) + 2 * ridge * x[:-1], error.sum())
        if len(pair_at):
            gap = np.bincount(pair_of, sign * x[pair_at], len(swaps))
            g[:-1] += np.bincount(pair_at, 2 * fairness / len(swaps) * sign * gap[pair_of], size)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 4096, folds: int = 5, fairness: float = 1.0) -> Model:
    """Fit on labelled rows (doc_id, toxic) whose crc32(doc_id) mod ``folds`` is not 0.

    ``max_rows`` bounds the labelled rows to learn from: beyond it, a share of the ids by their hash is taken,
    about that many. ``max_features`` words and word beginnings are kept by their log-likelihood ratio, counted
    by Spark over those rows; identity terms always stay, so that the penalty reaches them. The matrix of
    chosen features, bounded by the two, is fitted on the driver. Repeated labels of an id count once, the
    toxic one first; null ids and labels are left out. Without labelled rows the model is a constant.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(crc_bucket("doc_id", folds) != 0)
    known = known.groupBy(F.col("doc_id").alias("label_of")).agg(F.max(F.col("toxic").cast("int")).alias("is_toxic"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("label_of"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    texts = docs.select(F.col("doc_id").alias("text_of"), text_or_empty().alias("body"))
    sample = materialize(texts.join(F.broadcast(known), F.col("text_of") == F.col("label_of")).select("is_toxic", "body"), "labelled")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = {0: Counter(), 1: Counter()}
        for rows in parts:
            for toxic, body in zip(rows["is_toxic"], rows["body"], strict=True):
                each[int(toxic > 0)].update(features_of(words_of(body)))
        for toxic, seen in each.items():
            counts = iter(seen.items())
            while some := list(islice(counts, 1 << 14)):
                yield pd.DataFrame({"feature": [f for f, _ in some], "pos": [n * toxic for _, n in some], "neg": [n * (1 - toxic) for _, n in some]})

    totals = sample.agg(F.count(F.lit(1)), F.sum(F.col("is_toxic").cast("long"))).first()
    n, pos = totals[0], totals[1] or 0
    if not 0 < pos < n:
        rate = (pos + 0.5) / (n + 2)
        return Model({}, np.zeros(1), float(np.log(rate / (1 - rate))))
    seen = sample.mapInPandas(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).where("p + q >= 4")
    a, b = F.col("p").cast("double"), F.col("q").cast("double")
    c, d = F.lit(float(pos)) - a, F.lit(float(n - pos)) - b
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = term(a, (a + b) * pos / n) + term(b, (a + b) * (n - pos) / n) + term(c, (c + d) * pos / n) + term(d, (c + d) * (n - pos) / n)
    chosen = [r[0] for r in seen.orderBy(ratio.desc(), "feature").select("feature").limit(max_features).collect()]
    index = {f: i for i, f in enumerate(dict.fromkeys([*chosen, *sorted(SWAP)]))}
    picker = Model(index, np.zeros(len(index)), 0.0)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            sets = [words_of(b) for b in rows["body"]]
            swapped = [{SWAP.get(w, w) for w in s} if s & SWAP.keys() else None for s in sets]
            yield pd.DataFrame({"is_toxic": rows["is_toxic"], "own": [picker.hits(s) for s in sets], "other": [None if s is None else picker.hits(s) for s in swapped]})

    got = sample.mapInPandas(encode, "is_toxic int, own array<int>, other array<int>").collect()
    swaps = [(list(r[1]), list(r[2])) for r in got if r[2] is not None]
    weights, bias = fit([list(r[1]) for r in got], np.array([float(r[0] > 0) for r in got]), swaps, len(index), fairness=fairness)
    return Model(index, weights, bias)


def score_documents(docs: DataFrame, labels: DataFrame, column: str = "toxicity", folds: int = 5, model: Model | None = None) -> DataFrame:
    """Every row of ``docs`` with its columns and ``column`` (0 to 1, higher: likelier toxic; a column of that
    name is replaced), from the whole text alone. Null and empty texts get the model's base score. An empty table yields no rows."""
    small_batches(docs.sparkSession)
    fitted = model or train(docs, labels, folds=folds)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fitted.score(t) for t in part], dtype="float64")

    return docs.withColumn(column, score(text_or_empty()))
