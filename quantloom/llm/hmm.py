"""Hidden Markov language model: Baum-Welch over the whole corpus, exact sequence likelihood."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import crc_bucket, materialize, text_or_empty

#: The token that ends every text; no word holds white space.
END = b"\n"


@dataclass(slots=True)
class Model:
    """``states`` latent states over the ``vocabulary`` most frequent tokens and one symbol for all others
    (the last). A token of the others has, within that symbol, its smoothed share of the training tokens."""

    vocabulary: dict[bytes, int]
    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray
    others: float  # smoothed number of training tokens outside the vocabulary


def words_of(text: str) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased, and the end. Bytes split at the six ASCII white-space
    characters only, and lower-case no other letters."""
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def numbered(words: list[bytes], index: dict[bytes, int], other: int) -> np.ndarray:
    return np.fromiter(map(index.get, words, repeat(other)), np.int32, len(words))


def as_text(words: Iterable[bytes]) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in words]


def batches_of(texts: list[np.ndarray], cells: int = 1 << 18) -> Iterator[list[int]]:
    """Indices of sequences of like length, so that a block has about ``cells`` symbols at most, were they padded."""
    order, now, most = np.argsort([len(x) for x in texts], kind="stable"), [], 0
    for i in order.tolist():
        most = max(most, len(texts[i]))
        if now and (len(now) + 1) * most > cells:
            yield now
            now, most = [], len(texts[i])
        now.append(i)
    if now:
        yield now


def abreast(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all sequences, step by step, the longest sequence first within a step; the number of the
    sequence that each is of; and where the steps begin. Nothing is padded."""
    lengths = np.array([len(x) for x in sequences])
    order = np.argsort(-lengths, kind="stable")
    symbols = np.zeros((lengths.max(), len(sequences)), np.int32)
    for j, i in enumerate(order.tolist()):
        symbols[: lengths[i], j] = sequences[i]
    inside = np.arange(len(symbols))[:, None] < lengths[order][None, :]
    return symbols[inside], order[np.nonzero(inside)[1]], np.append(0, np.cumsum(inside.sum(1)))


def forward(symbols: np.ndarray, at: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward recursion: (state, symbol) probabilities given what precedes, and each symbol's scale.
    States are the first axis, so that every operation runs along many sequences."""
    alpha, scale, into = m.emit.take(symbols, axis=1), np.empty(len(symbols)), np.ascontiguousarray(m.moves.T)
    for t in range(len(at) - 1):
        now = alpha[:, at[t] : at[t + 1]]
        now *= into @ alpha[:, at[t - 1] : at[t - 1] + now.shape[1]] if t else m.start[:, None]
        now /= now.sum(0, out=scale[at[t] : at[t + 1]])
    return alpha, scale


def log10_likelihood(sequences: list[np.ndarray], m: Model) -> np.ndarray:
    """log10 probability of each symbol sequence by the scaled forward recursion, many sequences abreast."""
    out = np.zeros(len(sequences))
    for block in batches_of(sequences):
        symbols, owner, at = abreast([sequences[i] for i in block])
        out[block] = np.bincount(owner, np.log10(forward(symbols, at, m)[1]), len(block))
    return out


def expected_counts(sequences: list[np.ndarray], m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, moves and emissions of the sequences under the model."""
    k, size = m.emit.shape
    start, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, size))
    for block in batches_of(sequences):
        symbols, _, at = abreast([sequences[i] for i in block])
        alpha, scale = forward(symbols, at, m)
        back = m.emit.take(symbols, axis=1)
        back /= scale
        beta = np.ones((k, at[1]))
        for t in range(len(at) - 2, -1, -1):
            now = slice(at[t], at[t + 1])
            n = at[t + 1] - at[t]
            back[:, now] *= beta[:, :n]
            if t:
                before = alpha[:, at[t - 1] : at[t - 1] + n]
                moves += m.moves * (before @ back[:, now].T)
                alpha[:, now] *= beta[:, :n]
                beta[:, :n] = m.moves @ back[:, now]
            else:
                alpha[:, now] *= beta
        start += alpha[:, : at[1]].sum(1)
        for s in range(k):
            emit[s] += np.bincount(symbols, alpha[s], size)
    return start, moves, emit


def first_guess(vocabulary: dict[bytes, int], share: np.ndarray, states: int, others: float, seed: int = 11) -> Model:
    """Each state begins as the corpus's own distribution with strong random weights, and states persist, so
    that texts of one kind soon settle in one state."""
    rng = np.random.default_rng(seed)
    emit = share[None, :] * np.exp(rng.standard_normal((states, len(share))))
    moves = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - (0.1 / max(1, states - 1) if states > 1 else 0))
    return Model(vocabulary, np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True), others)


def count_words(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word, c) over all rows of ``texts`` (text), the end of each text included."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for rows in parts:
            for text in rows["text"]:
                seen.update(words_of(text))
                if len(seen) > flush:
                    yield pd.DataFrame({"word": as_text(seen), "c": list(seen.values())})
                    seen.clear()
        if seen:
            yield pd.DataFrame({"word": as_text(seen), "c": list(seen.values())})

    return texts.select("text").mapInPandas(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """At most ``most`` words with their counts: all whose count reaches the least count that keeps to the bound."""
    levels = sorted(((r[0], r[1]) for r in counts.groupBy("c").count().where("c > 1").collect()), reverse=True)
    total, least = 0, None
    for c, n in levels:
        if total + n > most:
            break
        total, least = total + n, c
    if least is None:
        return {r[0].encode(): r[1] for r in counts.orderBy(F.desc("c"), "word").limit(min(most, 1000)).collect()}
    return {r[0].encode(): r[1] for r in counts.where(F.col("c") >= least).collect()}


def train(texts: DataFrame, common: dict[bytes, int], n_tokens: int, n_words: int, states: int = 8, vocabulary: int = 8192, rounds: int = 3) -> Model:
    """Baum-Welch over all rows of ``texts`` (text). In each round every partition sends its expected counts, a
    bounded table of states by vocabulary, and Spark sums them by state and symbol; the driver gets the sums."""
    words = sorted(common, key=lambda w: (-common[w], w))[:vocabulary]
    index = {w: i for i, w in enumerate(words)}
    own = np.array([common[w] for w in words], float)
    others = max(0.0, n_tokens - own.sum()) + 0.5 * (max(0, n_words - len(words)) + 1)
    share = np.append(own, others) / (own.sum() + others)
    model = first_guess(index, share, states, others)
    other = len(words)
    for _ in range(rounds):
        now = model

        def expect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            k, size = now.emit.shape
            total = [np.zeros(k), np.zeros((k, k)), np.zeros((k, size))]
            for rows in parts:
                for at in range(0, len(rows), 4000):
                    sequences = [numbered(words_of(t), now.vocabulary, other) for t in rows["text"].iloc[at : at + 4000]]
                    for x, y in zip(total, expected_counts(sequences, now), strict=True):
                        x += y
            for kind, x in enumerate(total):
                flat = x.reshape(k, -1)
                s, j = np.nonzero(flat)
                if len(s):
                    yield pd.DataFrame({"kind": np.full(len(s), kind), "s": s, "j": j, "x": flat[s, j]})

        got = texts.select("text").mapInPandas(expect, "kind int, s int, j int, x double").groupBy("kind", "s", "j").agg(F.sum("x").alias("x")).toPandas()
        sums = [np.full(states, 0.1), np.full((states, states), 0.1), np.outer(np.full(states, 50.0), share)]
        for kind, into in enumerate(sums):
            part = got[got["kind"] == kind]
            np.add.at(into.reshape(states, -1), (part["s"].to_numpy(), part["j"].to_numpy()), part["x"].to_numpy()) if kind else np.add.at(into, part["s"].to_numpy(), part["x"].to_numpy())
        model = Model(index, sums[0] / sums[0].sum(), sums[1] / sums[1].sum(1, keepdims=True), sums[2] / sums[2].sum(1, keepdims=True), others)
    return model


def score_texts(docs: DataFrame, folds: int = 5, held_fold: int = 1, states: int = 8, vocabulary: int = 8192, common_words: int = 131_072, rounds: int = 3) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Word counts and the model come from all rows whose crc32(doc_id) mod ``folds`` is not ``held_fold``. Each
    text is scored whole. Counts of the ``common_words`` most frequent words (a bound) go to the tasks; rarer
    words are joined with the table of counts, one row for each text and word, and only add up per text.

    A null text counts as empty: the end token alone. Rows with equal or null doc_id are each scored. An
    empty table yields no rows; without training rows every token is unknown.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), (crc_bucket("doc_id", folds) == held_fold).alias("held_out"))
    training = marked.where(~F.col("held_out"))
    counts = materialize(count_words(training), "word-counts")
    n_tokens, n_words = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    common = most_frequent(counts, common_words)
    model = train(training, common, n_tokens, n_words, states, vocabulary, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((common, model))
    base = n_tokens + 0.5 * (n_words + 1)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        common, model = shared.value
        other = len(model.vocabulary)
        index = model.vocabulary | {w: other + i for i, w in enumerate(w for w in common if w not in model.vocabulary)}
        logs = np.array([*(np.log10(common[w] + 0.5) for w in index), 0.0])  # the last for rare words, numbered -1
        row = TaskContext.get().partitionId() << 33
        for rows in parts:
            for at in range(0, len(rows), 4000):
                part = rows.iloc[at : at + 4000]
                sequences, sums, of, rare, times = [], [], [], [], []
                for text in part["text"]:
                    words = words_of(text)
                    ids = numbered(words, index, -1)
                    outside, each = (ids < 0) | (ids >= other), logs[ids]
                    sequences.append(np.where(outside, other, ids))
                    unknown = Counter([words[i] for i in np.flatnonzero(ids < 0).tolist()])
                    of.extend([row] * len(unknown))
                    rare.extend(unknown)
                    times.extend(unknown.values())
                    sums.append((row, len(words), len(words) - unknown.total(), each.sum(), each[outside].sum(), int(outside.sum())))
                    row += 1
                likely = log10_likelihood(sequences, model)
                a = pd.DataFrame(sums, columns=["row", "n_tokens", "n_known", "logsum", "inner", "n_other"])
                yield a.assign(doc_id=part["doc_id"].to_numpy(), held_out=part["held_out"].to_numpy(), likely=likely, word=None, times=0)[COLUMNS]
                if of:
                    b = pd.DataFrame({"row": of, "word": as_text(rare), "times": times})
                    yield b.assign(doc_id=None, held_out=None, n_tokens=0, n_known=0, logsum=0.0, inner=0.0, n_other=0, likely=0.0)[COLUMNS]

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logsum double, inner double, n_other long, likely double, word string, times long"
    parts = materialize(marked.mapInPandas(score, schema), "scores")
    found = parts.where("word is not null").select("row", "word", "times").join(counts, "word", "left")
    rare = found.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"))
    whole = parts.where("word is null").join(rare, "row", "left").fillna({"more_known": 0, "more": 0.0})
    others = F.lit(float(np.log10(model.others)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("logsum") + F.col("more") - F.col("n_tokens") * float(np.log10(base))).alias("base_score"),
        (F.col("likely") + F.col("inner") + F.col("more") - F.col("n_other") * others).alias("score"),
    )


COLUMNS = ["row", "doc_id", "held_out", "n_tokens", "n_known", "logsum", "inner", "n_other", "likely", "word", "times"]
