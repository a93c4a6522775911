"""Periodic runs of words in whole texts by divide and conquer, with Z-functions at the midpoints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are handled together up to this many bytes; a longer text is handled by itself.
TOGETHER = 2_000_000

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _agreement(a: np.ndarray, i: int, j: int) -> int:
    """In how many places from i and from j on (i < j) ``a`` agrees with itself."""
    n, step = 0, 16
    while j + n < len(a):
        differ = a[i + n : i + n + min(step, len(a) - j - n)] != a[j + n : j + n + step]
        at = int(differ.argmax())
        if differ[at]:
            return n + at
        n, step = n + len(differ), min(step * 2, 65536)
    return n


def z_function(a: np.ndarray) -> np.ndarray:
    """For each place the length of the longest stretch from there on that begins ``a`` too.

    Lengths below four are told for all places at once. Inside a longer stretch from i on, which repeats the beginning,
    longer ones are copied from there, many at a time, up to the first that reaches the stretch's end, from where
    words are compared again. A stretch longer than i has period i; at its multiples the lengths end where it ends.
    """
    n, z = len(a), np.zeros(len(a), np.int64)
    if not n:
        return z
    starts = np.flatnonzero(a == a[0])
    for k in range(1, 4):
        z[starts] = k
        starts = starts[: np.searchsorted(starts, n - k)]
        starts = starts[a[starts + k] == a[k]] if k < n else starts[:0]
    z[0] = n
    k, right = int(len(starts) > 0), 0
    while k < len(starts):
        i = int(starts[k])
        known = max(0, right - i)
        right = i + known + _agreement(a, known, i + known)
        z[i] = right - i
        k, size = k + 1, 64
        while k < len(starts) and starts[k] < right:
            place = starts[k : k + size]
            place = place[: place.searchsorted(right)]
            room, again = right - place, place % i
            copied = np.where(again == 0, room, z[again])
            open_ = (copied >= room) & (again > 0) if right < n else np.zeros(len(place), bool)
            stop = int(open_.argmax()) if open_.any() else len(place)
            z[place[:stop]] = np.minimum(copied, room)[:stop]
            k, size = k + stop, min(size * 4, 65536)
            if stop < len(place):
                break
    return z


def crossing(a: np.ndarray, low: int, middle: int, high: int, rightwards: bool, leftwards: bool) -> Runs:
    """(start, end, period) of the repetitions inside [low, high) that hold the words on both sides of ``middle``,
    by period: with a whole period to the right of it (``rightwards``), or to the left. Periods need not be the
    smallest ones."""
    left, right = a[low:middle], a[middle:high]
    found = []
    if rightwards:
        q = np.arange(1, len(right) + 1)
        ahead = np.append(z_function(right), 0)[1:]  # how long the right part agrees with itself moved by q
        back = z_function(np.concatenate([left[::-1], a[low:high][::-1]]))[len(left) :][::-1]  # by last word
        found.append((middle - np.minimum(back[middle - low + q - 1], len(left)), middle + q + ahead, q))
    if leftwards:
        q = np.arange(1, len(left) + 1)
        behind = np.append(z_function(left[::-1]), 0)[1:]
        onward = z_function(np.concatenate([right, a[low:high]]))[len(right) :]
        found.append((middle - q - behind, middle + np.minimum(onward[middle - low - q], len(right)), q))
    start, end, q = (np.concatenate(x) for x in zip(*found, strict=True))
    across = (start < middle) & (end > middle)
    return start[across], end[across], q[across]


class _Stretches:
    """Numbers for the stretches of 1, 2, 4, ... words from each place on, to see quickly where a long stretch may
    come again: equal stretches have equal numbers, and hardly ever do others."""

    def __init__(self, a: np.ndarray, least_words: int, least_periods: int):
        q = np.arange(1, least_words + 1)
        sure = np.maximum(least_words / 2 - q, (least_periods / 2 - 1) * q).min()
        number = a.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
        self.by_width, width = {1: number}, 1
        while width < 32:
            mixed = number * np.uint64(0x9E3779B97F4A7C15)
            mixed[:-width] ^= number[width:] >> np.uint64(31) ^ number[width:] * np.uint64(0xC2B2AE3D27D4EB4F)
            number, width = mixed ^ mixed >> np.uint64(29), width * 2
            self.by_width[width] = number
        self.base = max(w for w in self.by_width if w <= max(1, sure))
        self.least_words, self.least_periods = least_words, least_periods

    def met_again(self, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each midpoint, whether the words from it on come again before ``high``, as far as they must if the
        longer part of a run lies there: a run of period q has half its words or more on that side, and all of
        those but q agree with the words q places on."""
        sizes = high - middle
        owner = np.repeat(np.arange(len(middle)), sizes)
        q = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        number = self.by_width[self.base]
        same = np.flatnonzero((number[middle[owner] + q] == np.repeat(number[middle], sizes)) & (q > 0))
        owner, q = owner[same], q[same]
        must = np.maximum(self.least_words / 2 - q, (self.least_periods / 2 - 1) * q)
        alike = np.ones(len(q), bool)
        for width, number in self.by_width.items():
            if width > self.base:
                long = np.flatnonzero((must >= width) & alike)
                at = middle[owner[long]]
                alike[long] = number[at] == number[at + q[long]]
        out = np.zeros(len(middle), bool)
        out[owner[alike]] = True
        return out


def find_runs(a: np.ndarray, bounds: np.ndarray, least_words: int = 24, least_periods: int = 3) -> Runs:
    """(start, end, period) of all runs of the texts in ``a``, words' numbers of one text after the other, cut at
    ``bounds``; by start, then period. A run is a stretch with smallest period q, of ``least_words`` words and
    ``least_periods`` (3 or more) times q at least, that no word beside it continues.

    Texts are halved again and again, all of them at a time. At a midpoint the Z-functions of both sides give the
    repetitions across it for each period. One that goes on beyond the part looked at is left out: it crosses the
    midpoint that bounds the part, and is found whole there. Z-functions are computed only where the words at the
    midpoint come again on one side, as they do in any run across it. A run of period p holds other runs only if they
    are shorter than p and their own period together, so parts inside one whose period is too short for that are
    left. Of equal intervals the least period stays: that is the smallest period, as an interval of three periods or
    more with any period has its smallest one, too.
    """
    if least_periods < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    least_words = max(least_words, least_periods)
    n = len(a)
    forward, backward = _Stretches(a, least_words, least_periods), _Stretches(a[::-1], least_words, least_periods)
    low, high = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    first, last = low, high
    found: list[Runs] = [(np.zeros(0, np.int64),) * 3]
    while True:
        big = high - low >= least_words
        low, high, first, last = low[big], high[big], first[big], last[big]
        if not len(low):
            break
        middle = (low + high) // 2
        ahead, behind = forward.met_again(middle, high), backward.met_again(n - middle, n - low)
        for i in np.flatnonzero(ahead | behind):
            s, e, q = crossing(a, int(low[i]), int(middle[i]), int(high[i]), bool(ahead[i]), bool(behind[i]))
            long = (e - s >= least_words) & (e - s >= least_periods * q)
            s, e, q = s[long], e[long], q[long]
            before, after = np.maximum(s - 1, 0), np.minimum(e, n - 1)
            more = (s == low[i]) & (s > first[i]) & (a[before] == a[before + q])
            more |= (e == high[i]) & (e < last[i]) & (a[after] == a[after - q])
            found.append((s[~more], e[~more], q[~more]))
        low, high = np.stack([low, middle], 1).ravel(), np.stack([middle, high], 1).ravel()
        first, last = np.repeat(first, 2), np.repeat(last, 2)
        start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
        tight = np.flatnonzero(period * least_periods <= least_words * (least_periods - 1))
        tight = tight[np.argsort(start[tight], kind="stable")]
        if len(tight):
            at = np.searchsorted(start[tight], low, "right")
            open_ = np.append(0, np.maximum.accumulate(end[tight]))[at] < high
            low, high, first, last = low[open_], high[open_], first[open_], last[open_]
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


class _Numbers(dict):
    """A number for each word, given when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _runs_of(texts: list[bytes], least_words: int, least_periods: int) -> tuple[pa.Array, pa.Array]:
    """Runs of each text, and the texts without their repeated words."""
    words = [t.split() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    numbers = _Numbers()
    a = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(bounds[-1]))
    start, end, period = find_runs(a, bounds, least_words, least_periods)
    depth = np.zeros(len(a) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    repeated = np.cumsum(depth[:-1]) > 0
    left = []
    for ws, i, j in zip(words, bounds, bounds[1:], strict=False):
        gone = repeated[i:j]
        left.append(b" ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g] if gone.any() else ws))
    text = np.searchsorted(bounds, start, "right") - 1
    offsets = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
    parts = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - bounds[text], end - start, period)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(offsets, parts), pa.array(left, pa.binary()).view(pa.string())


def periodic_runs(docs: DataFrame, least_words: int = 24, least_periods: int = 3) -> DataFrame:
    """(doc_id, runs, collapsed) of each row of ``docs`` (doc_id, text): the periodic runs of its words, an array of
    (start, length, period) in words by start and then period, and the text without what they repeat.

    Words are what lies between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns, as they are
    written. A run is a stretch of ``least_words`` words and ``least_periods`` times its smallest period at least, that
    the word before or behind it does not continue. A word of a run behind its first period goes; those that stay are
    joined by one space. A null or empty text has no runs and an empty collapsed text. Each row is judged by itself,
    so repeated rows and null ids come back as they are; an empty table yields no rows. Other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(batch.column("bytes").to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, "right")))
                some = batch.slice(at, to - at)
                runs, left = _runs_of(some.column("text").cast(pa.binary()).to_pylist(), least_words, least_periods)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), runs, left], names=["doc_id", "runs", "collapsed"])
                at = to

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("bytes"))
    return rows.mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
