"""Token ids of whole texts with a public tokenizer file, many texts at a time."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

_LOADED: dict[str, "PieceEncoder"] = {}


#: Letters, single digits and other signs as the tokenizer file splits them, for characters that no
#: normalisation but lower-casing touches. An apostrophe may begin a contraction and is left to the library.
RUN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: So many new runs are encoded as one text.
JOINED = 512
PLAIN = re.compile(r"[ \n!-&(-~À-ÖØ-öø-ÿ]*")


class PieceEncoder:
    """Ids of whole texts from a tokenizer that never joins text across a space or a line feed.

    Plain text is a row of runs of letters, digits or signs, which the tokenizer encodes each for itself; every
    other stretch between spaces and line feeds is encoded whole. The library encodes a run or stretch once,
    new runs many at a time as words of one text, and its ids are remembered, so a word costs a lookup whatever
    its case. ``limit`` bounds the memory: of a full table, only what the texts at hand hold is
    kept. Whether a tokenizer file behaves so is checked on load against the library's own
    result for a probe; if not, whole texts go to the library.
    """

    PROBE = "It's 12 o'clock, naïve  café's\nÉtude, (STRAßE) <|endoftext|> ﬁn é ́x \t  <|endoftext|>don't\n\n ΣΑΣ ǅ 3.14%%% a_b ~x~ WORD. Word! word?"

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.by_run = True
        self.by_run = self._encode([self.PROBE, "Plain_text: été, 3.14%%% ~x~\nSTRASSE!"]) == self._library([self.PROBE, "Plain_text: été, 3.14%%% ~x~\nSTRASSE!"])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, keys: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of each key. Runs are words of their own to the tokenizer, so a text of them costs a third of what
        they cost one by one; a text that it splits into another number of words is taken apart."""
        runs, rest = [], []
        for key in keys:
            (runs if RUN.fullmatch(key) else rest).append(key)
        groups = [runs[i : i + JOINED] for i in range(0, len(runs), JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            words = found.word_ids
            if None in words or max(words, default=-1) + 1 != len(group):
                rest += group
                continue
            ids, at = array("I", found.ids).tobytes(), 0
            for key, n in zip(group, np.bincount(words, minlength=len(group)).tolist(), strict=True):
                yield key, ids[at : at + 4 * n]
                at += 4 * n
        yield from zip(rest, self._library(rest), strict=True)

    @staticmethod
    def _runs(text: str) -> list[str]:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return RUN.findall(text.lower())
        keys: list[str] = []
        for piece in text.replace("\n", " ").split(" "):
            if PLAIN.fullmatch(piece) and "<|" not in piece:
                keys += RUN.findall(piece.lower())
            else:
                keys.append(piece)
        return keys

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_run:
            return self._library(texts)
        split = [self._runs(t) for t in texts]
        new = set().union(*(set(keys).difference(self.known) for keys in split))
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known = {k: self.known[k] for k in set().union(*split) - new}
            self.known.update(self._new(list(new)))
        return [b"".join(map(self.known.__getitem__, keys)) for keys in split]

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last."""
        end = array("I", [end_id]).tobytes()
        return [x + end for x in self._encode(texts)]


def encoder(path: str) -> PieceEncoder:
    """The process's encoder for a file; Python workers are used again by later tasks."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
