"""Operator 4: byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged across, so every such
pair marks a certain cut. Text is split into the vocabulary's pre-tokens, those are split at the certain cuts,
the fragments are encoded independently of each other (all fragments of a batch side by side in numpy), and the
results are concatenated. Distinct pre-tokens are encoded once for each worker while its bounded memory of them
lasts.

Defined results: a null text is encoded as an empty one (no tokens, decoded as the empty text); special strings
in a text become their token, as the vocabulary says; bytes that are no UTF-8 decode to U+FFFD; repeated rows get
equal answers; other columns are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import fresh

#: Fixed value: how byte-level vocabularies split a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens that a worker remembers; beyond that it forgets all and starts again.
REMEMBERED = 600_000
SLOTS = 1 << 20
NEVER = np.int32(2**31 - 1)


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by character."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _spread(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


@dataclass
class Vocabulary:
    token_bytes: list[bytes]  # by id
    merges: list[tuple[int, int, int]]  # left id, right id, merged id, by rank
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, ids = printable_bytes(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for text, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in text)
        for text, i in special.items():
            tokens[i] = text.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        return cls(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], special)

    @cached_property
    def byte_ids(self) -> np.ndarray:
        out = np.full(256, -1, np.int32)
        for i, t in enumerate(self.token_bytes):
            if len(t) == 1:
                out[t[0]] = i
        return out

    @cached_property
    def inside(self) -> np.ndarray:
        """256 x 256: whether a pair of bytes occurs inside some token."""
        out = np.zeros((256, 256), bool)
        specials = set(self.special.values())
        for i, t in enumerate(self.token_bytes):
            if i not in specials and len(t) > 1:
                b = np.frombuffer(t, np.uint8)
                out[b[:-1], b[1:]] = True
        return out

    @cached_property
    def merge_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing: the pair's key and its rank."""
        keys, ranks = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NEVER, np.int32)
        pairs = np.array([(a << 32) | b for a, b, _ in self.merges], np.int64)
        for rank, (key, at) in enumerate(zip(pairs.tolist(), _spread(pairs).tolist(), strict=True)):
            while keys[at] >= 0 and keys[at] != key:
                at = (at + 1) % SLOTS
            if keys[at] < 0:
                keys[at], ranks[at] = key, rank
        return keys, ranks

    @cached_property
    def merged(self) -> np.ndarray:
        return np.array([m for *_, m in self.merges] or [0], np.int32)

    @cached_property
    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes, and where each starts and how long it is."""
        size = np.array([len(t) for t in self.token_bytes], np.int64)
        return np.frombuffer(b"".join(self.token_bytes), np.uint8), np.cumsum(size) - size, size

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks = self.merge_table
        wanted = (left.astype(np.int64) << 32) | right
        at = _spread(wanted)
        out, open_ = np.full(len(wanted), NEVER, np.int32), None
        found = keys[at]
        hit = found == wanted
        out[hit] = ranks[at[hit]]
        open_ = np.flatnonzero(~hit & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % SLOTS
            found = keys[at[open_]]
            hit = found == wanted[open_]
            out[open_[hit]] = ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and how many each word has."""
    size = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    word_start = np.zeros(len(data), bool)
    word_start[(np.cumsum(size) - size)[size > 0]] = True
    cut = word_start.copy()
    cut[1:] |= ~v.inside[data[:-1], data[1:]]
    out = np.full(len(data), -1, np.int32)
    sym, at, frag = v.byte_ids[data], np.arange(len(data)), np.cumsum(cut) - 1
    while len(sym):
        pair = np.full(len(sym), NEVER, np.int32)
        together = np.flatnonzero(frag[:-1] == frag[1:])
        pair[together] = v.ranks(sym[together], sym[together + 1])
        first = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
        least = np.minimum.reduceat(pair, first)
        length = np.diff(np.append(first, len(sym)))
        done = np.repeat(least == NEVER, length)
        out[at[done]] = sym[done]
        best = np.repeat(least, length)
        chosen = np.flatnonzero((pair == best) & ~done)
        if len(chosen):  # of equal pairs that overlap, every second one from the left
            start = np.flatnonzero(np.concatenate([[True], np.diff(chosen) != 1]))
            run = np.arange(len(chosen)) - np.repeat(start, np.diff(np.append(start, len(chosen))))
            chosen = chosen[run % 2 == 0]
            sym = sym.copy()
            sym[chosen] = v.merged[pair[chosen]]
        keep = ~done
        keep[chosen + 1] = False
        sym, at, frag = sym[keep], at[keep], frag[keep]
    word = np.cumsum(word_start) - 1
    counts = np.zeros(len(words), np.int64)
    counts[size > 0] = np.bincount(word[out >= 0], minlength=int(word[-1]) + 1)
    return out[out >= 0], counts


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    shift = start - (np.cumsum(size) - size)
    return flat[np.repeat(shift, size) + np.arange(int(size.sum()))]


class Encoder(dict):
    """Pre-token -> its place in the arrays of known encodings."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.rx = vocabulary, regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in vocabulary.special) + ")") if vocabulary.special else None
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in self.v.special:
            self[s] = len(self)
        ids = np.array(list(self.v.special.values()), np.int32)
        self._learn(ids, np.ones(len(ids), np.int64))

    def _learn(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.size, self.flat = np.concatenate([self.size, counts]), np.concatenate([self.flat, ids])

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at

    def words(self, text: str) -> list[str]:
        if self.split is None or not self.split.search(text):
            return self.rx.findall(text)
        return [w for part in self.split.split(text) for w in ([part] if part in self.v.special else self.rx.findall(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > REMEMBERED:
            self._forget()
        places = [np.fromiter(map(self.__getitem__, self.words(t)), np.int64) for t in texts]
        if self.fresh:
            self._learn(*encode_words([w.encode("utf-8", "replace") for w in self.fresh], self.v))
            self.fresh = []
        return [_gather(self.flat, self.start[p], self.size[p]) for p in places]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    flat, start, size = v.pieces
    return _gather(flat, start[ids], size[ids]).tobytes().decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the text as little-endian unsigned 32-bit integers in a binary column, the last
    one; while the table has a column of the name ``out``, the name gets an underscore before it."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary)
        for texts in batches:
            yield pd.Series([i.astype("<u4").tobytes() for i in encoder.encode(texts.tolist())], dtype=object)

    return docs.withColumn(fresh(docs, out), encode.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its token ids spell, in a last column that is named as above."""

    @F.pandas_udf("string")
    def spell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([decode(np.frombuffer(i, "<u4"), vocabulary) for i in ids], dtype=object)

    return encoded.withColumn(fresh(encoded, out), spell.asNondeterministic()(F.col(ids_col)))
