"""Operator 6: language-model scores by online logistic context mixing.

The lower-cased text (A-Z) is a sequence of words and an end mark. A token is told by a few bits, each predicted by
mixing: did the two words before it ever precede it in training; if not, did the one word before it; if not, is it
known at all. Where the answer is yes, its share of what followed the same words names it. A word that training does
not know is spelt, bit by bit of its bytes.

* **What followed what** is counted for all texts, words, pairs and triples alike, and grows with the input: texts are
  dealt into chunks of ``CHUNK_BYTES``; a chunk sends each hash range the sorted hashes of its distinct n-grams and
  how often training texts of it hold them, as one row; a range adds up the chunks and answers each with the totals.
  So a frequent n-gram is one entry of a chunk's row, and no key is hot. Training texts are scored without their own
  occurrence.
* **Bits** are predicted from zeros and ones counted in hashed contexts: how often the words before were seen, the word
  before, how the last four tokens were told, how long the text has been following known triples. Their stretched
  predictions are combined by weights that are gated by the question and the last answer and depend on each
  predictor's confidence. Tables and weights are learned online, for each chunk from all of its training texts in the
  order of id and text, so that they depend on the table alone and not on the order or the partitions of its rows; the
  chunks' tables are added and their weights averaged; the result is refined by an adaptive table.
* **Spelling** mixes the contexts of the last 1 to 4 bytes in the same manner, learned from all training words that
  occur once. Only models of fixed size are collected and broadcast (about 10 MB).

Pairs and triples are known by hashes of ten bits more than the texts' bytes need, so that about one in four thousand
counts too much; words by 64 bits. White space is not
scored, as in the base. A text's score is the sum over its tokens.

Defined results: a null text is scored as an empty one, which is one end mark; without training rows every bit
has probability one half; repeated rows get equal scores; rows without id are scored like others; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from math import ceil, log10

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import cut

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
CHUNK_BYTES = 8 << 20
GRAMS_PER_RANGE = 3_000_000
CONFIDENCES = 16
PRIOR = 0.4  # added to the zeros and ones of every context
RATE = 0.05
REFINED = 33  # steps of the refinement table, over stretched predictions from -8 to 8
TOKENS_AT_ONCE = 20_000
WORDS_AT_ONCE = 1000
LEARN_BYTES = 32 << 20  # told texts of one learning task
WORD_BITS = 8  # of the hashed word before
HASH_BITS = 10  # of hashes of pairs and triples, beyond the logarithm of the texts' bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them evenly."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def words_of(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, one after the other, each by its place among the distinct ones; and how many each text has."""
    whole = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([b"", *whole, b""]).translate(LOWER), np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))  # the first and the last byte are spaces
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    offsets = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    edges = np.cumsum([1] + [len(w) + 1 for w in whole])
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, edges))


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).data)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack_planes(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest one needs, all first bytes together; the first byte is that number."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + _pack(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _unpack_planes(data: bytes) -> np.ndarray:
    planes = _unpack(data[1:], np.uint8).reshape(data[0], -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : data[0]] = planes.T
    return values.view("<u8").ravel().astype(np.uint64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack_planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack_planes(data), dtype=np.uint64)


@dataclass
class Chunk:
    """The tokens of some texts as hashes, with those of the two tokens before each."""

    texts: list[str | None]
    bits: int  # of the hashes of pairs and triples

    def __post_init__(self) -> None:
        found, many = words_of(self.texts)
        self.words = found.dictionary.to_pylist()
        self.names = np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words)), END)
        self.size = many.astype(np.int64) + 1
        self.start = np.cumsum(self.size) - self.size
        n = int(self.size.sum())
        self.doc = np.repeat(np.arange(len(many)), self.size)
        self.place = np.full(n, -1)  # of the word among the chunk's; -1 for the end
        inside = np.arange(n) - self.start[self.doc]
        self.place[inside < self.size[self.doc] - 1] = found.indices.to_numpy()
        self.one = self.names[self.place]
        before = [np.where(inside >= k, np.roll(self.one, k), START) for k in (1, 2)]
        keep = np.uint64(64 - self.bits)
        self.context = before[0]
        pair = mix(before[0] * np.uint64(3) + mix(self.one))
        triple = mix(mix(before[1] * np.uint64(5) + before[0]) * np.uint64(7) + self.one)
        self.two, self.three = pair >> keep, triple >> keep
        self.first, self.second = inside == 0, inside == 1

    def word_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the words and the end, and where each token's is."""
        keys, at = np.unique(self.names, return_inverse=True)
        return keys, at[self.place]

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted distinct hashes of the words, and of pairs and triples; and where each token's are: hashes x tokens."""
        words, at = self.word_table()
        keys, both = np.unique(np.concatenate([self.two, self.three]), return_inverse=True)
        return [(words, at[None, :]), (keys, both.reshape(2, -1))]

    def counted(self, learn: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The hashes of ``tables``, and how many of the tokens for which ``learn`` holds have each."""
        words, at = self.word_table()
        both = np.concatenate([self.two, self.three])
        if self.bits < 64:  # a bit is free for the mark: the hashes are sorted alone, without their tokens
            both = np.sort((both << np.uint64(1)) | np.tile(learn, 2).astype(np.uint64))
            mark, both = both & np.uint64(1), both >> np.uint64(1)
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
            keys, counts = both[first], np.add.reduceat(mark, first) if len(first) else mark
        else:
            keys, places = np.unique(both, return_inverse=True)
            counts = np.bincount(places[np.tile(learn, 2)], minlength=len(keys))
        return [(words, np.bincount(at[learn], minlength=len(words))), (keys, counts)]


GRAMS = "range int, chunk long, kind int, keys binary, counts binary"
TOTALS = "chunk long, range int, kind int, totals binary, distinct long"


def _ranges(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each range of the sorted keys begins, and the end."""
    edges = [((i << bits) + ranges - 1) // ranges for i in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def _sent(bits: int, ranges: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        chunk, rows = Chunk(frame["text"].tolist(), bits), []
        learn = frame["learn"].to_numpy(bool)[chunk.doc]
        for kind, (keys, counts) in enumerate(chunk.counted(learn)):
            counts = counts.astype(np.uint32)
            edges = _ranges(keys, bits if kind else 64, ranges)
            rows += [(r, key[0], kind, _pack_sorted(keys[a:z]), _pack_planes(counts[a:z])) for r, (a, z) in enumerate(zip(edges, edges[1:], strict=False)) if a < z]
        return pd.DataFrame(rows, columns=["range", "chunk", "kind", "keys", "counts"])

    return run


def _added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Totals of a range for every chunk, and the number of its distinct training words in a row without a chunk."""
    rows, distinct = [], 0
    for kind, part in frame.groupby("kind"):
        keys = [_unpack_sorted(k) for k in part["keys"]]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([_unpack_planes(c) for c in part["counts"]]))
        ends = np.cumsum([len(k) for k in keys])
        told = np.split(total[at].astype(np.int64), ends[:-1])
        rows += [(c, key[0], kind, _pack_planes(t), None) for c, t in zip(part["chunk"], told, strict=True)]
        distinct += int((total > 0).sum()) if kind == 0 else 0
    rows.append((-1 - key[0], key[0], 0, None, distinct))
    return pd.DataFrame(rows, columns=["chunk", "range", "kind", "totals", "distinct"]).astype({"distinct": "Int64"})


TOLD = (
    "doc_id long, learn boolean, n_tokens long, n_known long, log_counts double, named double, n_single long, "
    "n_bytes long, facts binary, spelt binary, chunk long, distinct long"
)


def _level(counts: np.ndarray) -> np.ndarray:
    return np.minimum(15, np.log2(np.maximum(counts, 0) + 1).astype(np.int64) + (counts > 0))


def _told(bits: int, ends: int):
    """Cogrouped texts and totals of a chunk: how each token is told, and the sums for the base score."""

    def run(docs: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame([{"distinct": d} for d in totals["distinct"].dropna()], columns=[c.split()[0] for c in TOLD.split(", ")])
        number = docs["chunk"].iloc[0]
        docs = docs.sort_values(["doc_id", "text", "learn"], na_position="first", ignore_index=True)
        chunk = Chunk(docs["text"].tolist(), bits)
        learn = docs["learn"].to_numpy(bool)
        own = learn[chunk.doc].astype(np.int64)
        counts = []
        for kind, (_, at) in enumerate(chunk.tables()):
            part = totals[totals["kind"] == kind].sort_values("range")
            total = np.concatenate([_unpack_planes(t) for t in part["totals"]]).astype(np.int64)
            counts += [total[a] for a in at]
        c1, c2, c3 = counts
        # what followed the words before: the word's own count, the pair's own count
        seen2, seen3 = np.where(chunk.first, ends, np.roll(c1, 1)) - own, np.where(chunk.first, 0, np.roll(c2, 1) - own)
        d1, d2, d3 = c1 - own, c2 - own, c3 - own
        by3 = (seen3 > 0) & (d3 > 0)
        by2 = ~by3 & (seen2 > 0) & (d2 > 0)
        by1 = ~by3 & ~by2 & (d1 > 0)
        answer = np.where(by3, 3, np.where(by2, 2, np.where(by1, 1, 0)))
        share = np.where(by3, seen3 / np.maximum(d3, 1), np.where(by2, seen2 / np.maximum(d2, 1), np.where(by1, 1 / np.maximum(d1, 1), 1)))
        named = np.log2(np.maximum(share, 1e-30))
        facts = np.empty((len(c1), 2), np.uint16)
        facts[:, 0] = _level(seen3) | (_level(seen2) << 4) | (answer << 8)
        facts[:, 1] = mix(chunk.context) >> np.uint64(64 - WORD_BITS)
        spelt = (answer == 0) & (chunk.place >= 0)
        doc, n = chunk.doc, len(docs)

        def each(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, x, n)

        at = np.flatnonzero(spelt)
        cuts = np.searchsorted(doc[at], np.arange(n + 1))
        words = [chunk.words[p] for p in chunk.place[at].tolist()]
        edges = [*chunk.start.tolist(), len(c1)]
        return pd.DataFrame(
            {
                "doc_id": docs["doc_id"].to_numpy(), "learn": learn, "n_tokens": chunk.size, "n_known": each(c1 > 0).astype(np.int64),
                "log_counts": each(np.log10(c1 + 1)), "named": each(named), "n_single": each(by1).astype(np.int64),
                "n_bytes": [len((t or "").encode("utf-8", "replace")) for t in docs["text"]],
                "facts": [_pack(facts[a:z].T) for a, z in zip(edges, edges[1:], strict=False)],
                "spelt": [b" ".join(words[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)],
                "chunk": number,
                "distinct": pd.array([None] * n, "Int64"),
            }
        )

    return run


def stretch(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the odds of a one, and the confidence."""
    prior = np.float32(PRIOR)
    confidence = np.minimum(CONFIDENCES - 1, np.log2(zeros + ones + np.float32(1)).astype(np.int64))
    return np.log((ones + prior) / (zeros + prior)), confidence


@dataclass
class Mixer:
    """Zeros and ones of all contexts, mixing weights by gate, predictor and confidence, and the refinement table."""

    contexts: int
    predictors: int
    gates: int
    counts: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    squares: np.ndarray = field(init=False)
    refined: np.ndarray = field(init=False)
    mass: float = 0.0
    told: tuple | None = None

    def __post_init__(self) -> None:
        self.counts = np.zeros((self.contexts, 2), np.float32)
        self.weights = np.full(self.gates * self.predictors * CONFIDENCES, 1.5 / self.predictors, np.float32)
        self.squares = np.full(len(self.weights), 1e-8)
        self.refined = np.zeros((self.gates * REFINED, 2))

    def stretched(self, without: bool) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and confidences of all contexts; ``without``: twice, without one of their zeros, and
        without one of their ones. They are kept until the counts change."""
        if self.told is None or self.told[0] is not self.counts or self.told[1] != without:
            zeros, ones = np.ascontiguousarray(self.counts.T)
            pairs = ((np.maximum(0, zeros - 1), ones), (zeros, np.maximum(0, ones - 1))) if without else ((zeros, ones),)
            parts = [(s, c.astype(np.int8)) for s, c in (stretch(*p) for p in pairs)]
            self.told = (self.counts, without, *map(np.concatenate, zip(*parts, strict=True)))
        return self.told[2:]

    def inputs(self, places: np.ndarray, gate: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched predictions, places of their weights, and the mixed logit; ``own``: bits to be left out of the counts."""
        stretched, confidence = self.stretched(own is not None)
        if own is not None:
            places = places + own.astype(np.int64) * self.contexts
        s, c = stretched[places], confidence[places]
        at = (gate * self.predictors + np.arange(self.predictors)[:, None]) * CONFIDENCES + c
        return s, at, np.clip((self.weights[at] * s).sum(axis=0), -16, 16)

    def learn(self, places: np.ndarray, gate: np.ndarray, bit: np.ndarray, count: bool) -> None:
        """An online step over some bits; ``count``: the tables have not counted them yet, else they leave them out."""
        s, at, logit = self.inputs(places, gate, None if count else bit)
        wrong = (bit - 1 / (1 + np.exp(-logit))) / max(1, len(bit))
        push = np.bincount(at.ravel(), (wrong * s).ravel(), len(self.weights))
        self.squares += push**2
        self.weights += (RATE * push / np.sqrt(self.squares)).astype(np.float32)
        np.add.at(self.refined.reshape(-1), (gate * REFINED + self.steps(logit)) * 2 + bit.astype(np.int64), 1.0)
        if count:
            self.count(places, bit)
        self.mass += len(bit)

    def count(self, places: np.ndarray, bit: np.ndarray) -> None:
        flat = (places * 2 + bit.astype(np.int64)).ravel()
        self.counts = self.counts + np.bincount(flat, minlength=self.counts.size).astype(np.float32).reshape(-1, 2)

    @staticmethod
    def steps(logit: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((logit + 8) * ((REFINED - 1) / 16)), 0, REFINED - 1).astype(np.int64)

    def bits(self, places: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """What each bit costs."""
        _, _, logit = self.inputs(places, gate)
        middle = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, REFINED))), self.gates)
        # where little was seen, a step stands for its own middle
        table = (self.refined[:, 1] + 8 * middle) / (self.refined.sum(axis=1) + 8)
        one = (1 / (1 + np.exp(-logit)) + table[gate * REFINED + self.steps(logit)]) / 2
        return -np.log2(np.clip(np.where(bit > 0, one, 1 - one), 1 / 65536, 1))

    def rows(self, *kinds: str) -> pd.DataFrame:
        """What a task learned, to be added up over the tasks."""
        parts = []
        for kind, (name, a, b) in enumerate((("counts", *self.counts.T), ("weights", self.weights * self.mass, np.full(len(self.weights), self.mass)), ("refined", *self.refined.T))):
            at = np.flatnonzero((a != 0) | (b != 0))
            if name in kinds:
                parts.append(pd.DataFrame({"kind": np.int32(kind), "at": at.astype(np.int32), "a": a[at].astype(float), "b": b[at].astype(float)}))
        return pd.concat(parts)

    def add(self, learned: DataFrame) -> None:
        """The tasks' rows, added up; they fit the fixed size of this model's tables."""
        summed = learned.groupBy("kind", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        for r in summed.mapInPandas(_columns, "kind binary, at binary, a binary, b binary").collect():
            kind, at, a, b = (_unpack(x, t) for x, t in zip(r, (np.int32, np.int32, float, float), strict=True))
            for k, table in ((0, self.counts), (2, self.refined)):
                table[at[kind == k]] = np.column_stack([a, b])[kind == k]
            self.told = None
            self.weights[at[kind == 1]] = (a / np.maximum(b, 1e-9))[kind == 1]


ROWS = "kind int, at int, a double, b double"


def _columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = list(batches)
    if frames:
        f = pd.concat(frames)
        yield pd.DataFrame({c: [_pack(f[c].to_numpy(t))] for c, t in (("kind", np.int32), ("at", np.int32), ("a", float), ("b", float))})


#: Hashed contexts of a question: how often the words before were seen; the word before; the last four answers; the
#: length of the present run of known triples; the word before and the last answer.
ASKED_SIZES = (256, 1 << WORD_BITS, 256, 256, 1 << WORD_BITS)
ASKED_FROM = tuple(3 * sum(ASKED_SIZES[:k]) for k in range(len(ASKED_SIZES)))


def asked_mixer() -> Mixer:
    return Mixer(3 * sum(ASKED_SIZES), len(ASKED_SIZES), 12)


def questions(facts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, gates, answers and texts of the questions that tell the tokens of some texts."""
    size = np.array([f.shape[1] for f in facts], np.int64)
    start, doc = np.cumsum(size) - size, np.repeat(np.arange(len(facts)), size)
    both = np.concatenate(facts, axis=1).astype(np.int64)
    level3, level2, answer, word = both[0] & 15, (both[0] >> 4) & 15, both[0] >> 8, both[1]
    place = np.arange(len(doc))
    inside = place - start[doc]
    past = [np.where(inside >= k, np.roll(answer, k), 0) for k in (1, 2, 3, 4)]
    last_other = np.maximum.accumulate(np.where((answer != 3) | (inside == 0), place, 0))
    run = np.where(past[0] == 3, np.minimum(15, place - np.roll(last_other, 1)), 0)
    history = past[0] | (past[1] << 2) | (past[2] << 4) | (past[3] << 6)
    values = (level3 | (level2 << 4), word, history, run | (level3 << 4), (word ^ (past[0] * 0x1357)) & ((1 << WORD_BITS) - 1))
    masks = (level3 > 0, (answer < 3) & (level2 > 0), answer < 2)
    at = [np.flatnonzero(m) for m in masks]
    asked = np.concatenate(at)
    kind = np.repeat(np.arange(3), [len(a) for a in at])
    places = np.stack([ASKED_FROM[k] + kind * ASKED_SIZES[k] + v[asked] for k, v in enumerate(values)])
    return places, kind * 4 + past[0][asked], (answer[asked] == 3 - kind).astype(np.float32), doc[asked]


#: Bits of the tables of a word's last 1 to 4 bytes: the contexts of so few bytes need no more, whatever the corpus.
ORDERS = ((1, 16), (2, 18), (3, 20), (4, 20))


def spelling_mixer() -> Mixer:
    return Mixer(sum(1 << b for _, b in ORDERS), len(ORDERS), 8)


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, gates and bits of the bytes of some words and the space after each, 8 x byte, and where words begin.

    Sixteen neighbouring places belong to a context, for the four bits of half a byte; the second half has a block
    of its own for each first half."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    inside = np.arange(len(data)) - np.repeat(start, size)
    shift, low = np.arange(8)[:, None], np.arange(4)[:, None]
    byte = data.astype(np.int64)
    offset = np.concatenate([((1 << shift) | (byte >> (8 - shift)))[:4], (1 << low) | ((byte & 15) >> (4 - low))])
    second = ((data >> np.uint64(4)) + np.uint64(1)) * np.uint64(0x5BD1E9955BD1E995)
    past, places, origin = np.zeros_like(data), [], 0
    for k, bits in ORDERS:
        before = np.zeros_like(data)
        before[k:] = data[:-k] + np.uint64(1)
        before[inside < k] = 0
        past = past | (before << np.uint64(9 * (k - 1)))
        name = mix(past + np.uint64(k))
        first, rest = ((mix(x) >> np.uint64(68 - bits)).astype(np.int64) << 4 for x in (name, name ^ second))
        places.append(origin + (np.repeat(np.stack([first, rest]), 4, axis=0) | offset))
        origin += 1 << bits
    gate = np.broadcast_to(np.arange(8)[:, None], offset.shape)
    return np.stack(places), gate, ((byte >> (7 - shift)) & 1).astype(np.float32), start


def _split(spelt: bytes) -> list[bytes]:
    return spelt.split(b" ") if spelt else []


def _by_chunk(batches: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[int, bytes]]:
    """The values of a column with the number of their chunk, whose rows come together and in their order."""
    for batch in batches:
        yield from zip(batch["chunk"].tolist(), batch[column], strict=True)


def _word_pieces(rows: Iterable[tuple[int, bytes]]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    for _, spelt in rows:
        held += _split(spelt)
        while len(held) >= WORDS_AT_ONCE:
            yield held[:WORDS_AT_ONCE]
            held = held[WORDS_AT_ONCE:]
    if held:
        yield held


def _flat(places: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return places.reshape(len(places), -1), gate.ravel(), bit.ravel()


def _count_spelling(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own = spelling_mixer()
    counts = np.zeros(own.counts.size)
    for words in _word_pieces(_by_chunk(batches, "spelt")):
        places, _, bit, _ = spelling(words)
        np.add.at(counts, (places * 2 + bit.astype(np.int64)).ravel(), 1.0)  # of the counts' kind: others are added slowly
    own.counts = counts.reshape(-1, 2)
    yield own.rows("counts")


def _learn_spelling(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = None
        for _, rows in groupby(_by_chunk(batches, "spelt"), key=lambda r: r[0]):
            own = spelling_mixer()
            own.counts, own.told = shared.value, told
            for words in _word_pieces(rows):
                places, gate, bit, _ = spelling(words)
                own.learn(*_flat(places, gate, bit), count=False)
            told = own.told  # the next chunk's counts are the same
            if own.mass:
                yield own.rows("weights", "refined")

    return run


def _learn_asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, rows in groupby(_by_chunk(batches, "facts"), key=lambda r: r[0]):
        own, held, tokens = asked_mixer(), [], 0
        for _, packed in rows:
            held.append(_unpack(packed, np.uint16).reshape(2, -1))
            tokens += held[-1].shape[1]
            if tokens >= TOKENS_AT_ONCE:
                own.learn(*questions(held)[:3], count=True)
                held, tokens = [], 0
        if held:
            own.learn(*questions(held)[:3], count=True)
        if own.mass:
            yield own.rows("counts", "weights", "refined")


@dataclass
class Model:
    asked: Mixer
    spelling: Mixer

    def bits(self, facts: list[np.ndarray], spelt: list[bytes]) -> np.ndarray:
        """What the questions and the spelling of each text cost."""
        total = np.zeros(len(facts))
        low = 0
        while low < len(facts):
            high, tokens = low, 0
            while high < len(facts) and (high == low or tokens + facts[high].shape[1] <= TOKENS_AT_ONCE):
                tokens += facts[high].shape[1]
                high += 1
            places, gate, bit, doc = questions(facts[low:high])
            total[low:high] += np.bincount(doc, self.asked.bits(places, gate, bit), high - low)
            low = high
        words = [_split(s) for s in spelt]
        doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = [x for w in words for x in w]
        for i in range(0, len(flat), WORDS_AT_ONCE):
            places, gate, bit, start = spelling(flat[i : i + WORDS_AT_ONCE])
            cost = self.spelling.bits(*_flat(places, gate, bit)).reshape(8, -1).sum(axis=0)
            np.add.at(total, doc[i : i + WORDS_AT_ONCE], np.add.reduceat(cost, start))
        return total


def fit(told: DataFrame, size: int) -> Model:
    """The model of the told training texts (facts, spelt), which hold ``size`` bytes; learned in tasks whose number grows with them."""
    sc, tasks = told.sparkSession.sparkContext, max(1, ceil(size / LEARN_BYTES))
    model, rows = Model(asked_mixer(), spelling_mixer()), told.filter("learn").select("facts", "spelt", "chunk")
    asked, spelt = rows.select("facts", "chunk").coalesce(tasks), rows.select("spelt", "chunk").filter(F.octet_length("spelt") > 0).coalesce(tasks)
    model.asked.add(asked.mapInPandas(_learn_asked, ROWS))
    model.spelling.add(spelt.mapInPandas(_count_spelling, ROWS))
    shared = sc.broadcast(model.spelling.counts)
    model.spelling.add(spelt.mapInPandas(_learn_spelling(shared), ROWS))
    shared.unpersist()
    return model


def tell(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """How every token of every text is told (schema ``TOLD``, checkpointed), and the bytes of the texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    volume = rows.agg(F.sum(F.octet_length("text") + 1).alias("bytes"), F.sum(F.col("learn").cast("long")).alias("ends")).first()
    size, ends = volume.bytes or 0, volume.ends or 0
    chunks, ranges = max(1, ceil(size / CHUNK_BYTES)), max(1, ceil(size / 3 / GRAMS_PER_RANGE))
    bits = min(64, size.bit_length() + HASH_BITS)

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(chunks))).repartition(partitions, "chunk")
    sent = dealt.groupBy("chunk").applyInPandas(_sent(bits, ranges), GRAMS)
    totals = sent.groupBy("range").applyInPandas(_added, TOTALS)
    told = cut(dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInPandas(_told(bits, ends), TOLD))
    return told, size


def lm_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learn, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; learned from the rows for which ``learn`` holds."""
    told, size = tell(docs, learn, id_col, text_col)
    texts = told.filter("distinct IS NULL")
    totals = told.agg(F.sum(F.when(F.col("learn"), F.col("n_tokens"))).alias("n"), F.sum("distinct").alias("v")).first()
    tokens, distinct = totals.n or 0, totals.v or 0
    model = fit(texts, size)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cost = shared.value.bits([_unpack(f, np.uint16).reshape(2, -1) for f in batch["facts"]], batch["spelt"].tolist())
            one = np.log2(np.maximum(1, tokens - batch["learn"].to_numpy(bool)))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "learn": batch["learn"], "n_tokens": batch["n_tokens"], "n_known": batch["n_known"], "train_tokens": tokens,
                    "base_score": batch["log_counts"] - batch["n_tokens"] * log10(tokens + distinct + 1),
                    "score": -(cost + batch["named"] + batch["n_single"] * one) * log10(2),
                    "n_bytes": batch["n_bytes"],
                }
            )

    result = texts.mapInPandas(score, "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    return result.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.greatest(F.lit(1), F.col("n_bytes"))).drop("n_bytes")
