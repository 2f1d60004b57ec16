"""Operator 11: quality of whole texts by attention over their passages (multiple-instance learning).

A text is cut into passages of ``WORDS`` words. A passage's words are looked up as hashed vectors and averaged; together
with a few shares (symbols, capitals, bars, digits, sentence ends, repeated words) they are encoded into ``WIDTH``
numbers. A gate gives every passage a weight, softmax(w . (tanh(V h) * sigmoid(U h))), and the weighted sum of a
text's passages is scored by a logistic unit. Only texts have labels: passages' encodings, the gate and the last unit are
learned together from them by gradient descent (Adam).

The model is fitted on the whole texts of a bounded sample of labelled rows, chosen by the hash of their text (``SAMPLE``
rows or so); the driver takes them one at a time and keeps four bytes of each word. It is applied to whole texts, read in
slices of ``SLICE`` characters.

Defined results: a null or empty text is one passage without words; without labelled rows every score is the prior 0.5,
and where all labels agree it leans to them; rows whose label is null are not learned from; repeated rows get equal
answers; an empty table gives an empty result; other columns are kept, and one that is named like the result lets the
result's name begin with underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import fresh

SAMPLE = 6000
WORDS = 64
BUCKETS, EMBED, WIDTH, GATE = 1 << 13, 8, 16, 8
SHARES = 12
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
LEAST_STEPS = 800  # few texts are gone over more often
SLICE = 1 << 20
KNOWN = 300_000  # words remembered by one task
STRIP = ".,;:!?\"'()[]{}<>#$%&*|/\\=+-_"
SYMBOLS = frozenset("#$%&*|<>")


def word_row(word: str) -> tuple[int, ...]:
    """Bucket of the word without its marks, and its marks: symbol, lone mark, !?, capitals, one capital, digit, end, comma, letters."""
    core = word.strip(STRIP)
    last = word[-1]
    return (
        xxhash.xxh32_intdigest(core.lower(), 11) % BUCKETS,
        any(c in SYMBOLS for c in word),
        not core,
        last in "!?",
        len(core) > 1 and core.isupper(),
        core[:1].isupper(),
        any(c.isdigit() for c in core),
        last in ".!?",
        last in ",;:",
        min(len(core), 20),
    )


class Words(dict):
    """Word -> its number, and for each number bucket and marks; forgets when it grows too large."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, ...]] = []
        self.table = np.zeros((0, 10), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.rows)
        self.rows.append(word_row(word))
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words, slice by slice; a word longer than a slice is cut."""
        text, out, at = text or "", [], 0
        while at < len(text):
            end = min(len(text), at + SLICE)
            while end < len(text) and not text[end].isspace() and end - at < 2 * SLICE:
                end += 1
            words = text[at:end].split()
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def properties(self) -> np.ndarray:
        if len(self.table) < len(self.rows):
            self.table = np.vstack([self.table, np.array(self.rows[len(self.table) :], np.float32)])
        return self.table

    def forget(self) -> None:
        if len(self.rows) > KNOWN:
            self.clear()
            self.rows, self.table = [], np.zeros((0, 10), np.float32)


@dataclass
class Passages:
    """Passages of some texts: their words' buckets one after the other, where each begins, its shares, and its text."""

    bucket: np.ndarray
    start: np.ndarray  # one more than there are passages
    shares: np.ndarray
    text: np.ndarray  # sorted


def passages(words: Words, numbers: list[np.ndarray]) -> Passages:
    """The passages of texts that are given as word numbers; a text without words has one empty passage."""
    sizes = np.array([len(n) for n in numbers], np.int64)
    count = np.maximum(1, -(-sizes // WORDS))
    text = np.repeat(np.arange(len(numbers)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    size = np.clip(sizes[text] - within * WORDS, 0, WORDS)
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(size)), size)
    properties = words.properties()
    marks = properties[flat] if len(flat) else np.zeros((0, 10), np.float32)
    n = np.maximum(1, size)
    shares = np.zeros((len(size), SHARES), np.float32)
    for i in range(1, 10):
        shares[:, i - 1] = np.bincount(owner, marks[:, i], len(size)) / n
    shares[:, 8] /= 10
    pairs = np.unique(owner * np.int64(1 << 32) + flat)
    shares[:, 9] = 1 - np.bincount(pairs >> 32, minlength=len(size)) / n
    shares[:, 9][size == 0] = 0
    shares[:, 10] = np.log1p(size) / np.log1p(WORDS)
    follows = (flat[1:] == flat[:-1]) & (owner[1:] == owner[:-1])
    shares[:, 11] = np.bincount(owner[1:][follows], minlength=len(size)) / n
    return Passages(marks[:, 0].astype(np.int32), start, shares, text)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def segment_sums(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.column_stack([np.bincount(owner, x[:, k], n) for k in range(x.shape[1])])


class Model:
    """Parameters by name: word vectors E, encoder A and a, gate V, U and w, last unit c and bias."""

    def __init__(self, share: float = 0.5, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "E": rng.normal(0, 0.05, (BUCKETS, EMBED)),
            "A": rng.normal(0, 0.3, (EMBED + SHARES, WIDTH)),
            "a": np.zeros(WIDTH),
            "V": rng.normal(0, 0.3, (WIDTH, GATE)),
            "U": rng.normal(0, 0.3, (WIDTH, GATE)),
            "w": rng.normal(0, 0.3, GATE),
            "c": rng.normal(0, 0.3, WIDTH),
            "bias": np.array([np.log((share + 1e-3) / (1 - share + 1e-3))]),
        }

    def forward(self, x: Passages, texts: int) -> dict[str, np.ndarray]:
        p = self.p
        size = np.maximum(1, np.diff(x.start))
        means = np.zeros((len(size), EMBED))
        some = np.diff(x.start) > 0
        if some.any():
            means[some] = np.add.reduceat(p["E"][x.bucket], x.start[:-1][some], axis=0) / size[some, None]
        f = np.hstack([means, x.shares])
        h = np.tanh(f @ p["A"] + p["a"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        top = np.full(texts, -np.inf)
        np.maximum.at(top, x.text, e)
        weight = np.exp(e - top[x.text])
        weight /= np.bincount(x.text, weight, texts)[x.text]
        z = segment_sums(weight[:, None] * h, x.text, texts)
        return {"size": size, "f": f, "h": h, "v": v, "u": u, "weight": weight, "z": z, "score": _sigmoid(z @ p["c"] + p["bias"])}

    def gradients(self, x: Passages, y: np.ndarray) -> dict[str, np.ndarray]:
        p, t = self.p, self.forward(x, len(y))
        d = (t["score"] - y) / len(y)
        dz = d[:, None] * p["c"]
        at = dz[x.text]
        dweight = (at * t["h"]).sum(axis=1)
        de = t["weight"] * (dweight - np.bincount(x.text, t["weight"] * dweight, len(y))[x.text])
        dh = t["weight"][:, None] * at
        dv, du = de[:, None] * p["w"] * t["u"] * (1 - t["v"] ** 2), de[:, None] * p["w"] * t["v"] * t["u"] * (1 - t["u"])
        dh += dv @ p["V"].T + du @ p["U"].T
        dg = dh * (1 - t["h"] ** 2)
        df = dg @ p["A"].T
        each = np.repeat(df[:, :EMBED] / t["size"][:, None], np.diff(x.start), axis=0)
        return {
            "E": segment_sums(each, x.bucket, BUCKETS),
            "A": t["f"].T @ dg,
            "a": dg.sum(axis=0),
            "V": t["h"].T @ dv,
            "U": t["h"].T @ du,
            "w": (t["v"] * t["u"]).T @ de,
            "c": t["z"].T @ d,
            "bias": np.array([d.sum()]),
        }


def train(words: Words, numbers: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Model:
    model, rng = Model(float(y.mean()) if len(y) else 0.5, seed), np.random.default_rng(seed)
    if not len(y):
        model.p["c"][:] = 0
        return model
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, each = 0, -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))
    steps = epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            few = order[i : i + BATCH]
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, g in model.gradients(passages(words, [numbers[j] for j in few]), y[few]).items():
                g = g + DECAY * model.p[k] if k != "bias" else g
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(labelled: DataFrame, label_col: str = "quality", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from a table of texts with a 0/1 label; nothing but these two columns is looked at."""
    rows = labelled.filter(F.col(label_col).isNotNull()).select(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(11)).alias("h"), F.col(label_col).cast("double").alias("y"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.count()
    part = rows if n <= sample else rows.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * sample / n))
    one = part.groupBy("h", "y").agg(F.min("text").alias("text"))  # of equal texts one
    known, numbers, y = Words(), [], []
    for r in one.sort("h", "y").limit(2 * sample).toLocalIterator():
        numbers.append(known.numbers(r.text))
        y.append(r.y)
    return train(known, numbers, np.array(y))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "_quality") -> DataFrame:
    """``docs`` with a column ``out``, the last one: the probability of label 1."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for texts in batches:
            done, held, size = [], [], 0
            for text in [*texts, None]:
                if size > 200_000 or (held and len(done) + len(held) == len(texts)):
                    x = passages(words, held)
                    done += model.forward(x, len(held))["score"].tolist()
                    held, size = [], 0
                    words.forget()
                if len(done) + len(held) < len(texts):
                    held.append(words.numbers(text))
                    size += len(held[-1])
            yield pd.Series(done)

    return docs.withColumn(fresh(docs, out), scored.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))
