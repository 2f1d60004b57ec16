"""Operator 2: toxicity by a chain of linear classifiers.

The categories are learned in their order. A category's logistic model sees the hashed words, word
beginnings and shape of a text and the probabilities of all earlier categories; in training those are out-of-fold predictions, so that
a later model meets earlier ones as they will be on new texts. A category is flagged above the threshold with the
best F1 of its own out-of-fold predictions. Models are fitted on a bounded hash sample (``SAMPLE`` labelled rows
at most) and applied to whole texts.

Defined results: a null or empty text has no words and gets the models' probabilities for that; a category
without both classes in the sample always has its share as probability; without labelled rows all probabilities
are 0; repeated rows get equal answers; rows whose labels are null are not learned from; other columns are kept, and
one that is named like the result lets the result's name begin with underscores.
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

SAMPLE = 16_000
SELECTED, LEAST_Z = 4096, 4.0  # features kept for a category, and how far their share must be from chance
FOLDS = 3
DIM_BITS = 18
BEGINNINGS = (4, 5, 6, 7)
EPOCHS, BATCH, RATE, DECAY = 20, 256, 0.3, 1e-5
SYMBOLS = set("#*$%&|<>")
STRIP = " \t\n.,;:!?\"'()[]{}<>#$%&*|/\\=+-_"


class WordFeatures(dict):
    """Word -> hashed features of the word and its beginnings; forgets when it grows too large."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        core = word.lower().strip(STRIP)
        names = {core, *(core[:n] + "~" for n in BEGINNINGS if len(core) >= n)} if core else ()
        self[word] = found = tuple(xxhash.xxh64_intdigest(x, 2) >> (64 - DIM_BITS) for x in names)
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        distinct = set(words)
        found: set[int] = set(shape_features(text or "", len(words), len(distinct)))
        for word in distinct:
            found.update(self[word])
        return np.fromiter(found, np.int32, len(found))


def shape_features(text: str, words: int, distinct: int) -> Iterator[int]:
    """Steps of a text's shares of symbols, capitals, digits, separators and repeated words, and of its length."""
    n = max(1, words)
    shares = (
        sum(text.count(c) for c in SYMBOLS) / n,
        sum(text.count(c) for c in "!?") / n,
        text.count(" | ") / n,
        sum(text.count(c) for c in "0123456789") / n,
        sum(map(text.count, ".,")) / n,
        1 - distinct / n,
        sum(map(str.isupper, text)) / max(1, len(text)),
    )
    for i, x in enumerate((*shares, words / 1000)):
        yield xxhash.xxh64_intdigest(f"{i} {int(np.log2(1 + 64 * x) * 2)}", 3) >> (64 - DIM_BITS)


@dataclass
class Linear:
    """Weights of the selected features (0 for all others), of the earlier categories, and the bias."""

    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    thresholds: list[float]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Texts as rows of features, one after the other."""

    flat: np.ndarray
    start: np.ndarray

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.flat[at], np.repeat(np.arange(len(rows)), size)

    def parts(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some rows at a time, with their features as ``take`` gives them."""
        for i in range(0, len(rows), 500):
            some = rows[i : i + 500]
            yield some, *self.take(some)

    def logits(self, m: Linear, earlier: np.ndarray) -> np.ndarray:
        sums = [np.bincount(row, m.weights[features], len(some)) for some, features, row in self.parts(np.arange(len(self.start) - 1))]
        return np.concatenate(sums) + earlier @ m.earlier + m.bias


def select(x: Rows, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The features whose share of the category is furthest from the category's own share, in standard deviations."""
    docs, hits = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)
    for some, features, row in x.parts(rows):
        docs += np.bincount(features, minlength=1 << DIM_BITS)
        hits += np.bincount(features, y[some][row], 1 << DIM_BITS)
    share = y[rows].mean()
    z = np.abs(hits - docs * share) / np.sqrt(np.maximum(1, docs) * share * (1 - share) + 1e-12)
    order = np.argsort(-z, kind="stable")[:SELECTED]
    return order[z[order] >= LEAST_Z]


def fit_linear(x: Rows, rows: np.ndarray, y: np.ndarray, earlier: np.ndarray, seed: int = 2) -> Linear:
    """Logistic regression by AdaGrad over mini-batches of the rows."""
    share = y[rows].mean() if len(rows) else 0.0
    m = Linear(np.zeros(1 << DIM_BITS), np.zeros(earlier.shape[1]), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if not 0 < share < 1:
        return m
    chosen = select(x, rows, y)
    place = np.full(1 << DIM_BITS, -1)
    place[chosen] = np.arange(len(chosen))
    flat, sizes = [], []
    for some, features, row in x.parts(rows):
        keep = place[features] >= 0
        flat.append(place[features[keep]].astype(np.int32))
        sizes.append(np.bincount(row[keep], minlength=len(some)))
    small = Rows(np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
    w, seen, seen_earlier, seen_bias = np.zeros(len(chosen)), np.full(len(chosen), 1e-6), np.full(earlier.shape[1], 1e-6), 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            few = order[i : i + BATCH]
            features, row = small.take(few)
            before = earlier[rows[few]]
            wrong = (_sigmoid(np.bincount(row, w[features], len(few)) + before @ m.earlier + m.bias) - y[rows[few]]) / len(few)
            push = np.bincount(features, wrong[row], len(w)) + DECAY * w
            seen += push**2
            w -= RATE * push / np.sqrt(seen)
            back = wrong @ before
            seen_earlier += back**2
            m.earlier -= RATE * back / np.sqrt(seen_earlier)
            seen_bias += wrong.sum() ** 2
            m.bias -= RATE * wrong.sum() / np.sqrt(seen_bias)
    m.weights[chosen] = w
    return m


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(f1.argmax())
    return float((p[order][i] + p[order][min(i + 1, len(y) - 1)]) / 2)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = WordFeatures()
    for batch in batches:
        yield batch.drop(columns="text").assign(features=[words.of(t).tobytes() for t in batch["text"]])


def fit(labelled: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """Learn from a table of texts with a 0/1 column for each category, in the chain's order."""
    rows = labelled.dropna(subset=categories).select(
        F.xxhash64(F.col(id_col), F.lit(2)).alias("h"), F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)], F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    n = rows.count()
    # a hash sample of about ``sample`` rows, taken where the rows are
    part = rows if n <= sample else rows.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * sample / n))
    ys = [f"y{i} double" for i in range(len(categories))]
    got = part.mapInPandas(_extracted, ", ".join(["h long", "id long", *ys, "features binary"])).collect()
    got.sort(key=lambda r: (r.h, r.id is None, r.id))
    if not got:
        return Chain(tuple(categories), [], [])
    size = np.array([len(r.features) // 4 for r in got], np.int64)
    x = Rows(np.frombuffer(b"".join(r.features for r in got), np.int32), np.concatenate([[0], np.cumsum(size)]))
    n, truth = len(got), [np.array([r[f"y{i}"] for r in got]) for i in range(len(categories))]
    del got
    everyone, fold = np.arange(n), np.arange(n) % FOLDS
    earlier, models, thresholds = np.zeros((n, 0)), [], []
    for y in truth:
        outside = np.zeros(n)
        for f in range(FOLDS):
            m = fit_linear(x, everyone[fold != f], y, earlier)
            outside[fold == f] = _sigmoid(x.logits(m, earlier))[fold == f]
        models.append(fit_linear(x, everyone, y, earlier))
        thresholds.append(best_threshold(outside, y))
        earlier = np.column_stack([earlier, outside])
    return Chain(tuple(categories), models, thresholds)


def predict(docs: DataFrame, chain: Chain, text_col: str = "text", out: str = "_toxicity") -> DataFrame:
    """``docs`` with a struct column ``out``, the last one: p_<category> and is_<category> of each category."""
    fields = [f"p_{c} double, is_{c} boolean" for c in chain.categories]
    weights = [m.weights.astype(np.float32) for m in chain.models]

    @F.pandas_udf(", ".join(fields))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = WordFeatures()
        for texts in batches:
            p = np.zeros((len(texts), len(chain.categories)))
            for r, text in enumerate(texts):
                x = words.of(text)
                for c, m in enumerate(chain.models):
                    p[r, c] = _sigmoid(weights[c][x].sum(dtype=np.float64) + p[r, :c] @ m.earlier + m.bias)
            yield pd.DataFrame({k: v for c, name in enumerate(chain.categories) for k, v in ((f"p_{name}", p[:, c]), (f"is_{name}", p[:, c] >= (chain.thresholds or [2.0] * len(p[0]))[c]))})

    return docs.withColumn(fresh(docs, out), score.asNondeterministic()(F.coalesce(F.col(text_col), F.lit(""))))
