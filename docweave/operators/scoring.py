"""The place where a user's model scores text and vectors.

A scorer is a function from an iterator of frames (columns ``text`` and ``v``, one row for each segment) to an iterator of
frames with a column ``scores`` (one number for each label), row for row. ``load`` makes one, the model ``name``; it is
called once in each Python worker, so that a model's weights are read once however many batches and tasks the worker meets. Frames hold as
many rows as Arrow batches do; nothing is gathered.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.fields import softmax

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

_LOADED: dict[str, Scorer] = {}


def loaded(name: str, load: Callable[[], Scorer]) -> Scorer:
    """The worker's scorer of this name."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def linear_text(weights: list[list[float]], colon: float) -> Scorer:
    """A linear scorer of the vector; the first label gets ``colon`` more for each colon of the text."""
    by_label = np.array(weights).T

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = np.stack(frame["v"].to_numpy()) @ by_label if len(frame) else np.zeros((0, by_label.shape[1]))
            scores[:, 0] += colon * frame["text"].str.count(":").to_numpy()
            yield pd.DataFrame({"scores": list(scores)})

    return scored


def score_with(segments: DataFrame, name: str, load: Callable[[], Scorer], labels: list[str], keys: list[str], text: str = "text", vector: str = "v") -> DataFrame:
    """The keys, ``label`` and ``confidence`` (softmax, 4 decimals; ties: the first label) of each segment.

    A null text is handed over as an empty one, a null vector as an empty list; a scorer that gives other rows than it got
    is an error."""
    given = segments.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: deque[pd.DataFrame] = deque()

        def inputs() -> Iterator[pd.DataFrame]:
            for batch in batches:
                own.append(batch[keys].reset_index(drop=True))
                yield batch[["text", "v"]].reset_index(drop=True)

        for scored in loaded(name, load)(inputs()):
            rows = own.popleft()
            if len(rows) != len(scored):
                raise ValueError(f"the scorer gave {len(scored)} rows for {len(rows)}")
            yield rows.assign(scores=scored["scores"].to_numpy())

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in given.select(*keys).schema), "scores array<double>"])
    told = given.mapInPandas(run, schema).withColumn("_p", softmax(F.col("scores")))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    return told.select(*keys, F.element_at(F.array(*[F.lit(x) for x in labels]), best).alias("label"), F.round(F.array_max("_p"), 4).alias("confidence"))
