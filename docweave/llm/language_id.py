"""Operator 1: language identification by compression.

For every labelled language a raw-content zstandard dictionary is made from a bounded hash sample of its texts
(``docs_per_language`` texts and ``dict_bytes`` bytes at most). A text, lower-cased and reduced to its letters, is
encoded whole with every dictionary, in blocks of ``BLOCK`` bytes; the smallest total wins. Where the lead is
narrow the text is encoded again at a stronger level, equal totals go to the language with more training texts,
and a lead that is still under ``min_margin`` is rejected.

Defined results: a null text or one without a letter is ``und`` with score 0 and is rejected; without training
rows every text is ``und``; of equal totals the more common language wins, so that its lead is 0 and it is rejected;
repeated rows get equal answers and are learned from once; rows without id are learned from like others; other
columns are kept, and one that is named like the result lets the result's name begin with underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import fresh

BLOCK = 4096
QUICK_LEVEL, STRONG_LEVEL = 5, 12
#: Leads under this share of the second size are measured again at the stronger level.
NARROW = 0.10
UNDETERMINED = "und"
RESULT = "lang_pred string, score double, margin double, accepted boolean"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, most common language first."""

    dictionaries: tuple[tuple[str, bytes], ...]
    min_margin: float = 0.01


def letters(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def fit(
    labelled: DataFrame,
    docs_per_language: int = 128,
    dict_bytes: int = 64_000,
    min_margin: float = 0.01,
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """Learn from the rows whose text and language are not null."""
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col), F.lit(1)).alias("h"), F.col(text_col).alias("text")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    shares = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= docs_per_language).groupBy("lang", "h").agg(F.min("rank").alias("rank"))
    # at most docs_per_language rows for each language, small enough to broadcast; of their texts only what fits a dictionary is collected
    picked = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "rank", F.substring(letters(F.col("text")), 1, dict_bytes).alias("text")).dropDuplicates(["lang", "rank"])
    earlier = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    picked = picked.withColumn("earlier", F.coalesce(earlier, F.lit(0))).filter(F.col("earlier") < dict_bytes)
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():
        texts.setdefault(r.lang, []).append((r.rank, r.text))
    ranked = sorted(texts, key=lambda k: (-shares[k], k))
    joined = ((k, b" ".join(t.encode() for _, t in sorted(texts[k]))[:dict_bytes]) for k in ranked)
    return LanguageModel(tuple((k, d.ljust(8)) for k, d in joined), min_margin)  # a dictionary has 8 bytes at least


def _encoders(model: LanguageModel, level: int) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, content in model.dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def _sizes(data: bytes, encoders: list[zstandard.ZstdCompressor]) -> list[int]:
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return [sum(len(e.compress(b)) for b in blocks) for e in encoders]


def _lead(sizes: list[int]) -> float:
    best, second = sorted(sizes)[:2]
    return (second - best) / second


def classify(data: bytes, model: LanguageModel, quick: list, strong: list) -> tuple[str, float, float, bool]:
    names = [k for k, _ in model.dictionaries]
    if not data or not names:
        return UNDETERMINED, 0.0, 0.0, False
    if len(names) == 1:
        return names[0], 1.0, 1.0, True
    sizes = _sizes(data, quick)
    if _lead(sizes) < NARROW:
        sizes = _sizes(data, strong)
    best = min(range(len(names)), key=sizes.__getitem__)
    margin = _lead(sizes)
    return names[best], 1 / sum(2.0 ** -min(1000, s - sizes[best]) for s in sizes), margin, margin >= model.min_margin


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "_language") -> DataFrame:
    """``docs`` with a struct column ``out``, the last one: lang_pred, score, margin, accepted."""

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        quick, strong = _encoders(model, QUICK_LEVEL), _encoders(model, STRONG_LEVEL)
        for texts in batches:
            rows = [classify((t or "").encode(), model, quick, strong) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "accepted"])

    # marked so that a filter on the result does not encode every text twice
    return docs.withColumn(fresh(docs, out), predict.asNondeterministic()(F.coalesce(letters(F.col(text_col)), F.lit(""))))
