"""Operator 3: optimal length buckets and token-budget batches.

Texts longer than ``max_tokens`` words are cut into consecutive pieces, so that the global histogram of piece
lengths has at most ``max_tokens + 1`` rows whatever the corpus. Dynamic programming over that histogram chooses
the bucket boundaries that minimise padding. In each bucket a batch takes as many rows as fit the token budget
when every row is padded to the bucket's boundary.

Defined results: a null, empty or blank text is one piece of 0 tokens in the first bucket; an empty table gives
an empty result; rows with equal ids are packed one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import WORD_RX, cut


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most ``buckets`` runs of the ascending ``lengths`` with least total padding, and that padding."""
    n = len(lengths)
    if not n:
        return [], 0
    x, c = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = x * rows[1:] - tokens[1:]  # best[i]: lengths 0..i in one bucket
    starts = [np.zeros(n, np.int64)]  # starts[k][i]: where the last of at most k + 1 buckets over 0..i begins
    for _ in range(1, min(buckets, n)):
        new, start = np.empty(n, np.int64), np.zeros(n, np.int64)
        covered = np.concatenate([[0], best])  # covered[j]: lengths before j
        for i in range(n):
            cost = covered[: i + 1] + x[i] * (rows[i + 1] - rows[: i + 1]) - (tokens[i + 1] - tokens[: i + 1])
            start[i] = cost.argmin()
            new[i] = cost[start[i]]
        best = new
        starts.append(start)
    bounds, i = [], n - 1
    for start in reversed(starts):
        if i < 0:
            break
        bounds.append(int(x[i]))
        i = int(start[i]) - 1
    return bounds[::-1], int(best[n - 1])


def pack(
    docs: DataFrame,
    max_tokens: int = 2048,
    budget: int = 16384,
    buckets: int = 16,
    rows_per_chunk: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start_token, n_tokens, bucket, pad_to, batch, row_in_batch."""
    if budget < max_tokens:
        raise ValueError("the token budget must hold the longest piece")
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RX)), F.lit(0))
    pieces = cut(
        docs.select(F.col(id_col).alias("doc_id"), n_words.cast("int").alias("n"))
        .select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / max_tokens).cast("int") - 1))).alias("piece"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * max_tokens).alias("start_token"),
            F.least(F.lit(max_tokens), F.col("n") - F.col("piece") * max_tokens).alias("n_tokens"),
        )
    )
    histogram = sorted((r.n_tokens, r.k) for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("k")).collect())  # max_tokens + 1 rows at most
    bounds, _ = optimal_boundaries([x for x, _ in histogram], [k for _, k in histogram], buckets)
    bucket = F.lit(0)
    for i, b in enumerate(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") > b, F.lit(i + 1)).otherwise(bucket)
    pad_to = F.element_at(F.array(*[F.lit(b) for b in bounds or [0]]), F.col("bucket") + 1)

    # Positions in a bucket without one task per bucket: a bucket is dealt into chunks by a hash of the row, each
    # chunk is numbered on its own, and the chunks' counts give where each starts.
    n_chunks = max(64, -(-sum(k for _, k in histogram) // rows_per_chunk))
    dealt = pieces.withColumn("bucket", bucket.cast("int")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_chunks)).cast("int"))
    before = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket", "chunk").agg(F.count("*").alias("k")).select("bucket", "chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "chunk").orderBy("doc_id", "piece", "n_tokens")
    place = F.col("before") + F.col("rank") - 1
    per_batch = F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("pad_to")))
    return (
        dealt.withColumn("rank", F.row_number().over(inside))
        .join(starts, ["bucket", "chunk"])
        .withColumn("pad_to", pad_to)
        .select(
            "doc_id",
            "piece",
            "start_token",
            "n_tokens",
            "bucket",
            "pad_to",
            F.floor(place / per_batch).cast("long").alias("batch"),
            F.pmod(place, per_batch).cast("int").alias("row_in_batch"),
        )
    )
