"""Operator 13: hard negatives of anchor vectors, with bounds along a spanning tree of the anchors.

Components become integers, so that scores are exact. Anchors are dealt into blocks of at most ``ANCHORS``; within a
block the shortest spanning tree is built once. A task holds one part of the candidates and walks each block's tree:
the score of a candidate at an anchor differs from its score at the anchor's parent by at most the edge's length times
the candidate's norm, so that intervals come down the tree, and only candidates whose interval meets the wanted window
are scored at the anchor itself. The first pass finds each anchor's best rows of its own label, the second one the best
rows of other labels in the windows that the first one's scores set. Both keep a few rows for each anchor and part.

The candidates' parts are sent once; every anchor is sent to every part, which is the given query set against all rows.
Parts hold about ``PART_BYTES``.

Defined results: rows take no part whose id, label or vector is null or whose vector holds a null or non-finite
component; shorter vectors count as filled up with zeros; rows that share an id, or repeat as a whole, are rows of their
own, as anchors and as candidates; an anchor without other rows of its label, or without a row in a window, gives no
rows; an empty table gives an empty result; other columns are ignored. Scores must fit a 64-bit number: vectors too
large for that are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import cut

ANCHORS = 4096
PART_BYTES, LEAST_PARTS = 16 << 20, 16
EXACT = 1 << 53  # sums of products below this are exact in double precision

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
ROW = "row long, id long, label long, vector binary"
CELL = "part int, block int, place int, parent int, edge double, row long, id long, label long, vector binary, wanted binary"


def _vectors(column: pd.Series, dim: int, wide: bool) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64).reshape(-1, dim).astype(np.int64 if wide else np.float64)


def _packed(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            filled = [np.pad(np.asarray(v, np.int64), (0, dim - len(v))).tobytes() for v in batch["v"]]
            yield batch.drop(columns="v").assign(vector=filled)

    return run


def shortest_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's parent (-1: the first point) and distance to it, by adding the nearest outside point each time."""
    n = len(x)
    parent, near = np.full(n, -1), np.full(n, np.inf)
    edge, outside = np.zeros(n), np.ones(n, bool)
    norms, at = (x * x).sum(axis=1), 0
    for _ in range(n - 1):
        outside[at] = False
        d = np.maximum(0, norms + norms[at] - 2 * (x @ x[at]))
        closer = outside & (d < near)
        near[closer], parent[closer] = d[closer], at
        at = int(np.where(outside, near, np.inf).argmin())
        edge[at] = np.sqrt(((x[at] - x[parent[at]]) ** 2).sum())
    return parent, edge


def walk(parent: np.ndarray) -> list[int]:
    """Parents before children, the largest subtree last, so that few ancestors wait for children at any time."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        if parent[i] >= 0:
            children[parent[i]].append(i)
    order, stack = [], [0]
    while stack:
        order.append(at := stack.pop())
        stack += children[at]
    size = np.ones(n, np.int64)
    for i in reversed(order):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    order, stack = [], [0]
    while stack:
        order.append(at := stack.pop())
        stack += sorted(children[at], key=lambda c: -size[c])
    return order


def _treed(dim: int):
    """One block of anchors, in the order of the walk, with the place of each one's parent."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["id", "row"], ignore_index=True)
        parent, edge = shortest_tree(_vectors(block["vector"], dim, False))
        order = np.array(walk(parent))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        up = parent[order]
        out = block.iloc[order].assign(place=np.arange(len(order)), parent=np.where(up < 0, -1, place[up]), edge=edge[order])
        return out[["block", "place", "parent", "edge", "row", "id", "label", "vector"]]

    return run


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each run of equal keys, whole, across batches; rows come sorted by the keys."""
    at, held = None, []
    for batch in batches:
        for key, rows in batch.groupby(keys, sort=True):
            if held and key != at:
                yield at, pd.concat(held, ignore_index=True)
                held = []
            at = key
            held.append(rows)
    if held:
        yield at, pd.concat(held, ignore_index=True)


def kth_largest(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -np.inf


class Part:
    """The candidates of one part, sorted by label and id."""

    def __init__(self, rows: pd.DataFrame, dim: int, wide: bool):
        rows = rows.sort_values(["label", "id", "row"], ignore_index=True)
        self.row, self.id, self.label = (rows[c].to_numpy(np.int64) for c in ("row", "id", "label"))
        self.x = _vectors(rows["vector"], dim, wide)
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))
        self.rescored = 0

    def own(self, label: int) -> slice:
        return slice(int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, side="right")))

    def scores(self, anchor: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        x = self.x if which is None else self.x[which]
        self.rescored += len(x)
        return (x @ anchor).astype(np.int64)

    def best(self, which: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``which`` of the k highest scores, ties to the smaller id."""
        if len(which) > 4 * k:
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            some = np.arange(len(which))
        return some[np.lexsort((self.id[which[some]], -scores[some]))[:k]]

    def walk(self, block: pd.DataFrame, dim: int, wide: bool, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor: its place, the candidates that ``wanted(place, low, high)`` asks for, and their scores."""
        anchors, parents, edges = _vectors(block["vector"], dim, wide), block["parent"].to_numpy(), block["edge"].to_numpy()
        waiting = np.bincount(parents[parents >= 0], minlength=len(block))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for place in range(len(block)):
            if parents[place] < 0:
                exact = self.scores(anchors[place])
                low, high = exact.astype(np.float64), exact.astype(np.float64)
                which = wanted(place, low, high)
                found = exact[which]
            else:
                up_low, up_high = bounds[parents[place]]
                slack = (edges[place] * (1 + 1e-9)) * self.norm + 1e-9 * (np.abs(up_low) + np.abs(up_high) + 1)
                low, high = up_low - slack, up_high + slack
                which = wanted(place, low, high)
                if 2 * len(which) > len(self.id):
                    exact = self.scores(anchors[place])
                    found = exact[which]
                    low, high = exact.astype(np.float64), exact.astype(np.float64)
                else:
                    found = self.scores(anchors[place], which)
                    low[which] = high[which] = found
                waiting[parents[place]] -= 1
                if not waiting[parents[place]]:
                    del bounds[parents[place]]
            if waiting[place]:
                bounds[place] = low, high
            yield place, which, found


def _positives(dim: int, wide: bool, k: int):
    """The best rows of each anchor's label in each part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = None, None
        for (number, block), rows in _runs(batches, ["part", "block"]):
            if block < 0:
                part, at = Part(rows, dim, wide), number
                continue
            if at != number:
                continue
            anchor, label = rows["row"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)

            def wanted(place: int, low: np.ndarray, high: np.ndarray, part=part, anchor=anchor, label=label) -> np.ndarray:
                own = part.own(label[place])
                others = np.arange(own.start, own.stop)
                others = others[part.row[own] != anchor[place]]
                return others[high[others] >= kth_largest(low[others], k)]

            out = []
            for place, which, scores in part.walk(rows, dim, wide, wanted):
                best = part.best(which, scores, k)
                out.append(pd.DataFrame({"anchor": anchor[place], "id": part.id[which[best]], "score": scores[best]}))
            yield pd.concat(out)

    return run


def window(positive: int, least: int, most: int) -> tuple[int, int]:
    """The smallest and largest whole score from ``least`` to ``most`` percent of the positive's."""
    return -((-least * positive) // 100), (most * positive) // 100


def in_window(score: np.ndarray, positive: int, least: int, most: int) -> np.ndarray:
    low, high = -((-least * int(positive)) // 100), (most * int(positive)) // 100
    return (score >= low) & (score <= high)


def _negatives(dim: int, wide: bool, k: int, least: int, most: int):
    """For each score of an anchor's positives, the best rows of other labels in its window, in each part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = None, None
        for (number, block), rows in _runs(batches, ["part", "block"]):
            if block < 0:
                part, at = Part(rows, dim, wide), number
                continue
            if at != number:
                continue
            anchor, label = rows["row"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
            targets = [np.frombuffer(w, ">i8").astype(np.int64) if w is not None else np.zeros(0, np.int64) for w in rows["wanted"]]

            def wanted(place: int, low: np.ndarray, high: np.ndarray, part=part, label=label, targets=targets) -> np.ndarray:
                own, meets = part.own(label[place]), np.zeros(len(low), bool)
                other = np.ones(len(low), bool)
                other[own] = False
                for positive in targets[place].tolist():
                    floor, top = window(positive, least, most)
                    if floor <= top:
                        sure = other & (high <= top)
                        meets |= other & (low <= top) & (high >= max(floor, kth_largest(low[sure], k)))
                return np.flatnonzero(meets)

            out = []
            for place, which, scores in part.walk(rows, dim, wide, wanted):
                for positive in targets[place].tolist():
                    inside = in_window(scores, positive, least, most)
                    if inside.any():
                        some = which[inside]
                        best = part.best(some, scores[inside], k)
                        out.append(pd.DataFrame({"anchor": anchor[place], "positive": positive, "id": part.id[some[best]], "score": scores[inside][best]}))
            if out:
                yield pd.concat(out)

    return run


def _usable(v: Column) -> Column:
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(broken, F.lit(True))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row is an anchor where ``anchors`` holds; ``label`` is its class. Of each anchor's ``positives`` best rows of its
    class, each gets the ``negatives`` best rows of other classes whose score is ``least`` to ``most`` percent of the
    positive's. Components are floor(``scale`` * x)."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v")))
    scaled = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    sizes = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(F.floor(x * float(scale)).cast("double")))))).first()
    total, dim, largest = sizes[0], max(1, sizes[1] or 0), (sizes[2] or 0) + 1
    if not total:
        return vectors.sparkSession.createDataFrame([], RESULT)
    if dim * float(largest) ** 2 >= 2.0**63:
        raise ValueError("vectors too large: their scores do not fit 64-bit numbers")
    wide = dim * float(largest) ** 2 >= EXACT

    named = rows.select("id", "label", "asked", scaled.alias("v")).withColumn("row", F.monotonically_increasing_id())
    packed = cut(named.select("asked", "row", "id", "label", "v").mapInPandas(_packed(dim), f"asked boolean, {ROW}"))
    parts = max(LEAST_PARTS, ceil(8 * dim * total / PART_BYTES))
    asked = packed.filter("asked").drop("asked")
    blocks = ceil(asked.count() / (ANCHORS // 2))  # hashing fills no block beyond ANCHORS
    if not blocks:
        return vectors.sparkSession.createDataFrame([], RESULT)
    block = F.pmod(F.xxhash64("row", F.lit(13)), F.lit(blocks)).cast("int")
    trees = cut(asked.withColumn("block", block).groupBy("block").applyInPandas(_treed(dim), f"block int, place int, parent int, edge double, {ROW}"))
    part = F.pmod(F.xxhash64("row", F.lit(14)), F.lit(parts)).cast("int")
    nothing = [F.lit(-1).alias("block"), F.lit(-1).alias("place"), F.lit(-1).alias("parent"), F.lit(0.0).alias("edge")]
    candidates = packed.select(part.alias("part"), *nothing, "row", "id", "label", "vector", F.lit(None).cast("binary").alias("wanted"))

    def dealt(trees: DataFrame) -> DataFrame:
        everywhere = trees.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *[f.split()[0] for f in CELL.split(", ")[1:]])
        return candidates.unionByName(everywhere).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "block", "place")

    found = dealt(trees.withColumn("wanted", F.lit(None).cast("binary"))).mapInPandas(_positives(dim, wide, positives), "anchor long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = cut(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives))
    targets = best.groupBy("anchor").agg(F.collect_set("score").alias("scores"))  # as many as ``positives``
    joined = F.unhex(F.array_join(F.transform(F.sort_array("scores"), lambda s: F.lpad(F.hex(s), 16, "0")), ""))
    second = cut(trees.join(targets.select(F.col("anchor").alias("row"), joined.alias("wanted")), "row", "left"))
    near = dealt(second).mapInPandas(_negatives(dim, wide, negatives, least, most), "anchor long, positive long, id long, score long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id")
    chosen = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named_best = best.join(trees.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    pairs = named_best.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive"))
    return pairs.join(chosen, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("positive").alias("positive_score"), F.col("score").alias("negative_score")
    )

