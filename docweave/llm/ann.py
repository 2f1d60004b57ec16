"""Operator 8: nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component that brings all to length one, so that the
largest inner product is the smallest Euclidean distance. Each of ``TABLES`` tables hashes them with
``FUNCTIONS`` p-stable functions floor((a.x + b) / w). A query visits buckets whose numbers differ by at most one
in each function, in the order of their estimated chance of success, the sum of squared distances to the crossed
bounds. How many it visits in each table is fitted on a bounded hash sample (``SAMPLE`` vectors): the fewest with
which the sample's nearest neighbours, as many as keep the density of the whole table, are found ``TARGET`` of
the time. Every row is indexed, and candidates of all tables are reranked by their exact inner product.

Equal vectors are indexed once and expanded again afterwards. Buckets are dealt into blocks of about ``BLOCK_BYTES``
(a large bucket into several), each block into a task of its own, and the queries of a block stream past it. A query
that finds fewer than ``k`` candidates is compared with every vector.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
id; shorter vectors count as filled up with zeros, which leaves their inner products as they are; rows that share an
id, or repeat as a whole, are rows of their own, as queries and as candidates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import cut, hot_keys, join_hot

TABLES, FUNCTIONS, WIDTH = 6, 8, 2.0
SAMPLE, SAMPLE_QUERIES, TARGET = 4096, 512, 0.95
BLOCK_BYTES = 32 << 20
LARGE_BUCKETS = 100_000  # more than so many buckets are never split: their names are broadcast
PAIRS_AT_ONCE = 100_000


@dataclass(frozen=True)
class Index:
    dim: int
    scale: float  # the largest norm
    probes: int = 1
    blocks: int = 1
    large: tuple[tuple[int, int], ...] = ()  # buckets that are split, and into how many parts; LARGE_BUCKETS at most
    seed: int = 8

    @cached_property
    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.standard_normal((TABLES, self.dim + 1, FUNCTIONS)), rng.random((TABLES, FUNCTIONS)) * WIDTH

    @cached_property
    def steps(self) -> np.ndarray:
        return np.array(list(product((0, -1, 1), repeat=FUNCTIONS)), np.int64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])

    def as_queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros((len(x), 1))])

    def positions(self, points: np.ndarray, table: int) -> np.ndarray:
        a, b = self.functions
        return (points @ a[table] + b[table]) / WIDTH

    def bucket(self, numbers: np.ndarray, table: int) -> np.ndarray:
        """64-bit name of the buckets with these numbers (last axis: functions)."""
        code = np.full(numbers.shape[:-1], table + 1, np.uint64)
        for k in range(FUNCTIONS):
            code = (code ^ numbers[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return code.view(np.int64)

    def order(self, positions: np.ndarray) -> np.ndarray:
        """Places in ``steps`` of each query's buckets, most promising first."""
        below = positions - np.floor(positions)
        cost = np.stack([np.zeros_like(below), below**2, (1 - below) ** 2], axis=-1)  # by step 0, -1, 1
        total = np.zeros((len(positions), len(self.steps)))
        for k in range(FUNCTIONS):
            total += cost[:, k, :][:, np.where(self.steps[:, k] < 0, 1, 2 * self.steps[:, k])]
        return np.argsort(total, axis=1, kind="stable")

    def visits(self, positions: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of the buckets that each query visits, most promising first: query x probe x function."""
        return np.floor(positions)[:, None, :].astype(np.int64) + self.steps[self.order(positions)[:, :probes]]

    @cached_property
    def parts(self) -> dict[int, int]:
        return dict(self.large)

    def block(self, bucket: np.ndarray, part: np.ndarray) -> np.ndarray:
        x = (bucket.view(np.uint64) + part.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.blocks)).astype(np.int64)


def fit_probes(index: Index, sample: np.ndarray, total: int, k: int) -> int:
    """The fewest probes in each table that find the sample's near neighbours ``TARGET`` of the time."""
    points, m = index.lifted(sample), len(sample)
    asked = np.arange(min(SAMPLE_QUERIES, m))
    near = min(m - 1, max(1, round(k * m / max(1, total))))
    if near < 1:
        return 1
    scores = sample[asked] @ sample.T
    scores[asked, asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :near]
    first = np.full((len(asked), near), len(index.steps))  # probes until a neighbour is found, over all tables
    for t in range(TABLES):
        numbers = np.floor(index.positions(points, t)).astype(np.int64)
        position = index.positions(index.as_queries(sample[asked]), t)
        home = np.floor(position).astype(np.int64)
        for q in range(len(asked)):
            step = numbers[best[q]] - home[q]
            place = np.empty(len(index.steps), np.int64)  # of each step among the query's visits
            place[index.order(position[q : q + 1])[0]] = np.arange(len(index.steps))
            reached = (np.abs(step) <= 1).all(axis=1)
            code = (np.where(step < 0, 1, 2 * step) @ 3 ** np.arange(FUNCTIONS)[::-1])[reached]
            first[q, reached] = np.minimum(first[q, reached], place[code])
    return int(min(len(index.steps), np.quantile(first, TARGET, method="higher") + 1))


def _vectors(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


ROW = "block long, kind int, id long, bucket long, vector binary, visits binary"


def _hashed(index: Index):
    """Only the bucket of every vector in every table, for the sizes of buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = index.lifted(_vectors(batch["vector"], index.dim))
            yield pd.DataFrame({"bucket": np.concatenate([index.bucket(np.floor(index.positions(points, t)), t) for t in range(TABLES)])})

    return run


def _members(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points, ids = index.lifted(_vectors(batch["vector"], index.dim)), batch["id"].to_numpy(np.int64)
            for t in range(TABLES):
                bucket = index.bucket(np.floor(index.positions(points, t)), t)
                parts = np.array([index.parts.get(b, 1) for b in bucket.tolist()], np.int64)
                block = index.block(bucket, ids % parts)
                # kind 0: also the one copy of each vector that a full comparison looks at
                yield pd.DataFrame({"block": block, "kind": np.int32(t > 0), "id": ids, "bucket": bucket, "vector": batch["vector"], "visits": b""})

    return run


def _asked(index: Index, everything: bool):
    """One row for each query and each block that it has to see."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy(np.int64)
            if everything:
                for block in range(index.blocks):
                    yield pd.DataFrame({"block": block, "kind": np.int32(2), "id": ids, "bucket": 0, "vector": batch["vector"], "visits": b""})
                continue
            points = index.as_queries(_vectors(batch["vector"], index.dim))
            for low in range(0, len(ids), 64):
                few = slice(low, low + 64)
                buckets = np.concatenate([index.bucket(index.visits(index.positions(points[few], t), index.probes), t) for t in range(TABLES)], axis=1)
                out = []
                for i, own in zip(range(low, low + 64), buckets, strict=False):
                    seen = np.unique(own)
                    split = [(b, index.parts[b]) for b in seen.tolist() if b in index.parts] if index.parts else []
                    bucket = np.concatenate([seen, *(np.full(n - 1, b) for b, n in split)])
                    part = np.concatenate([np.zeros(len(seen), np.int64), *(np.arange(1, n) for _, n in split)])
                    block = index.block(bucket, part)
                    order = np.argsort(block, kind="stable")
                    block, bucket = block[order], bucket[order]
                    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                    out += [(block[a], 2, ids[i], 0, batch["vector"].iloc[i], bucket[a:z].astype(np.int64).tobytes()) for a, z in zip(at, [*at[1:], len(block)], strict=True)]
                yield pd.DataFrame(out, columns=["block", "kind", "id", "bucket", "vector", "visits"])

    return run


def _best(query: np.ndarray, member: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best different members; ties to the smaller id."""
    order = np.lexsort((member, -score, query))
    q, m = query[order], member[order]
    again = np.concatenate([[False], (q[1:] == q[:-1]) & (m[1:] == m[:-1])]) if len(q) else np.zeros(0, bool)
    order, q = order[~again], q[~again]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


def _ranked(index: Index, k: int):
    """Rows sorted by block and kind: a block's members are held, its queries stream past."""

    def found(query: np.ndarray, vectors: np.ndarray, first: np.ndarray, count: np.ndarray, x: np.ndarray, ids: np.ndarray, qids: np.ndarray) -> pd.DataFrame:
        out, ends, low = [], np.cumsum(count), 0
        while low < len(query):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_AT_ONCE, side="right")))
            high += int(np.searchsorted(query[high:], query[high - 1], side="right"))  # a query's probes stay together
            n = count[low:high]
            q = np.repeat(query[low:high], n)
            m = np.repeat(first[low:high] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            score = np.einsum("ij,ij->i", vectors[q], x[m])
            best = _best(q, ids[m], score, k)
            out.append(pd.DataFrame({"q": qids[q[best]], "c": ids[m[best]], "score": score[best]}))
            low = high
        return pd.concat(out) if out else pd.DataFrame({"q": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "score": np.zeros(0)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, ready = None, [], None
        for batch in batches:
            for block, rows in batch.groupby("block", sort=True):
                if block != at:
                    at, held, ready = block, [], None
                kind = rows["kind"].to_numpy()
                if (kind < 2).any():
                    held.append(rows[kind < 2])
                    ready = None
                asked = rows[kind == 2]
                if not len(asked) or not held:
                    continue
                if ready is None:
                    own = pd.concat(held)
                    order = np.argsort(own["bucket"].to_numpy(), kind="stable")
                    own = own.iloc[order]
                    ready = own["bucket"].to_numpy(), own["id"].to_numpy(), _vectors(own["vector"], index.dim), np.flatnonzero(own["kind"].to_numpy() == 0)
                buckets, ids, x, single = ready
                vectors, qids = _vectors(asked["vector"], index.dim), asked["id"].to_numpy()
                visits = [np.frombuffer(v, np.int64) for v in asked["visits"]]
                probed = np.array([len(v) for v in visits])
                if probed.any():
                    wanted = np.concatenate(visits)
                    first = np.searchsorted(buckets, wanted)
                    count = np.searchsorted(buckets, wanted, side="right") - first
                    query = np.repeat(np.arange(len(asked)), probed)
                    some = count > 0
                    yield found(query[some], vectors, first[some], count[some], x, ids, qids)
                full = np.flatnonzero(probed == 0)
                if len(full) and len(single):
                    yield found(full, vectors, np.zeros(len(full), np.int64), np.full(len(full), len(single)), x[single], ids[single], qids)

    return run


def _search(members: DataFrame, queries: DataFrame, index: Index, k: int, everything: bool = False) -> DataFrame:
    rows = members.unionByName(queries.mapInPandas(_asked(index, everything), ROW))
    dealt = rows.repartitionById(index.blocks, F.col("block").cast("int")).sortWithinPartitions("block", "kind")
    found = dealt.mapInPandas(_ranked(index, k), "q long, c long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return found.dropDuplicates(["q", "c"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def _usable(v: Column) -> Column:
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(broken, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "vector": [np.asarray(v, np.float64).tobytes() for v in batch["v"]]})


def _index(single: DataFrame, dim: int, scale: float, total: int, k: int) -> Index:
    """The index of the distinct vectors (id, vector): probes fitted on the sample, blocks, and buckets that are split."""
    index = Index(dim, scale)
    sample = [r.vector for r in single.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(SAMPLE).collect()]
    probes = fit_probes(index, np.frombuffer(b"".join(sample), np.float64).reshape(-1, dim), total, k)
    block_rows = max(1024, BLOCK_BYTES // (8 * dim))
    part = max(block_rows // 4, ceil(TABLES * total / LARGE_BUCKETS))
    large = single.mapInPandas(_hashed(index), "bucket long").groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > part).collect()
    return Index(dim, scale, probes, max(1, ceil(TABLES * total / block_rows)), tuple((r.bucket, ceil(r.n / part)) for r in large))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``queries`` holds, itself excluded."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    filled = F.concat("v", F.array_repeat(F.lit(0.0), dim - F.size("v")))
    named = rows.select("id", "asked", filled.alias("v")).withColumn("digest", F.concat(F.hex(F.xxhash64("v")), F.lit(" "), F.hex(F.xxhash64(F.lit(1), "v"))))
    rows = cut(named)

    # equal vectors: one number stands for all, in the order of their smallest ids, and k + 1 of them can be among the nearest
    classes = cut(rows.groupBy("digest").agg(F.min("id").alias("first")).orderBy("first", "digest").withColumn("rep", F.monotonically_increasing_id()))
    numbered = cut(join_hot(rows.select("id", "asked", "digest"), classes, "digest", hot_keys(rows, "digest")).select("id", "asked", "first", "digest", "rep"))
    in_class = Window.partitionBy("rep").orderBy("id")
    copies = numbered.withColumn("place", F.row_number().over(in_class)).filter(F.col("place") <= k + 1).select(F.col("rep").alias("c"), "id")
    firsts = classes.select(F.col("first").alias("id"), "digest", "rep")
    single = cut(rows.dropDuplicates(["id", "digest"]).join(firsts, ["id", "digest"]).select(F.col("rep").alias("id"), "v").mapInPandas(_packed, "id long, vector binary"))
    asked = cut(single.join(numbered.filter("asked").select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))

    scale = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    total = single.count()
    index = _index(single, dim, scale, total, k)
    members = single.mapInPandas(_members(index), ROW)
    found = cut(_search(members, asked, index, k + 1))
    enough = found.groupBy("q").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k + 1, total)).select(F.col("q").alias("id"))
    short = asked.join(enough, "id", "left_anti")
    if not short.isEmpty():
        rest = _search(members, cut(short), index, k + 1, everything=True)
        found = found.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(rest)

    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    listed = found.join(copies, "c").withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k + 1)
    lists = cut(listed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "c", "score"))).alias("near")))  # k + 1 entries
    wanted = cut(numbered.filter("asked").select(F.col("id").alias("query_id"), F.col("rep").alias("q")))
    # the query's own row goes, but no other row that repeats it
    own = F.array_position(F.transform("near", lambda x: (x["id"] == F.col("query_id")) & (x["c"] == F.col("q"))), True).cast("int")
    others = F.when(own > 0, F.concat(F.slice("near", F.lit(1), own - 1), F.slice("near", own + 1, F.size("near")))).otherwise(F.col("near"))
    ranked = join_hot(wanted, lists, "q", hot_keys(wanted, "q")).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
