"""Operator 9: minimax contiguous partition of atomic groups into shards.

Equal texts form one group, ordered by the md5 of their text. The smallest feasible shard capacity over that ordered
list of group sizes is found by binary search with a greedy check, and the list is cut there; around an item of that
size the search is repeated with the shards left, so that all shards are used.

The list itself stays in Spark. The driver first sees the sums of the ranges of four hex digits (at most 65,536) and
searches as if a range of several groups could be cut anywhere, which gives a lower bound. The ranges where a cut
falls, at most one fewer than shards, and some beside them (``REFINED_GROUPS`` groups in all) are then fetched by
four digits more, and the search is repeated. Once every cut falls between groups the bound is the true capacity.

Defined results: a null text counts as empty (size 1, crc32 0); an empty table gives an empty result; rows that
repeat a doc_id or have none keep one slot each; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import cut

ATOM_HEX = 4  # 16 ** 4 = 65,536 ranges
REFINED_GROUPS = 20_000  # ranges beside a cut are fetched as well while they hold so few groups


def greedy_cuts(prefix: list[int], capacity: int, limit: int) -> list[int] | None:
    """Start positions of shards filled up to ``capacity``, or None if more than ``limit`` are needed.
    prefix[i] is the size of the first i atoms."""
    starts, at, n = [], 0, len(prefix) - 1
    while at < n:
        if len(starts) == limit:
            return None
        starts.append(at)
        at = bisect_right(prefix, prefix[at] + capacity) - 1
    return starts


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which ``shards`` contiguous runs hold all atoms, and where the runs start.

    As many runs as there are shards or atoms are used. An atom as large as the capacity gets a run of its own
    where the others fit into the runs left, and the search goes on over the stretches between such atoms."""
    if not sizes:
        return 0, []
    stretches, alone = [(0, len(sizes))], []
    capacity = bound = _least_capacity(sizes, stretches, shards)
    while (split := _without_heaviest(sizes, stretches, shards - len(alone), bound)) is not None:
        at, stretches, bound = split
        alone.append(at)
    return capacity, sorted([*alone, *_even_cuts(sizes, stretches, shards - len(alone), bound)])


def _least_capacity(sizes: list[int], stretches: list[tuple[int, int]], shards: int) -> int:
    """The smallest capacity with which ``shards`` runs, none across a stretch's end, hold all stretches; 0 without any."""
    prefixes = [[0, *accumulate(sizes[a:b])] for a, b in stretches]
    total = sum(p[-1] for p in prefixes)
    low, high = max((max(sizes[a:b]) for a, b in stretches), default=0), total
    low = max(low, -(-total // max(1, shards)))
    while low < high:
        middle, left = (low + high) // 2, shards
        for p in prefixes:
            left -= len(greedy_cuts(p, middle, max(left, 0)) or range(left + 1))
        if left < 0:
            low = middle + 1
        else:
            high = middle
    return low


def _without_heaviest(sizes: list[int], stretches: list[tuple[int, int]], shards: int, capacity: int) -> tuple[int, list[tuple[int, int]], int] | None:
    """An atom of the capacity's size, the stretches without it and their capacity, if one run less holds them within ``capacity``."""
    for k, (a, b) in enumerate(stretches):
        for at in range(a, b):
            if sizes[at] == capacity:
                parts = [(x, y) for x, y in ((a, at), (at + 1, b)) if x < y]
                rest = [*stretches[:k], *parts, *stretches[k + 1 :]]
                if len(rest) < shards and (least := _least_capacity(sizes, rest, shards - 1)) <= capacity:
                    return at, rest, least
    return None


def _even_cuts(sizes: list[int], stretches: list[tuple[int, int]], shards: int, capacity: int) -> list[int]:
    """Starts of runs within ``capacity``: first as many as each stretch needs, then one more where runs are largest."""
    prefixes = [[0, *accumulate(sizes[a:b])] for a, b in stretches]
    runs = [len(greedy_cuts(p, capacity, len(p))) for p in prefixes]
    for _ in range(shards - sum(runs)):
        wide = [k for k, p in enumerate(prefixes) if runs[k] < len(p) - 1]
        if wide:
            runs[max(wide, key=lambda k: prefixes[k][-1] / runs[k])] += 1
    return [a + i for (a, _), p, n in zip(stretches, prefixes, runs, strict=True) for i in _even_runs(p, n, capacity)]


def _even_runs(prefix: list[int], runs: int, capacity: int) -> list[int]:
    """Starts of exactly ``runs`` runs within ``capacity``, each cut as near as can be to the average of what is left."""
    n = len(prefix) - 1
    latest = [n]  # latest[k]: the first place from which k runs reach the end
    for _ in range(runs):
        latest.append(bisect_left(prefix, prefix[latest[-1]] - capacity))
    starts, at = [], 0
    for left in range(runs, 0, -1):
        starts.append(at)
        low = max(at + 1, latest[left - 1])
        high = min(bisect_right(prefix, prefix[at] + capacity) - 1, n - left + 1)
        goal = prefix[at] + (prefix[-1] - prefix[at]) / left
        end = bisect_left(prefix, goal)
        if end > 0 and goal - prefix[end - 1] < prefix[min(end, n)] - goal:
            end -= 1
        at = min(max(end, low), high)
    return starts


def open_cuts(prefix: list[int], divisible: list[bool], capacity: int, limit: int) -> list[int] | None:
    """Items in whose inside a shard of ``capacity`` ends, if they could be cut anywhere; None if ``limit`` shards do not do."""
    at, inside = 0, []
    for _ in range(limit):
        end = at + capacity
        if end >= prefix[-1]:
            return inside
        item = bisect_right(prefix, end) - 1
        if prefix[item] != end:
            if divisible[item]:
                inside.append(item)
            else:
                end = prefix[item]
        if end <= at:
            return None
        at = end
    return None if at < prefix[-1] else inside


def _bound(sizes: list[int], divisible: list[bool], shards: int) -> list[int]:
    """Items that the cuts of the smallest capacity fall into."""
    prefix = [0, *accumulate(sizes)]
    low = max([-(-prefix[-1] // shards), *(s for s, d in zip(sizes, divisible, strict=True) if not d)])
    high = prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if open_cuts(prefix, divisible, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return open_cuts(prefix, divisible, low, shards) or []


def _summed(groups: DataFrame, digits: int) -> list[tuple[str, int, int]]:
    """(range, bytes, groups) of the ranges of the first ``digits`` hex digits."""
    by = groups.groupBy(F.substring("digest", 1, digits).alias("range")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return [(r.range, r.bytes, r.n) for r in by.collect()]


def cut_points(groups: DataFrame, shards: int) -> list[str]:
    """First digests of the shards' runs, from checkpointed groups (digest, bytes)."""
    items = sorted(_summed(groups, ATOM_HEX))
    if not items:
        return []
    while inside := _bound([b for _, b, _ in items], [n > 1 for *_, n in items], shards):
        wanted, spare = dict.fromkeys(inside), REFINED_GROUPS
        for step in range(1, len(items)):
            beside = [k for i in inside for k in (i - step, i + step) if 0 <= k < len(items) and k not in wanted and items[k][2] > 1]
            spare -= sum(items[k][2] for k in beside)
            if spare < 0 or step > 64:
                break
            wanted |= dict.fromkeys(beside)
        by_length: dict[int, list[str]] = {}
        for k in wanted:
            by_length.setdefault(len(items[k][0]), []).append(items[k][0])
        finer = [x for n, some in by_length.items() for x in _summed(groups.filter(F.substring("digest", 1, n).isin(some)), n + ATOM_HEX)]
        items = sorted([x for k, x in enumerate(items) if k not in wanted] + finer)
    _, starts = minimax_cuts([b for _, b, _ in items], shards)
    return [items[i][0] for i in starts]


def _shard_of(digest: Column, firsts: list[str]) -> Column:
    """Number of the last run that starts at or before the digest."""
    shard = F.lit(0)
    for i, first in enumerate(firsts):
        if i:
            shard = F.when(digest >= first, F.lit(i)).otherwise(shard)
    return shard.cast("int")


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    firsts = cut_points(groups, shards)
    placed = rows.withColumn("atom", F.substring("digest", 1, ATOM_HEX)).withColumn("shard", _shard_of(F.col("digest"), firsts))

    # Slots: every range is dealt into sub-chunks of bounded row count, so that a hot group of equal texts is
    # numbered by many tasks. The chunk table has at most 16 ** ATOM_HEX * 5 / 4 rows, and one more for each shard.
    atoms = groups.groupBy(F.substring("digest", 1, ATOM_HEX).alias("atom")).agg(F.sum("n").alias("n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    per_chunk = max(1024, -(-4 * total // 16**ATOM_HEX))
    subs = atoms.select("atom", F.ceil(F.col("n") / per_chunk).cast("long").alias("n_sub"))
    dealt = placed.join(F.broadcast(subs), "atom").withColumn("sub", F.pmod(F.xxhash64("row", F.lit(9)), F.col("n_sub")))
    in_shard = Window.partitionBy("shard").orderBy("atom", "sub").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        dealt.groupBy("shard", "atom", "sub")
        .agg(F.count("*").alias("k"))
        .select("shard", "atom", "sub", F.coalesce(F.sum("k").over(in_shard), F.lit(0)).alias("before"))
    )
    in_chunk = Window.partitionBy("shard", "atom", "sub").orderBy("doc_id", "size", "text_crc32", "row")
    return (
        dealt.withColumn("rank", F.row_number().over(in_chunk))
        .join(F.broadcast(chunks), ["shard", "atom", "sub"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
