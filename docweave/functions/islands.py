"""Gaps and islands over ordered rows: the building blocks of most token operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docweave.schema import ORDER


def ordered(keys: Sequence[str] = ("doc_id",), order: Sequence[str | Column] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def island(df: DataFrame, starts: Column, w: WindowSpec, out: str = "island") -> DataFrame:
    """Numbers the runs of rows: a row for which ``starts`` holds begins a new one. Rows before the first start are run 0."""
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(running(w)))


def carry_last(value: Column, w: WindowSpec) -> Column:
    """The last value so far that is not null."""
    return F.last(value, ignorenulls=True).over(running(w))


def next_known(value: Column, w: WindowSpec) -> Column:
    """The first following value that is not null."""
    return F.first(value, ignorenulls=True).over(after(w))


def upper_median(column: str) -> Column:
    """sorted(values)[n // 2]."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def lower_median(column: str) -> Column:
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})")


def first_seen_mode(df: DataFrame, keys: Sequence[str], value: str, position: str, out: str = "mode") -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first seen."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(position).alias("_first"))
    best = F.max_by(F.col(value), F.struct(F.col("_n"), -F.col("_first")))
    return counted.groupBy(*keys).agg(best.alias(out))


def ordered_text(column: str = "token", sep: str = " ", order: Sequence[str] = ORDER) -> Column:
    """Aggregate: the group's values in reading order, joined. The rows are sorted and taken apart without lambdas, which
    Spark would interpret row by row."""
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(column).alias("_v"))))
    return F.array_join(rows["_v"], sep)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Rows that a fold takes together: each step copies what its block has given so far, and no more.
FOLD_BLOCK = 64


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column, state: str, step: Callable[[Column, Column], Column], out: str, kind: str) -> DataFrame:
    """Rows of each group, in order, with ``out``, a field of the running state: ``step`` makes the next state (a struct
    of type ``state``) from the last one and the row. For rules that look at their own earlier decisions; the groups are
    lines, pages or entries, and the fold stays in the JVM. Outputs are gathered block by block, so that long groups cost
    little more for each row than short ones."""
    columns = [c for c in df.columns if c not in keys and c not in order]
    rows = F.array_sort(F.collect_list(F.struct(*order, *columns)))
    nothing = F.array().cast(f"array<{kind}>")

    def grown(a: Column, row: Column) -> Column:
        return once(step(a["s"], row).cast(state), lambda new: F.struct(new.alias("s"), F.concat(a["o"], F.array(new[out].cast(kind))).alias("o")))

    def joined(a: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(a["s"].alias("s"), nothing.alias("o")), grown)
        return once(inner, lambda x: F.struct(x["s"].alias("s"), F.concat(a["o"], F.array(x["o"])).alias("o")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / FOLD_BLOCK).cast("int")), lambda i: F.slice("_rows", i * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)))
    first = F.struct(start.cast(state).alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o"))
    grouped = df.groupBy(*keys).agg(rows.alias("_rows")).withColumn("_out", F.flatten(F.aggregate(blocks, first, joined, lambda a: a["o"])))
    each = grouped.select(*keys, F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_out").alias("o"))).alias("z"))
    return each.select(*keys, *[F.col(f"z.r.{c}").alias(c) for c in [*order, *columns]], F.col("z.o").alias(out))
