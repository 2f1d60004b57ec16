"""Lines, segments and paragraphs from tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.islands import first_seen_mode, island, ordered, ordered_text, upper_median
from docweave.schema import LINE_KEY

BULLETS = r"^[•◦●▪\-*–]$"


def is_caps(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def build_lines(tokens: DataFrame, *kept: str) -> DataFrame:
    """One row per line: text in x order, box, median font, whether its first token is bold, whether it is in capitals;
    ``kept``: columns that are the same on all tokens of a line. A line's tokens are gathered once and asked for all that."""
    columns = ["x0", "token_index", "token", "y0", "x1", "y1", "font_size", "is_bold"]
    rows = F.sort_array(F.collect_list(F.struct(*columns, *[F.col(c).alias(f"kept_{c}") for c in kept])))
    of = lambda c: F.col("_rows")[c]
    grouped = tokens.groupBy(*LINE_KEY).agg(rows.alias("_rows")).withColumn("_sizes", F.sort_array(F.array_compact(of("font_size"))))
    n = F.size("_sizes")
    middle = [F.get("_sizes", F.expr("CAST((size(_sizes) - 1) / 2 AS INT)")), F.get("_sizes", F.expr("CAST(size(_sizes) / 2 AS INT)"))]
    lines = grouped.select(
        *LINE_KEY, F.array_join(of("token"), " ").alias("text"),
        F.array_min(of("x0")).alias("x0"), F.array_min(of("y0")).alias("y0"), F.array_max(of("x1")).alias("x1"), F.array_max(of("y1")).alias("y1"),
        F.when(n > 0, 0.5 * middle[0] + 0.5 * middle[1]).alias("font_median"),
        F.get(of("is_bold"), F.lit(0)).alias("is_bold"),
        F.size("_rows").alias("n_tokens"),
        *[F.array_min(of(f"kept_{c}")).alias(c) for c in kept],
    )
    return lines.withColumn("is_caps", is_caps(F.col("text")))


def line_majority(tokens: DataFrame) -> DataFrame:
    """Most frequent size and boldness of each line (ties: first seen), and where its content starts after a bullet."""
    pos = tokens.withColumn("pos", F.col("token_index"))
    font = first_seen_mode(pos, LINE_KEY, "font_size", "pos", "font_size")
    bold = first_seen_mode(pos, LINE_KEY, "is_bold", "pos", "is_bold")
    content = F.min(F.when(~((F.col("token_index") == 0) & F.col("token").rlike(BULLETS)), F.col("x0")))
    start = tokens.groupBy(*LINE_KEY).agg(F.coalesce(content, F.min("x0")).alias("content_x0"))
    return font.join(bold, list(LINE_KEY)).join(start, list(LINE_KEY))


def dominant_style(tokens: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return tokens.groupBy(*keys).agg(upper_median("font_size").alias("font_size"), (F.avg(F.col("is_bold").cast("double")) > 0.5).alias("is_bold"))


def style_tiers(lines: DataFrame, most: int = 3) -> DataFrame:
    """Lines with the rank of their style among the document's prominent ones (bold, capitals or over the median size)."""
    doc = Window.partitionBy("doc_id")
    known = lines.withColumn("doc_font", upper_median("font_median").over(doc))
    prominent = F.col("is_bold") | F.col("is_caps") | (F.col("font_median") > F.col("doc_font"))
    # prominent lines come first, so that only their styles are counted before them
    rank = F.dense_rank().over(doc.orderBy(F.desc(prominent), F.desc("font_median"), F.desc("is_bold"), F.desc("is_caps")))
    return known.withColumn("tier", F.when(prominent & (rank <= most), rank)).drop("doc_font")


def split_horizontal(tokens: DataFrame, gap: float = 35.0) -> DataFrame:
    """Parts of a line (column ``part``): a new one after a wide gap, or where boldness or size change outside a bullet's body."""
    w = ordered(LINE_KEY, ("x0", "token_index"))
    bullet = F.first(F.col("token").rlike(BULLETS)).over(w)
    change = (F.col("is_bold") != F.lag("is_bold").over(w)) | (F.abs(F.col("font_size") - F.lag("font_size").over(w)) > 0.5)
    starts = (F.col("x0") - F.lag("x1").over(w) > gap) | (change & ~bullet)
    return island(tokens, F.coalesce(starts, F.lit(False)), w, "part")


def merge_vertical(lines: DataFrame) -> DataFrame:
    """Lines with a ``paragraph``: close below the last line, aligned, of one style and without a bullet."""
    w = ordered(("doc_id", "page"), ("y0", "x0"))
    distance = F.col("y0") - F.lag("y1").over(w)
    same = (F.col("is_bold") == F.lag("is_bold").over(w)) & (F.abs(F.col("font_median") - F.lag("font_median").over(w)) < 0.5)
    aligned = F.abs(F.col("x0") - F.lag("x0").over(w)) <= 5
    joined = distance.between(-3, 5.5) & same & aligned & ~F.col("text").rlike("^[•◦●▪*–-] ")
    return island(lines, ~F.coalesce(joined, F.lit(False)), w, "paragraph")


def sentence_records(lines: DataFrame) -> DataFrame:
    """Paragraph records with text, box and tier; of a run of tier-1 records only the first keeps it."""
    marked = merge_vertical(style_tiers(lines))
    records = marked.groupBy("doc_id", "page", "paragraph").agg(
        ordered_text("text", order=("y0", "x0")).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("tier").alias("tier")
    )
    previous = F.lag("tier").over(ordered(("doc_id",), ("page", "paragraph")))
    return records.withColumn("tier", F.when((F.col("tier") == 1) & (previous == 1), F.lit(None)).otherwise(F.col("tier")))


def group_by_line_run(segments: DataFrame) -> DataFrame:
    """Numbers the runs of segments that stand on one physical line."""
    w = ordered(("doc_id",), ("seg_index",))
    changed = (F.col("page") != F.lag("page").over(w)) | (F.col("line_index") != F.lag("line_index").over(w))
    return island(segments, F.coalesce(changed, F.lit(True)), w, "line_run")


def split_hyphen(lines: DataFrame) -> DataFrame:
    """A line with a lone dash becomes its two sides; both are marked if the dash stands between dates."""
    words = F.split("text", " ", -1)
    at = F.coalesce(F.array_min(F.transform(F.array(F.lit("-"), F.lit("–")), lambda d: F.nullif(F.array_position(words, d), F.lit(0)))), F.lit(0))
    date = r"(19|20)[0-9]{2}|Present"
    sides = lines.withColumn("_w", words).withColumn("_at", at.cast("int"))
    left, right = F.array_join(F.slice("_w", 1, F.greatest(F.col("_at") - 1, F.lit(0))), " "), F.array_join(F.slice("_w", F.col("_at") + 1, F.size("_w")), " ")
    dated = (F.col("_at") > 1) & left.rlike(date) & right.rlike(date)
    parts = F.when(F.col("_at") > 1, F.array(left, right)).otherwise(F.array("text"))
    return sides.select("*", dated.alias("is_range"), F.posexplode(parts).alias("side", "side_text")).drop("_w", "_at")


def majority_section(tokens: DataFrame, keys: tuple[str, ...] = LINE_KEY) -> DataFrame:
    return first_seen_mode(tokens.withColumn("pos", F.col("token_index")), keys, "section", "pos", "section")


def personal_segments(tokens: DataFrame, gap: float = 35.0) -> DataFrame:
    """Atomic contact segments of a line: apart at separators, wide gaps, a B- label, or where the kind of field changes."""
    w = ordered(LINE_KEY, ("x0", "token_index"))
    kind = (
        F.when(F.col("token").contains("@"), "email").when(F.col("token").rlike(r"^\+?[0-9][0-9\-]{7,}$"), "phone").when(F.col("token").rlike("https?://|github|linkedin|www[.]"), "link").otherwise("text")
    )
    marked = tokens.withColumn("kind_of", kind).withColumn("separator", F.col("token").isin("|", "•", "·", ",", "/"))
    starts = (
        F.col("separator") | F.lag("separator").over(w) | (F.col("x0") - F.lag("x1").over(w) > gap) | F.col("bio_label").startswith("B-") | (F.col("kind_of") != F.lag("kind_of").over(w))
    )
    runs = island(marked, F.coalesce(starts, F.lit(True)), w, "run").filter("NOT separator")
    return runs.groupBy(*LINE_KEY, "run").agg(ordered_text(order=("x0", "token_index")).alias("text"), F.first("kind_of").alias("kind"))
