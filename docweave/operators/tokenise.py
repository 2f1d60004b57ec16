"""Re-tokenising operators: one token row in, one or more out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.islands import before, island, ordered, running
from docweave.schema import LINE_KEY

#: Months as they are written in date ranges, and words for an open end.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|January|February|March|April|June|July|August|September|October|November|December"
OPEN_END = "Present|present|Current|current|Now|now"


def split_into(tokens: DataFrame, parts: Column) -> DataFrame:
    """Replaces each token by its parts (an array of strings) and shares the box out by their lengths."""
    rows = tokens.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("part", "piece"))
    return alloc_bbox(rows).drop("_parts", "token").withColumnRenamed("piece", "token")


def alloc_bbox(parts: DataFrame) -> DataFrame:
    """x0 and x1 of parts (part, piece) of a token's box, in proportion to their characters."""
    w = Window.partitionBy("doc_id", "page", "line_index", "token_index").orderBy("part")
    total = F.sum(F.char_length("piece")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = (F.col("x1") - F.col("x0")) / total
    left = F.coalesce(F.sum(F.char_length("piece")).over(before(w)), F.lit(0))
    return parts.withColumn("_x0", F.round(F.col("x0") + left * share, 2)).withColumn("x1", F.round(F.col("x0") + (left + F.char_length("piece")) * share, 2)).withColumn("x0", F.col("_x0")).drop("_x0")


def reindex(tokens: DataFrame) -> DataFrame:
    """Dense token_index within each line, by x."""
    order = ["x0", "token_index"] + (["part"] if "part" in tokens.columns else [])
    return tokens.withColumn("token_index", (F.row_number().over(ordered(LINE_KEY, order)) - 1).cast("int"))


def long_token_parts(token: Column) -> Column:
    """Tokens of 25 characters with a bar split at it; camel-case ones of 20 split at their capitals."""
    bars = F.filter(F.transform(F.split(token, r"\|", -1), F.trim), lambda x: x != "")
    camel = F.regexp_extract_all(token, F.lit("([A-Z]?[^A-Z]+|[A-Z])"), F.lit(1))
    return (
        F.when((F.char_length(token) >= 25) & token.contains("|") & (F.size(bars) > 0), bars)
        .when((F.char_length(token) >= 20) & token.rlike("[a-z][A-Z]"), camel)
        .otherwise(F.array(token))
    )


def pipe_parts(token: Column) -> Column:
    parts = F.filter(F.transform(F.split(token, r"\|", -1), F.trim), lambda x: x != "")
    return F.when(token.contains("|") & (F.size(parts) > 0), parts).otherwise(F.array(token))


def comma_parts(token: Column) -> Column:
    return F.when(token.contains(",") & (token != ","), F.regexp_extract_all(token, F.lit("([^,]+|,)"), F.lit(1))).otherwise(F.array(token))


def colon_parts(token: Column) -> Column:
    apart = token.contains(":") & (token != ":") & ~token.contains("://")
    return F.when(apart, F.regexp_extract_all(token, F.lit("([^:]+|:)"), F.lit(1))).otherwise(F.array(token))


def bracket_parts(token: Column) -> Column:
    apart = token.rlike(r"[()\[\]{}]") & ~token.rlike(r"https?://|www\.|@") & ~token.rlike(r"^[()\[\]{}]+$")
    return F.when(apart, F.regexp_extract_all(token, F.lit(r"([^()\[\]{}]+|[()\[\]{}])"), F.lit(1))).otherwise(F.array(token))


DATE_RANGE = rf"^((?:(?:{MONTHS})[a-z.]*)?[0-9]{{4}})([-–—])((?:(?:{MONTHS})[a-z.]*)?[0-9]{{4}}|{OPEN_END})$"


def date_range_parts(token: Column) -> Column:
    """``2010-2014`` as start, separator and end."""
    return F.when(token.rlike(DATE_RANGE), F.array(*[F.regexp_extract(token, DATE_RANGE, i) for i in (1, 2, 3)])).otherwise(F.array(token))


def split_comma(tokens: DataFrame) -> DataFrame:
    """Commas become tokens; the first word keeps B-, later words are I- and commas O."""
    rows = split_into(tokens, comma_parts(F.col("token")))
    w = Window.partitionBy("doc_id", "page", "line_index", "token_index").orderBy("part")
    words = F.sum((F.col("token") != ",").cast("int")).over(running(w))
    entity = F.regexp_replace("bio_label", "^[BI]-", "")
    label = (
        F.when(F.col("token") == ",", F.lit("O"))
        .when((words > 1) & (F.col("bio_label") != "O"), F.concat(F.lit("I-"), entity))
        .otherwise(F.col("bio_label"))
    )
    return rows.withColumn("bio_label", label)


def split_colon(tokens: DataFrame) -> DataFrame:
    """Colons become tokens; only the last part keeps the label."""
    rows = split_into(tokens, colon_parts(F.col("token")))
    w = Window.partitionBy("doc_id", "page", "line_index", "token_index")
    last = F.col("part") == F.max("part").over(w)
    return rows.withColumn("bio_label", F.when(last, F.col("bio_label")).otherwise("O"))


def split_date_range(tokens: DataFrame) -> DataFrame:
    """Date ranges become B-SDATE, O and B-EDATE."""
    rows = split_into(tokens, date_range_parts(F.col("token")))
    many = F.max("part").over(Window.partitionBy("doc_id", "page", "line_index", "token_index")) > 0
    label = F.when(many, F.element_at(F.array(F.lit("B-SDATE"), F.lit("O"), F.lit("B-EDATE")), F.col("part") + 1)).otherwise(F.col("bio_label"))
    return rows.withColumn("bio_label", label)


def drop_lines_without_words(tokens: DataFrame) -> DataFrame:
    line = Window.partitionBy(*LINE_KEY)
    return tokens.withColumn("_a", F.max(F.col("token").rlike("[A-Za-z0-9]")).over(line)).filter("_a").drop("_a")


def insert_separators(tokens: DataFrame, separator: str = "[LINE]") -> DataFrame:
    """A separator row before each line of a document but its first."""
    doc = ordered(("doc_id",))
    first = (F.row_number().over(ordered(LINE_KEY, ("token_index",))) == 1) & (F.row_number().over(doc) > 1)
    both = F.when(first, F.array(F.lit(separator), F.col("token"))).otherwise(F.array("token"))
    rows = tokens.withColumn("_both", both).select("*", F.posexplode("_both").alias("_p", "_t"))
    is_separator = (F.size("_both") == 2) & (F.col("_p") == 0)
    return rows.withColumn("token", F.col("_t")).withColumn("is_separator", is_separator).drop("_both", "_p", "_t")


def strip_cid(tokens: DataFrame) -> DataFrame:
    """Drops the three tokens ``cid``, ``:`` and a number that stand for a glyph without text."""
    w = ordered()
    head = (F.col("token") == "cid") & (F.lead("token", 1).over(w) == ":") & F.lead("token", 2).over(w).rlike("^[0-9]+$")
    flagged = tokens.withColumn("_h", F.coalesce(head, F.lit(False)))
    inside = F.col("_h") | F.coalesce(F.lag("_h", 1).over(w), F.lit(False)) | F.coalesce(F.lag("_h", 2).over(w), F.lit(False))
    return flagged.withColumn("_in", inside).filter("NOT _in").drop("_h", "_in")


def chars_to_lines(glyphs: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Glyphs (doc_id, page, seq, top) with a line_index: a new line where the top moves by more than the tolerance."""
    w = Window.partitionBy("doc_id", "page").orderBy("top", "seq")
    moved = F.coalesce(F.abs(F.col("top") - F.lag("top").over(w)) > tolerance, F.lit(False))
    return island(glyphs, moved, w, "line_index")


def heights(glyphs: DataFrame, *also: str) -> DataFrame:
    """Glyphs of a page with one top (and the same ``also``) as one row: how many they are (n) and the first of them (seq).
    Equal finite tops are in one line, so that lines are told from these rows, far fewer than the glyphs, and only they are
    sorted."""
    return glyphs.groupBy("doc_id", "page", "top", *also).agg(F.count("*").alias("n"), F.min("seq").alias("seq"))


def glyphs_to_tokens(glyphs: DataFrame) -> DataFrame:
    """Glyphs of lines joined to tokens: a new one after white space or a gap over a fifth of the size or of 1.2 points."""
    w = Window.partitionBy(*LINE_KEY).orderBy("x0", "seq")
    blank = F.trim("text") == ""
    gap = F.col("x0") - F.lag("x1").over(w)
    starts = F.coalesce(F.lag(blank).over(w) | (gap > 0.2 * F.col("size")) | (gap >= 1.2), F.lit(True))
    runs = island(glyphs.withColumn("blank", blank), starts, w, "run").filter("NOT blank")
    rows = F.array_sort(F.collect_list(F.struct("x0", "seq", "text")))
    return runs.groupBy(*LINE_KEY, "run").agg(
        F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("token"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("size").alias("font_size")
    )


def dominant_font(glyphs: DataFrame, keys: list[str], n: str | None = None) -> DataFrame:
    """Most frequent font of each token (ties: smallest name), and its mean size. ``n``: the column that tells how many
    glyphs a row stands for; without it each is one."""
    many = F.col(n) if n else F.lit(1)
    counted = glyphs.groupBy(*keys, "fontname").agg(F.sum(many).alias("n"), F.sum(F.col("size") * many).alias("s"))
    return counted.groupBy(*keys).agg(F.min_by("fontname", F.struct(-F.col("n"), F.col("fontname"))).alias("fontname"), (F.sum("s") / F.sum("n")).alias("font_size"))


def is_bold_font(fontname: Column) -> Column:
    return F.lower(fontname).rlike("bold|black|heavy|semibold|demi")


def attach_links(tokens: DataFrame, links: DataFrame, cell: int = 80) -> DataFrame:
    """Each token's link rectangle with the largest overlap: a range join over bands of ``cell`` points."""
    bands = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell).cast("int"), F.floor(F.col(high) / cell).cast("int")))
    t = tokens.select("doc_id", "page", "line_index", "token_index", "x0", "x1", "y0", "y1", bands("y0", "y1").alias("band"))
    r = links.select("doc_id", "page", F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), F.col("top"), F.col("bottom"), "uri", bands("top", "bottom").alias("band"))
    wide = F.least("x1", "rx1") - F.greatest("x0", "rx0")
    high = F.least("y1", "bottom") - F.greatest("y0", "top")
    hit = t.join(r, ["doc_id", "page", "band"]).filter((wide > 0) & (high > 0)).withColumn("area", wide * high)
    best = hit.groupBy("doc_id", "page", "line_index", "token_index").agg(F.max_by("uri", F.struct("area", "uri")).alias("embedded_url"))
    return tokens.join(best, ["doc_id", "page", "line_index", "token_index"], "left")
