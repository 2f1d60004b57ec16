"""Reading order, layout and numeric features."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.islands import carry_last, folded, island, lower_median, ordered, running
from docweave.functions.numbers import rounded
from docweave.operators.headings import has
from docweave.schema import LINE_KEY


def order_simple(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("read_pos", F.row_number().over(ordered(("doc_id",), ("page", "y0", "x0", "token_index"))))


GROUP = ("doc_id", "page", "section")
#: Sections read row by row, and those read line by line; all others may have two columns.
BY_ROW = ["PERSONAL", "SUMMARY", "SKILLS"]
BY_LINE = ["EXPERIENCE", "EDUCATION", "PROJECT"]


def visual_rows(tokens: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """``row`` of each token of a group, downwards: a token joins the last row while it lies within max(4, 0.4 of the row's
    mean height) of the row's mean height on the page. A fold, as both means move with each token."""

    def step(s: Column, t: Column) -> Column:
        reach = F.greatest(F.lit(4.0), 0.4 * s["tall"] / s["n"])
        joins = (s["n"] > 0) & (F.abs(t["y0"] - s["high"] / s["n"]) < reach)
        kept = F.when(joins, 1.0).otherwise(0.0)
        return F.struct(
            (s["high"] * kept + t["y0"]).alias("high"), (s["tall"] * kept + t["y1"] - t["y0"]).alias("tall"), (s["n"] * kept.cast("int") + 1).alias("n"),
            F.when(joins, s["row"]).otherwise(s["row"] + 1).alias("row"),
        )

    start = F.struct(F.lit(0.0).alias("high"), F.lit(0.0).alias("tall"), F.lit(0).alias("n"), F.lit(-1).alias("row"))
    return folded(tokens, keys, ("y0", "line_index", "token_index"), start, "struct<high:double,tall:double,n:int,row:int>", step, "row", "int")


def order_reading(tokens: DataFrame) -> DataFrame:
    """Sections of a page by their mean height (then as they first appear). Inside them: by visual rows, by lines, or, for
    sections that may have columns, the left column before the right where a gutter is confirmed, else by lines. One
    composite key gives ``read_pos``."""
    group = Window.partitionBy(*GROUP)
    placed = tokens.withColumn("_at", F.row_number().over(ordered())).withColumn("section_y", F.round(F.avg("y0").over(group), 6)).withColumn("_seen", F.min("_at").over(group))
    rows = visual_rows(placed.filter(F.col("section").isin(BY_ROW))).withColumn("_k", F.struct(F.lit(0).alias("column"), F.col("row").cast("double").alias("down"), F.col("x0").alias("across"))).drop("row")
    rest = placed.filter(~F.coalesce(F.col("section").isin(BY_ROW), F.lit(False)))
    gutters = detect_gutter(rest.filter(~F.coalesce(F.col("section").isin(BY_LINE), F.lit(False)))).filter("has_gutter").select(*GROUP, "gutter_x")
    split = _joined(rest, gutters, GROUP, "left")
    right = ((F.col("x0") + F.col("x1")) / 2 >= F.col("gutter_x")).cast("int")
    key = F.struct(F.coalesce(right, F.lit(0)).alias("column"), F.when(F.col("gutter_x").isNotNull(), F.col("y0")).otherwise(F.col("line_index").cast("double")).alias("down"), F.col("x0").alias("across"))
    both = rows.unionByName(split.withColumn("_k", key).drop("gutter_x"))
    order = ("page", "section_y", "_seen", "_k.column", "_k.down", "_k.across", "_at")
    return both.withColumn("read_pos", F.row_number().over(ordered(("doc_id",), order))).drop("_k", "_at", "_seen")


def detect_gutter(tokens: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """For each group the first whole x between 5 and 55 % of its width that fewest tokens with a letter or digit cover, how
    many those are, and whether it is a gutter: few cover it (three, or under 8 %), and at least two lines leave it free
    with 10 to 150 points between the tokens beside it.

    A sweep: a token covers the whole numbers between its ends, +1 where that begins and -1 after it; the running sum of
    these steps by x is the cover, which changes only there."""
    word = F.col("token").rlike("[A-Za-z0-9]")
    extent = tokens.groupBy(*keys).agg(F.min("x0").alias("_low"), F.max("x1").alias("_high"), F.count("*").alias("n_tokens"))
    width = F.col("_high") - F.col("_low")
    scans = extent.select(*keys, (F.col("_low") + 0.05 * width).cast("int").alias("scan_start"), (F.col("_low") + 0.55 * width).cast("int").alias("scan_end"), "n_tokens").filter("scan_end > scan_start")
    begins, ends = (F.floor("x0") + 1).cast("int"), F.ceil("x1").cast("int")
    steps = tokens.filter(word & (begins < ends)).select(*keys, F.explode(F.array(F.struct(begins.alias("x"), F.lit(1).alias("d")), F.struct(ends.alias("x"), F.lit(-1).alias("d")))).alias("_step")).select(*keys, F.col("_step")["x"].alias("x"), F.col("_step")["d"].alias("d"))
    events = steps.unionByName(scans.select(*keys, F.col("scan_start").alias("x"), F.lit(0).alias("d"))).groupBy(*keys, "x").agg(F.sum("d").alias("d"))
    cover = events.withColumn("overlaps", F.sum("d").over(running(ordered(keys, ("x",)))))
    inside = _joined(cover, scans, keys).filter("x BETWEEN scan_start AND scan_end")
    best = inside.groupBy(*keys).agg(F.min_by("x", F.struct("overlaps", "x")).alias("gutter_x"), F.min("overlaps").alias("overlaps"), F.max("n_tokens").alias("n_tokens"))

    beside = _joined(tokens.select(*keys, "line_index", "x0", "x1"), best, keys)
    x = F.col("gutter_x")
    sides = beside.groupBy(*keys, "line_index").agg(F.max((F.col("x0") < x) & (x < F.col("x1"))).alias("crossed"), F.max(F.when(F.col("x1") <= x, F.col("x1"))).alias("left"), F.min(F.when(F.col("x0") >= x, F.col("x0"))).alias("right"))
    free = sides.filter(~F.col("crossed") & (F.col("right") - F.col("left")).between(10, 150)).groupBy(*keys).agg(F.count("*").alias("free_lines"))
    few = (F.col("overlaps") <= 3) | (F.col("overlaps") < 0.08 * F.col("n_tokens"))
    return _joined(best, free, keys, "left").select(*keys, "gutter_x", "overlaps", (few & (F.coalesce("free_lines", F.lit(0)) >= 2)).alias("has_gutter"))


def _joined(a: DataFrame, b: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on equal keys, null equal to null: a section may be unknown."""
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    return a.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), how).drop(*[f"_{k}" for k in keys])


def rebuild_line_index(tokens: DataFrame, gap: float = 30.0) -> DataFrame:
    """A new line where the old line or section changes or the gap is wide."""
    w = ordered(("doc_id", "page"), ("line_index", "token_index"))
    starts = (F.col("line_index") != F.lag("line_index").over(w)) | (F.col("section") != F.lag("section").over(w)) | (F.col("x0") - F.lag("x1").over(w) > gap)
    return island(tokens, F.coalesce(starts, F.lit(False)), w, "new_line")


def restore_line_index(tokens: DataFrame, original: DataFrame) -> DataFrame:
    """The original line of each token, found by its rounded place; of several the last."""
    key = [F.col("doc_id"), F.col("page"), F.round("x0", 2).alias("rx"), F.round("y0", 2).alias("ry")]
    known = original.select(*key, "line_index", "token_index").groupBy("doc_id", "page", "rx", "ry").agg(F.max_by("line_index", F.struct("line_index", "token_index")).alias("restored_line"))
    return tokens.withColumn("rx", F.round("x0", 2)).withColumn("ry", F.round("y0", 2)).join(known, ["doc_id", "page", "rx", "ry"], "left").drop("rx", "ry")


def line_ordinals(tokens: DataFrame) -> DataFrame:
    """Page-relative and document-wide line numbers."""
    lines = tokens.select(*LINE_KEY).distinct()
    return lines.withColumn("doc_line", F.dense_rank().over(ordered(("doc_id",), ("page", "line_index"))) - 1)


def doc_medians(tokens: DataFrame) -> DataFrame:
    """Median font size, gap inside lines and line height of each document."""
    w = ordered(LINE_KEY, ("token_index",))
    gaps = tokens.withColumn("gap", F.col("x0") - F.lag("x1").over(w)).withColumn("height", F.col("y1") - F.col("y0")).withColumn("gap", F.when(F.col("gap") > 0, F.col("gap")))
    return gaps.groupBy("doc_id").agg(F.expr("percentile(font_size, 0.5)").alias("font"), F.expr("percentile(gap, 0.5)").alias("gap"), lower_median("height").alias("height"))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def line_vector(lines: DataFrame) -> DataFrame:
    """Ten numbers for each line: place and size within the document, style, and rank."""
    doc = Window.partitionBy("doc_id")
    rank = (F.row_number().over(ordered(("doc_id",), ("page", "line_index"))) - 1) / F.greatest(F.lit(1), F.count("*").over(doc) - 1)

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(doc), F.max(c).over(doc)
        return F.when(high > low, clamp((F.col(c) - low) / (high - low))).otherwise(0.0)

    parts = [*(scaled(c) for c in ("x0", "y0", "x1", "y1", "font_median")), F.col("is_bold").cast("double"), F.col("is_caps").cast("double"), clamp(F.col("n_tokens") / 20.0), F.col("text").endswith(":").cast("double"), rank]
    return lines.select(*LINE_KEY, F.array(*[rounded(p) for p in parts]).alias("v"))


def line_context(lines: DataFrame, most: int = 120) -> DataFrame:
    """Neighbouring lines' text and the gap to the line before."""
    w = ordered(("doc_id",), ("page", "line_index"))
    gap = F.when(F.lag("page").over(w) == F.col("page"), F.col("y0") - F.lag("y1").over(w))
    text = F.concat_ws(" [SEP] ", F.coalesce(F.substring(F.lag("text").over(w), 1, most), F.lit("")), F.col("text"), F.coalesce(F.substring(F.lead("text").over(w), 1, most), F.lit("")))
    return lines.select(*LINE_KEY, text.alias("context"), gap.alias("gap"))


def delimiter_distance(tokens: DataFrame, most: int = 10) -> DataFrame:
    """Tokens since the line's start or the last delimiter, at most ten."""
    w = ordered(LINE_KEY, ("token_index",))
    placed = tokens.withColumn("pos", F.row_number().over(w))
    reset = F.when(F.col("token").isin("|", "-", "(", ")", "•", ",", ":") | (F.col("pos") == 1), F.col("pos"))
    return placed.withColumn("delimiter_distance", F.least(F.lit(most), F.col("pos") - carry_last(reset, w)))


def heading_distance(lines: DataFrame, heading: Column) -> DataFrame:
    """Lines since the page's last heading, else 99."""
    w = ordered(("doc_id", "page"), ("line_index",))
    return lines.withColumn("heading_distance", F.coalesce(F.col("line_index") - carry_last(F.when(heading, F.col("line_index")), w), F.lit(99)))


def token_vector(tokens: DataFrame) -> DataFrame:
    """Ten numbers of each token: steps from the last one on its page in units of the document's medians, style, and what
    its line is like. The rows are sorted once, in the order of the document; its lines and pages are runs of that order."""
    m = doc_medians(tokens).select("doc_id", F.greatest(F.coalesce("gap", F.lit(1.0)), F.lit(1e-6)).alias("mg"), F.greatest("height", F.lit(1e-6)).alias("mh"))
    w, line, page, doc = ordered(), Window.partitionBy(*LINE_KEY), Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id")
    c = F.col
    told = tokens.filter("doc_id IS NOT NULL").withColumns({f"_{x}": F.lag(x).over(w) for x in ("page", "line_index", "x1", "y1")})
    told = told.withColumns({"_low": F.min("y0").over(doc), "_down": F.max("y1").over(doc), "_font": F.max("font_size").over(doc), "_lines": F.max("line_index").over(page)})
    # a line is in capitals if all its tokens are as in capitals and one is not as in small letters: no text is joined
    upper, lower = c("token") == F.upper("token"), c("token") == F.lower("token")
    of_line = {"_n": F.count("*"), "_chars": F.sum(F.char_length("token")), "_upper": F.min(upper), "_lower": F.min(lower), "_head": F.min_by("token", F.struct("x0", "token_index"))}
    told = told.withColumns({k: x.over(line) for k, x in of_line.items()})
    same = c("_page") == c("page")
    high = F.greatest(c("_down") - c("_low"), F.lit(1e-6))
    dx = F.when(same, (c("x0") - c("_x1")) / c("mg")).otherwise(0.0)
    dy = F.when(same, (c("y0") - c("_y1")) / c("mh")).otherwise(F.when(c("_page").isNotNull(), c("y0") / high).otherwise(0.0))
    new = ~(same & (c("_line_index") == c("line_index")))
    bullet = c("_head").isin("•", "*", "-", "▪", "◦", "■", "–", "—", "·", "✓", "✔")
    parts = [
        rounded(dx), rounded(dy), F.coalesce(new, F.lit(True)), c("is_bold"), upper & ~lower & (F.char_length("token") > 1), rounded(c("font_size") / c("_font")),
        rounded(F.least(c("_n"), F.lit(15)) / 15), F.coalesce(c("_upper") & ~c("_lower") & (c("_chars") > 1), F.lit(False)), bullet, rounded(c("line_index") / F.greatest(c("_lines"), F.lit(1))),
    ]
    return told.join(m, "doc_id").select("doc_id", "page", "line_index", "token_index", F.array(*[p.cast("double") for p in parts]).alias("v"))


def font_stats(tokens: DataFrame) -> DataFrame:
    """Largest, most frequent (ties: smallest) and smallest font size of each section."""
    sizes = tokens.groupBy("doc_id", "section", "font_size").agg(F.count("*").alias("n"))
    return sizes.groupBy("doc_id", "section").agg(F.max("font_size").alias("largest"), F.min_by("font_size", F.struct(-F.col("n"), F.col("font_size"))).alias("usual"), F.min("font_size").alias("smallest"))


#: Fixed values of the likeness of a line to a project's title: weight, what the text shows (lower case, without bullet),
#: and the most words that it may have.
TITLE_RULES = [
    (0.35, r"\| *(?:github|gitlab|demo|live|link)(?:[^a-z0-9_]|$)", None),
    (0.45, "^code *link", None),
    (0.35, "live *demo", None),
    (0.4, r"\| *(?:mern|mean|jwt|react|spring|socket|redux|razorpay|cloudinary|hibernate|hadoop|kafka)", None),
    (0.35, r"^[a-z0-9_ &()-]+\| *[a-z0-9_ ,.+()-]+", None),
    (0.35, "^domain *:", None),
    (0.3, r"(?:^|[^a-z0-9_])(?:limited|ltd|inc|corp|pvt|llc|technologies|solutions) *[.]* *$", 5),
    (0.25, "(?:^|[^a-z0-9_])project(?:[^a-z0-9_]|$)", 12),
    (0.25, "^(?:analysis|classification|detection|recognition) *,", None),
    (0.2, "(?:^|[^a-z0-9_])api[.]? *$", None),
    (0.2, r"^\( *\) +", None),
    (0.2, "^[0-9]+[.] +[a-z0-9_]", None),
    (0.15, r"(?:\|| *, *)$", None),
]
#: For each of these rules the parts of which a text that it holds for has one at least: asked first, as they cost little.
FIRM_FORMS = ["limited", "ltd", "inc", "corp", "pvt", "llc", "technologies", "solutions"]
TITLE_PARTS = [["|"], ["code"], ["demo"], ["|"], ["|"], ["domain"], FIRM_FORMS, ["project"], [","], ["api"], ["("], ["."], ["|", ","]]
#: A capital, then a name of up to 80 characters before a colon; case counts, so that it stands apart.
COLON_TITLE = (0.3, "^[A-Z][A-Za-z0-9_ &()-]{2,80} *:", 14)


def _bare_title(text: Column) -> Column:
    return F.trim(F.ltrim(F.trim(text), F.lit("•*●·▪■◦✓✔ -")))


def _n_words(clean: Column) -> Column:
    blanks = F.char_length(clean) - F.char_length(F.replace(clean, F.lit(" "), F.lit("")))
    return F.when(clean.contains("  "), F.size(F.split(clean, " +"))).otherwise(blanks + 1)


def _shown(clean: Column, low: Column, words: Column) -> Column:
    def shown(value: Column, weight: float, rx: str, most: int | None, parts: list[str]) -> Column:
        may = has(value, *parts) if most is None else has(value, *parts) & (words <= most)
        return F.when(may & value.rlike(rx), weight).otherwise(0.0)

    score = sum((shown(low, *rule, parts) for rule, parts in zip(TITLE_RULES, TITLE_PARTS, strict=True)), shown(clean, *COLON_TITLE, [":"]))
    return F.least(F.lit(1.0), score)


def title_likeness(text: Column) -> Column:
    """How much a line looks like a project's title, from 0 to 1: the sum of what it shows."""
    clean = _bare_title(text)
    return F.when(clean == "", 0.0).otherwise(F.round(_shown(clean, F.lower(clean), _n_words(clean)), 6))


def with_likeness(lines: DataFrame) -> DataFrame:
    """Lines (text) with their ``likeness``, the title_likeness of the text; what all its rules ask is told once."""
    told = lines.withColumn("_clean", _bare_title(F.col("text")))
    told = told.withColumns({"_lower": F.lower("_clean"), "_words": _n_words(F.col("_clean"))}).withColumn("_score", _shown(F.col("_clean"), F.col("_lower"), F.col("_words")))
    return told.withColumn("likeness", F.when(F.col("_clean") == "", 0.0).otherwise(rounded(F.col("_score")))).drop("_clean", "_lower", "_words", "_score")
