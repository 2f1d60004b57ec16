"""Entries: where a job, degree or project begins, and which tokens belong to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.islands import folded, ordered, running
from docweave.operators.fields import DATED_RX, MONTH_NAMES, OPEN_ENDS
from docweave.operators.tokenise import MONTHS, OPEN_END
from docweave.schema import LINE_KEY

DATE_RX = rf"(?:^|[^A-Za-z])(?:{MONTHS})[’'.,]? ?[’']?[0-9]{{2,4}}|(?:^|[^0-9])(?:19|20)[0-9]{{2}}(?:[^0-9]|$)|(?:^|[^A-Za-z])(?:{OPEN_END})(?:[^A-Za-z]|$)"
#: Bullets, the verbs that begin descriptions, and words of entries inside an entry.
BULLETS = ["•", "◦", "▪", "■", "●", "❖", "-", "–", "—", "*", "·"]
DESCRIPTION_VERBS = (
    "worked applied developed engineered championed implemented built participated prepared collaborated automated optimized leveraging utilizing "
    "designed created managed led supported assisted maintained delivered analyzed conducted performed"
).split()
SUB_ENTRY_WORDS = ["domain", "platform", "project"]
DATE_WORD_RX = rf"^(?:{MONTH_NAMES})[.]?$|^(?:{OPEN_ENDS})$|^(?:19|20)[0-9]{{2}}$|['‘’′] ?[0-9]{{2,4}}$"
SKIPPED = ["", '"', "'", ",", "|"]


def date_anchor(lines: DataFrame) -> DataFrame:
    """Whether a line holds a date, and where the first one starts (from 1)."""
    return lines.select(*LINE_KEY, F.col("text").rlike(DATE_RX).alias("has_date"), F.nullif(F.regexp_instr("text", F.lit("(?:19|20)[0-9]{2}")), F.lit(0)).alias("first_year"))


def exp_line_rules(lines: DataFrame, *kept: str) -> DataFrame:
    """Named predicates of an experience line; ``kept``: columns to keep. A description begins with a bullet, a bracket or
    such a verb, or has no date and holds such a verb; a line with a bar and a date goes on with an entry, and is one
    inside it if it names a domain, platform or project; ``has_role`` needs two words before the first date."""
    text = F.trim("text")
    low, words = F.lower(text), F.split(text, " +")
    first = F.coalesce(F.get(F.filter(words, lambda w: ~w.isin(SKIPPED)), F.lit(0)), F.lit(""))
    bare = F.transform(F.split(low, " +"), lambda w: F.regexp_replace(w, "^[.,;:]+|[.,;:]+$", ""))
    dated = low.rlike(DATED_RX)
    bullet = first.isin(BULLETS) | first.startswith("(") | F.lower(first).isin(DESCRIPTION_VERBS)
    prefix = F.regexp_extract(low, rf"^(.*?)(?:{DATED_RX})", 1)
    named = F.filter(F.transform(F.split(prefix, " +"), lambda w: F.regexp_replace(w, "^[.,;:|()—–-]+|[.,;:|()—–-]+$", "")), lambda w: (w != "") & ~w.rlike(DATE_WORD_RX))
    return lines.select(
        *LINE_KEY,
        *kept,
        F.coalesce(bullet, F.lit(False)).alias("is_bullet"),
        F.coalesce(bullet | (~dated & F.exists(bare, lambda w: w.isin(DESCRIPTION_VERBS))), F.lit(False)).alias("is_description"),
        F.coalesce(dated, F.lit(False)).alias("has_date"),
        F.coalesce(low.contains("internship") & dated & ~bullet, F.lit(False)).alias("is_internship"),
        F.coalesce(text.contains("|") & dated, F.lit(False)).alias("is_continuation"),
        F.coalesce(text.contains("|") & dated & low.rlike("|".join(SUB_ENTRY_WORDS)), F.lit(False)).alias("is_sub_entry"),
        F.coalesce(dated & (F.size(named) >= 2), F.lit(False)).alias("has_role"),
        F.coalesce(text.contains("|"), F.lit(False)).alias("has_bar"),
    )


EXP_RULES = ["is_bullet", "is_description", "has_date", "is_internship", "is_continuation", "is_sub_entry", "has_role", "has_bar"]


def heads(lines: DataFrame, is_head: Column, section: str) -> DataFrame:
    """Head lines of a section, in order."""
    return lines.filter(is_head & (F.col("section") == section)).select(*LINE_KEY).distinct()


#: Bullets of entries and of what lies inside them, marks that are passed over at the start of a line, legal
#: forms of firms, and the titles of the section.
MAIN_BULLETS, SUB_BULLETS = ["•", "●", "▪"], ["◦", "∗", "*", "·"]
LINE_MARKS = ["", '"', "'", ",", "|"]
FIRM_FORMS = ["pvt", "ltd", "inc", "llc", "limited"]
WORK_TITLES = ["experience", "work experience", "professional experience", "employment"]


def slice_heads(lines: DataFrame) -> DataFrame:
    """Lines (text, ``begins``: their first token was scored as a start) at which entries are cut: without those that only
    date, those of bullets inside an entry, those that go on with one (a bracket or bar, a date, a firm's form, unless a
    main bullet begins them) and the section's title."""
    low, words = F.lower(F.trim("text")), F.split(F.trim("text"), " +")
    first = F.get(F.filter(words, lambda x: ~x.isin(LINE_MARKS)), F.lit(0))
    dated = low.rlike(DATED_RX)
    date_word = lambda x: F.lower(x).rlike(DATE_WORD_RX) | F.lower(x).rlike(DATED_RX)
    other = F.exists(words, lambda x: (F.char_length(x) > 3) & ~date_word(x) & ~x.isin(MAIN_BULLETS + SUB_BULLETS))
    date_only = dated & (first.isin("(", "|") | ~other)
    goes_on = ~first.isin(MAIN_BULLETS) & (first.isin("(", "|") | dated | low.rlike("|".join(FIRM_FORMS)))
    head = F.col("begins") & first.isNotNull() & ~date_only & ~first.isin(SUB_BULLETS) & ~goes_on & ~low.isin(WORK_TITLES)
    return lines.filter(F.coalesce(head, F.lit(False))).select(*LINE_KEY)


def exp_style_heads(lines: DataFrame) -> DataFrame:
    """The most frequent bold style (size, rounded x; ties: the first seen) of a document's experience makes its heads."""
    w = ordered(("doc_id",), ("page", "line_index"))
    bold = lines.filter("is_bold AND kind <> 'heading'").withColumn("pos", F.row_number().over(w))
    styles = bold.groupBy("doc_id", "font_median", F.round("x0").alias("indent")).agg(F.count("*").alias("n"), F.min("pos").alias("f"))
    best = styles.groupBy("doc_id").agg(F.max_by(F.struct("font_median", "indent"), F.struct("n", -F.col("f"))).alias("best"))
    joined = lines.join(best, "doc_id", "left")
    same = F.col("is_bold") & (F.col("kind") != "heading") & (F.col("font_median") == F.col("best.font_median")) & (F.round("x0") == F.col("best.indent"))
    return joined.withColumn("is_head", F.coalesce(same, F.lit(False))).drop("best")


def exp_boundary_fix(lines: DataFrame, gap: int = 5) -> DataFrame:
    """``is_head`` of experience lines with the columns of ``exp_line_rules`` and ``begins`` (a token was scored as a start),
    ``inside`` (one as going on) and ``hinted`` (a label says so).

    A start goes on a description, on a line without a date and on one that goes on with an entry, unless it is hinted. A
    line without a start becomes one if it is hinted and dated, an internship, an entry inside an entry, or a bullet that
    was scored as going on; or if it was scored as going on, has a role before its date and no bar, is no description, and
    no head stands within ``gap`` lines before it on the page. Only that last rule looks at earlier decisions: the fold
    begins anew at each head that stands whatever came before."""
    w = ordered(("doc_id",), ("page", "line_index"))
    c = {k: F.coalesce(F.col(k), F.lit(False)) for k in ("begins", "inside", "hinted", *EXP_RULES)}
    stays = c["begins"] & (c["hinted"] | ~(c["is_description"] | ~c["has_date"] | c["is_continuation"]))
    shown = c["hinted"] & (c["has_date"] | c["is_internship"] | c["is_sub_entry"] | (c["is_bullet"] & c["inside"]))
    sure = stays | (~c["begins"] & shown)
    may = ~c["begins"] & ~c["is_description"] & c["has_date"] & c["inside"] & ~c["has_bar"] & c["has_role"]
    placed = lines.select(*LINE_KEY, sure.alias("sure"), may.alias("may")).withColumn("entry", F.sum(F.col("sure").cast("int")).over(running(w)))

    def step(s: Column, row: Column) -> Column:
        recent = (row["page"] == s["page"]) & (row["line_index"] - s["line"]).between(1, gap)
        now = row["sure"] | (row["may"] & ~F.coalesce(recent, F.lit(False)))
        return F.struct(F.when(now, row["page"]).otherwise(s["page"]).alias("page"), F.when(now, row["line_index"]).otherwise(s["line"]).alias("line"), now.alias("is_head"))

    start = F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("line"), F.lit(False).alias("is_head"))
    out = folded(placed, ("doc_id", "entry"), ("page", "line_index"), start, "struct<page:int,line:int,is_head:boolean>", step, "is_head", "boolean")
    return out.select(*LINE_KEY, "is_head")


def demote_dates(tokens: DataFrame) -> DataFrame:
    """A B-ENTRY on a date token becomes I-ENTRY."""
    dated = F.col("token").rlike(rf"^(?:{MONTHS})[’'.,]?[0-9]*$|^[(]?(?:19|20)[0-9]{{2}}|^(?:{OPEN_END})$")
    return tokens.withColumn("entry_label", F.when((F.col("entry_label") == "B-ENTRY") & dated, "I-ENTRY").otherwise(F.col("entry_label")))


def expand_span(tokens: DataFrame, head_lines: DataFrame) -> DataFrame:
    """Head lines: the first alphanumeric token is B-ENTRY; all tokens to the next head I-ENTRY; before any head O."""
    marked = tokens.join(head_lines.select(*LINE_KEY, F.lit(True).alias("_head")), list(LINE_KEY), "left")
    line = ordered(LINE_KEY, ("token_index",))
    alnum = F.col("token").rlike("[A-Za-z0-9]")
    nth = F.sum(alnum.cast("int")).over(running(line))
    begun = F.max(F.col("_head").isNotNull().cast("int")).over(running(ordered()))
    label = F.when(F.col("_head").isNotNull() & alnum & (nth == 1), "B-ENTRY").when(begun == 1, "I-ENTRY").otherwise("O")
    return marked.withColumn("entry_label", label).drop("_head")


def group_entries(tokens: DataFrame, head_lines: DataFrame) -> DataFrame:
    """entry_id of every token by its document's last head line. Tokens before the first head go; a document without heads is one entry."""
    marked = tokens.join(head_lines.select(*LINE_KEY, F.lit(1).alias("_head")), list(LINE_KEY), "left")
    first = (F.row_number().over(ordered(LINE_KEY, ("token_index",))) == 1) & F.col("_head").isNotNull()
    flagged = marked.withColumn("_f", first.cast("int"))
    counted = flagged.withColumn("n", F.sum("_f").over(running(ordered()))).withColumn("_all", F.sum("_f").over(Window.partitionBy("doc_id")))
    return counted.filter("n > 0 OR _all = 0").withColumn("entry_id", F.greatest(F.col("n") - 1, F.lit(0))).drop("_head", "_f", "_all", "n")


def group_entries_by_height(tokens: DataFrame, head_lines: DataFrame) -> DataFrame:
    """Row bands for tables: from three points above a head to 1.5 points above the next one; bands may overlap."""
    at = head_lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("y0")).alias("_ys"))
    bands = at.select("doc_id", "page", F.posexplode("_ys").alias("band", "top"), "_ys").withColumn("bottom", F.coalesce(F.get("_ys", F.col("band") + 1), F.lit(1e9))).drop("_ys")
    return tokens.join(bands, ["doc_id", "page"]).filter((F.col("y0") >= F.col("top") - 3) & (F.col("y0") < F.col("bottom") - 1.5))


def collapse_heights(head_lines: DataFrame) -> DataFrame:
    """One head in a band of three points: the leftmost, then the first line."""
    band = F.bround(F.col("y0") / 3) * 3
    return head_lines.groupBy("doc_id", "page", band.alias("band")).agg(F.min_by("line_index", F.struct("x0", "line_index")).alias("line_index"))


def shift_heads(lines: DataFrame, structural: Column, candidate: Column) -> DataFrame:
    """A head on a structural line moves to the next line that is a candidate."""
    w = ordered(("doc_id",), ("page", "line_index"))
    key = F.struct("page", "line_index")
    ahead = F.first(F.when(candidate, key), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    moved = F.when(structural, ahead).otherwise(key)
    return lines.withColumn("_to", F.when(F.col("is_head"), moved)).filter("_to IS NOT NULL").select("doc_id", F.col("_to.page").alias("page"), F.col("_to.line_index").alias("line_index")).distinct()


def label_segments(segments: DataFrame, head_lines: DataFrame) -> DataFrame:
    """Truth labels of segments (seg_index, line_run): the first segment of a head line is B-ENTRY and the rest of that
    line I-ENTRY, all others O. A head line is claimed once, by the first run of segments on it."""
    marked = segments.join(head_lines.select(*LINE_KEY, F.lit(True).alias("_head")).distinct(), list(LINE_KEY), "left")
    claims = F.col("_head").isNotNull() & (F.col("line_run") == F.min("line_run").over(Window.partitionBy(*LINE_KEY)))
    first = F.row_number().over(ordered(("doc_id", "line_run"), ("seg_index",))) == 1
    return marked.withColumn("label", F.when(claims & first, "B-ENTRY").when(claims, "I-ENTRY").otherwise("O")).drop("_head")


def scope_heads(head_lines: DataFrame, section_lines: DataFrame) -> DataFrame:
    """Heads with ``in_section``; those outside are orphans."""
    inside = head_lines.join(section_lines, list(LINE_KEY), "left_semi").withColumn("in_section", F.lit(True))
    outside = head_lines.join(section_lines, list(LINE_KEY), "left_anti").withColumn("in_section", F.lit(False))
    return inside.unionByName(outside)


def collapse_anchor(segments: DataFrame) -> DataFrame:
    """The first segment of each line group that lies in the section."""
    return segments.filter("in_section").groupBy("doc_id", "line_run").agg(F.min("seg_index").alias("seg_index"))


#: What makes a date the end of an open range (lower case).
OPEN_RANGE_RX = "(?:^|[^a-z0-9_])(?:present|date|till)(?:[^a-z0-9_]|$)"


def date_roles(rows: DataFrame, title: Column, dated: Column, text: Column, half: Column | None = None) -> DataFrame:
    """``date_role`` of the dated rows of each document: SDATE opens a range, EDATE closes it. The first date after a title
    opens, the next closes, the one after that opens again; an open end closes without counting, and so does a half of a
    split range (``half``: left or right), which is what its side says. A title begins anew. Dates that count open and
    close in turn, so that their number since the last title tells their role: a window, no fold."""
    half = F.lit(None).cast("string") if half is None else half
    open_end = F.lower(text).rlike(OPEN_RANGE_RX)
    w = ordered()
    marked = rows.withColumn("_title", F.coalesce(title, F.lit(False)).cast("int")).withColumn("_dated", F.coalesce(dated, F.lit(False))).withColumn("_open", F.coalesce(open_end, F.lit(False))).withColumn("_half", half)
    run = marked.withColumn("_run", F.sum("_title").over(running(w)))
    counts = F.col("_dated") & ~F.col("_open") & F.col("_half").isNull()
    nth = F.sum(counts.cast("int")).over(running(ordered(("doc_id", "_run"))))
    role = F.when(F.col("_open"), "EDATE").when(F.col("_half") == "right", "EDATE").when(F.col("_half") == "left", "SDATE").when(nth % 2 == 0, "EDATE").otherwise("SDATE")
    return run.withColumn("date_role", role).filter("_dated").drop("_title", "_dated", "_open", "_half", "_run")
