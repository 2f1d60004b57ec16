"""Phrase segments, scores, labels and the rules that mend them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.islands import after, before, carry_last, first_seen_mode, folded, island, ordered, ordered_text, running, upper_median
from docweave.schema import LINE_KEY

SEPARATORS = ["|", "•", "·", ",", "/", "-", "–", "(", ")"]


def entity(label: Column) -> Column:
    return F.regexp_replace(label, "^[BI]-", "")


def seg_gap(tokens: DataFrame, least: float = 40.0) -> DataFrame:
    """B-SEG where the gap to the last token of the line is at least 3 upper medians of the line's gaps, and 40 points."""
    w = ordered(LINE_KEY, ("token_index",))
    gaps = tokens.withColumn("gap", F.col("x0") - F.lag("x1").over(w))
    median = gaps.filter("gap > 0").groupBy(*LINE_KEY).agg(upper_median("gap").alias("median_gap"))
    word = F.col("token").rlike("[A-Za-z0-9]")
    wide = word & F.lag(word).over(w) & (F.col("gap") >= F.greatest(F.lit(least), 3 * F.coalesce("median_gap", F.lit(0.0))))
    return gaps.join(median, list(LINE_KEY), "left").withColumn("seg", F.when(F.coalesce(wide, F.lit(False)), "B-SEG").otherwise("I-SEG"))


def seg_style(tokens: DataFrame, gap: float = 35.0) -> DataFrame:
    w = ordered(LINE_KEY, ("token_index",))
    opens = (F.col("is_bold") != F.lag("is_bold").over(w)) | (F.abs(F.col("font_size") - F.lag("font_size").over(w)) > 0.5) | (F.col("x0") - F.lag("x1").over(w) > gap)
    return tokens.withColumn("seg", F.when(F.coalesce(opens, F.lit(True)), "B-SEG").otherwise("I-SEG"))


def seg_continuity(tokens: DataFrame) -> DataFrame:
    """A B-SEG right after a labelled word of the same line continues it."""
    w = ordered(LINE_KEY, ("token_index",))
    word = F.col("token").rlike("[A-Za-z0-9]")
    joined = (F.col("seg") == "B-SEG") & word & F.lag(word).over(w) & (F.lag("seg").over(w) != "O")
    return tokens.withColumn("seg", F.when(F.coalesce(joined, F.lit(False)), "I-SEG").otherwise(F.col("seg")))


def desc_lock(tokens: DataFrame) -> DataFrame:
    """Nothing opens between the first and the last description token of an entry."""
    entry = Window.partitionBy("doc_id", "entry_id")
    placed = tokens.withColumn("pos", F.row_number().over(ordered(("doc_id", "entry_id"))))
    at = F.when(F.col("bio_label").endswith("-DESC"), F.col("pos"))
    locked = F.col("pos").between(F.min(at).over(entry) + 1, F.max(at).over(entry))
    return placed.withColumn("seg", F.when(F.coalesce(locked, F.lit(False)), "I-SEG").otherwise(F.col("seg")))


def seg_repair(tokens: DataFrame) -> DataFrame:
    """Separators are O, the first word and one after a separator B-SEG, the rest I-SEG or what opened it."""
    w = ordered(LINE_KEY, ("token_index",))
    separator = F.col("token").isin(SEPARATORS)
    fresh = F.coalesce(F.lag(separator).over(w), F.lit(True))
    return tokens.withColumn("seg", F.when(separator, "O").when(fresh | (F.col("seg") == "B-SEG"), "B-SEG").otherwise("I-SEG"))


def split_blocks(tokens: DataFrame, gap: float = 40.0) -> DataFrame:
    """Phrase blocks of a document: apart at a bracket before a date, delimiters, new lines and wide gaps, and where a B-
    label is of another class than the block's first one. Between the other bounds all B- labels of a block are of one
    class, so that the last one before tells it, unless a bound came since. All windows have the order of the document: it
    is sorted once."""
    w = ordered()
    new_line = (F.col("page") != F.lag("page").over(w)) | (F.col("line_index") != F.lag("line_index").over(w))
    bracket = (F.col("token") == "(") & F.coalesce(F.lead("bio_label").over(w), F.lit("O")).endswith("-DATE")
    bound = bracket | F.col("token").isin("|", "•") | F.lag("token").over(w).isin("|", "•") | new_line | (F.col("x0") - F.lag("x1").over(w) > gap)
    bounded = tokens.withColumns({"_bound": F.coalesce(bound, F.lit(True)), "_at": F.row_number().over(w)})
    begins = F.col("bio_label").startswith("B-")
    last = F.last(F.when(begins, F.col("bio_label")), ignorenulls=True).over(before(w))
    last_at = F.last(F.when(begins, F.col("_at")), ignorenulls=True).over(before(w))
    since = carry_last(F.when(F.col("_bound"), F.col("_at")), w)
    switch = F.coalesce(begins & (F.col("bio_label") != last) & (last_at >= since), F.lit(False))
    return island(bounded.withColumn("_starts", F.col("_bound") | switch), F.col("_starts"), w, "block").drop("_bound", "_at", "_starts")


def block_rows(blocks: DataFrame) -> DataFrame:
    begins = F.col("bio_label").startswith("B-")
    label = F.min_by(F.when(begins, F.substring("bio_label", 3, 2**31 - 1)), F.when(begins, F.struct("page", "line_index", "token_index")))
    return blocks.groupBy("doc_id", "block").agg(ordered_text().alias("text"), F.coalesce(label, F.lit("O")).alias("label"), F.min(F.struct("page", "line_index", "token_index")).alias("at"))


MONTH_NAMES = "jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december"
#: Open ends, and words that make a dated text more than a date.
OPEN_ENDS = "present|current|ongoing|now"
NOT_A_DATE = ["project", "client", "developer", "engineer", "intern"]
WORD_START, WORD_END = "(?:^|[^a-z0-9_])", "(?:[^a-z0-9_]|$)"
#: A date in a text (lower case): a month, a year, an open end, or a year after an apostrophe.
DATED_RX = rf"{WORD_START}(?:{MONTH_NAMES}|(?:19|20)[0-9]{{2}}|{OPEN_ENDS}){WORD_END}|{WORD_START}(?:{MONTH_NAMES})[.]? ?['‘’′]? ?(?:[0-9]{{4}}|[0-9]{{2}}){WORD_END}|['‘’′] ?(?:[0-9]{{4}}|[0-9]{{2}}){WORD_END}"


def is_date_piece(text: Column) -> Column:
    """Whether a block is a piece of a date range: a single bracket, marks only, or a date without words that name
    something else; what a bullet begins is none."""
    low = F.lower(F.trim(text))
    other = F.arrays_overlap(F.split(low, " +"), F.array(*[F.lit(w) for w in NOT_A_DATE]))
    return ~low.rlike("^[•◦▪∗*■●]") & (low != "") & (~low.rlike(r"[\p{L}\p{N}]") | (low.rlike(DATED_RX) & ~other))


def merge_date_blocks(rows: DataFrame) -> DataFrame:
    """Consecutive blocks that are pieces of a date become one."""
    w = ordered(("doc_id",), ("block",))
    date = is_date_piece(F.col("text"))
    runs = island(rows.withColumn("is_date", date), F.coalesce(~(date & F.lag(date).over(w)), F.lit(True)), w, "merged")
    return runs.groupBy("doc_id", "merged").agg(ordered_text("text", order=("block",)).alias("text"), F.min("is_date").alias("is_date"))


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def linear_scores(v: Column, weights: list[list[float]]) -> Column:
    """One score for each row of weights: the sum of products, inside the engine."""
    rows = [F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in row]), lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b) for row in weights]
    return F.array(*rows)


def score_segments(df: DataFrame, v: Column, weights: list[list[float]], labels: list[str]) -> DataFrame:
    """Label and confidence (4 decimals) of the highest score of a linear model. Swap in any scorer with mapInPandas."""
    scored = df.withColumn("_p", softmax(linear_scores(v, weights)))
    best = F.array_position("_p", F.array_max("_p"))
    return scored.withColumn("label", F.element_at(F.array(*[F.lit(x) for x in labels]), best.cast("int"))).withColumn("confidence", F.round(F.array_max("_p"), 4)).drop("_p")


def overlap_windows(tokens: DataFrame, size: int = 250, step: int = 150) -> DataFrame:
    """Each token once for each window that holds it: pos in the document, the window's start and end (exclusive). The
    last window is the first that reaches the document's end."""
    doc = Window.partitionBy("doc_id")
    placed = tokens.withColumn("pos", F.row_number().over(ordered()) - 1).withColumn("_n", F.count("*").over(doc))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / step)).cast("int")
    from_, to = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step).cast("int") + 1), F.least(last, F.floor(F.col("pos") / step).cast("int"))
    inside = placed.withColumn("start", F.explode(F.transform(F.sequence(from_, to), lambda k: k * step)))
    return inside.withColumn("end", F.least(F.col("start") + size, F.col("_n"))).drop("_n")


def merge_windows(scored: DataFrame) -> DataFrame:
    """One ``label`` for each token of overlapping windows, taken in the order of their starts: a window's verdict counts
    if it found a label, or if its middle is nearer than the best so far; a label counts as 100 tokens nearer than it is,
    so that a later O overturns it only where the label stood far from its window's middle. A token has few windows."""
    away = F.abs(F.col("pos") - (F.col("start") + F.col("end")) / 2)
    verdicts = F.array_sort(F.collect_list(F.struct("start", away.alias("away"), "label")))

    def step(s: Column, v: Column) -> Column:
        found = v["label"] != "O"
        takes = found | (v["away"] < s["best"])
        near = v["away"] - F.when(found, 100.0).otherwise(0.0)
        return F.struct(F.when(takes, v["label"]).otherwise(s["label"]).alias("label"), F.when(takes, near).otherwise(s["best"]).alias("best"))

    first = F.struct(F.lit("O").alias("label"), F.lit(float("inf")).alias("best"))
    return scored.groupBy(*LINE_KEY, "token_index").agg(F.aggregate(verdicts, first, step)["label"].alias("label"))


def head_tail(values: Column, half: int, pad: Column) -> Column:
    """Longer arrays keep their first and last ``half``; shorter ones are padded."""
    n = F.size(values)
    both = F.concat(F.slice(values, 1, half), F.slice(values, F.greatest(F.lit(1), n - half + 1), half))
    return F.when(n > 2 * half, both).otherwise(F.concat(values, F.array_repeat(pad, F.greatest(F.lit(0), 2 * half - n))))


def stamp_bio(blocks: DataFrame) -> DataFrame:
    """Labels of phrase blocks (``split_blocks``) on their tokens: B- on a block's first token unless the block before has
    the same label and no bullet opens this one, else I-. Windows over a block give its label and how it begins, a window
    over the document hands the label of the block before to a block's first token: no join."""
    block = ordered(("doc_id", "block"))
    whole = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    opening = F.when(F.col("bio_label").startswith("B-"), entity(F.col("bio_label")))
    labelled = blocks.withColumn("label", F.coalesce(F.first(opening, ignorenulls=True).over(whole), F.lit("O")))
    labelled = labelled.withColumn("_first", F.row_number().over(block) == 1)
    same = F.coalesce((F.lag("label").over(ordered()) == F.col("label")) & ~F.col("token").startswith("•"), F.lit(False))
    begins = F.col("_first") & ~same
    stamped = F.when(F.col("label") == "O", "O").when(begins, F.concat(F.lit("B-"), "label")).otherwise(F.concat(F.lit("I-"), "label"))
    return labelled.withColumn("stamped", stamped).drop("_first")


def bio_sanitise(tokens: DataFrame, label: str = "bio_label", out: str = "clean_label") -> DataFrame:
    """An I- without its entity before it becomes B-; a B- after the same entity I-."""
    w = ordered()
    before_it = F.coalesce(entity(F.lag(label).over(w)), F.lit("O"))
    own = entity(F.col(label))
    fixed = F.when(F.col(label) == "O", "O").when(own == before_it, F.concat(F.lit("I-"), own)).otherwise(F.concat(F.lit("B-"), own))
    return tokens.withColumn(out, fixed)


CONTACT = [
    ("EMAIL", r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}[.,;]?$"),
    ("LINKEDIN", r"linkedin\.com"),
    ("GITHUB", r"github\.(com|io)"),
    ("OTHER_LINK", r"^(https?://|www\.)"),
    ("PHONE", r"^\+?[0-9][0-9()./-]{8,}[0-9]$"),
]


def contact_classify(token: Column) -> Column:
    """Kind of contact detail of a token, else O."""
    out = F.lit("O")
    for name, rx in reversed(CONTACT):
        out = F.when(F.lower(token).rlike(rx) if name != "PHONE" else token.rlike(rx), name).otherwise(out)
    return out


def contact_labels(tokens: DataFrame) -> DataFrame:
    """B- labels of contact details, made one run where they follow each other."""
    kind = contact_classify(F.col("token"))
    return bio_sanitise(tokens.withColumn("bio_label", F.when(kind == "O", "O").otherwise(F.concat(F.lit("B-"), kind))))


def contact_refine(tokens: DataFrame) -> DataFrame:
    """``https`` and ``:`` take the label of the link that follows them."""
    w = ordered(LINE_KEY, ("token_index",))
    scheme = F.col("token").isin("https", "http", ":", "//")
    following = F.first(F.when(~scheme, F.col("kind")), ignorenulls=True).over(after(w))
    return tokens.withColumn("kind", F.when(scheme & F.coalesce(following, F.lit("O")).isin("LINKEDIN", "GITHUB", "OTHER_LINK"), following).otherwise(F.col("kind")))


def skills_promote(tokens: DataFrame) -> DataFrame:
    """An unlabelled word after a skill on its line is a skill; ``hub`` after ``git`` goes on with it."""
    w = ordered(LINE_KEY, ("token_index",))
    skill, word = F.col("bio_label").endswith("-SKILL"), F.col("token").rlike("[A-Za-z0-9]")
    later = F.max(skill.cast("int")).over(before(w)) == 1
    promoted = (F.col("bio_label") == "O") & word & F.coalesce(later, F.lit(False))
    hub = (F.lower(F.trim("token")) == "hub") & (F.lower(F.trim(F.last(F.when(word, F.col("token")), ignorenulls=True).over(before(w)))) == "git")
    return tokens.withColumn("bio_label", F.when(promoted, F.when(F.coalesce(hub, F.lit(False)), "I-SKILL").otherwise("B-SKILL")).otherwise(F.col("bio_label")))


def skills_merge(tokens: DataFrame) -> DataFrame:
    """Neighbouring B-SKILL words are one skill unless a comma stands between them."""
    w = ordered(LINE_KEY, ("token_index",))
    joined = (F.col("bio_label") == "B-SKILL") & F.lag("bio_label").over(w).endswith("-SKILL") & ~F.lag("token").over(w).rlike("[,|]$")
    return tokens.withColumn("bio_label", F.when(F.coalesce(joined, F.lit(False)), "I-SKILL").otherwise(F.col("bio_label")))


#: Headings (letters and blanks only, lower case) that open the skills, and those that close them.
SKILL_HEADINGS = ["skills", "technical skills", "skill summary", "technologies", "technology", "core competencies", "technicalskills", "competencies"]
OTHER_SECTIONS = [
    "experience", "work experience", "professional experience", "employment history", "education", "academic background", "academics", "projects", "academic projects", "key projects",
    "personal projects", "summary", "professional summary", "career objective", "objective", "profile", "personal details", "personal info", "personal information", "interests",
    "certifications", "hobbies", "declarations", "declaration", "languages",
]


def skills_region(lines: DataFrame, shown: Column | None = None) -> DataFrame:
    """``in_skills`` of lines: a heading of skills, or a line that ``shown`` holds for, opens the region, another section's
    heading without a colon closes it."""
    w = ordered(("doc_id",), ("page", "line_index"))
    clean = F.trim(F.regexp_replace(F.lower("text"), r"[^a-z\s]", ""))
    opens = clean.isin(SKILL_HEADINGS) if shown is None else clean.isin(SKILL_HEADINGS) | F.coalesce(shown, F.lit(False))
    event = F.when(clean.isin(OTHER_SECTIONS) & ~F.col("text").contains(":"), 0).when(opens, 1)
    return lines.withColumn("in_skills", F.coalesce(carry_last(event, w), F.lit(0)) == 1)


def to_bilou(tokens: DataFrame) -> DataFrame:
    """BIO to BILOU: the last of a run is L-, a run of one U-; labels without a mark stay."""
    w = ordered()
    goes_on = F.coalesce(F.lead("bio_label").over(w) == F.concat(F.lit("I-"), entity(F.col("bio_label"))), F.lit(False))
    e = entity(F.col("bio_label"))
    label = (
        F.when(F.col("bio_label").startswith("B-"), F.when(goes_on, F.concat(F.lit("B-"), e)).otherwise(F.concat(F.lit("U-"), e)))
        .when(F.col("bio_label").startswith("I-"), F.when(goes_on, F.concat(F.lit("I-"), e)).otherwise(F.concat(F.lit("L-"), e)))
        .otherwise(F.col("bio_label"))
    )
    return tokens.withColumn("bilou", label)


def bridge_punct(rows: DataFrame) -> DataFrame:
    """A block of punctuation whose left neighbour's label, itself perhaps taken that way, is the right neighbour's takes
    it. A fold over each run of such blocks and the block before it."""
    w = ordered(("doc_id",), ("block",))
    mark = ~F.col("text").rlike("[A-Za-z0-9]")
    placed = rows.withColumn("_mark", mark).withColumn("_next", F.lead("label").over(w)).withColumn("_run", F.sum((~mark).cast("int")).over(running(w)))

    def step(s: Column, row: Column) -> Column:
        takes = row["_mark"] & F.coalesce(s["bridged"] == row["_next"], F.lit(False))
        return F.struct(F.when(takes, s["bridged"]).otherwise(row["label"]).alias("bridged"))

    start = F.struct(F.lit(None).cast("string").alias("bridged"))
    out = folded(placed, ("doc_id", "_run"), ("block",), start, "struct<bridged:string>", step, "bridged", "string")
    return out.withColumn("label", F.col("bridged")).drop("bridged", "_mark", "_next", "_run")


#: The label vocabularies of the tasks: entity, what it is mapped to; the order of the classes is their
#: priority in a tie.
LABEL_MAPS = {
    "skills": {"SKILL": "SKILL", "SKILL_TYPE": "SKILL_TYPE", "SKILL_CAT": "SKILL_TYPE"},
    "project": {"PROJ_NAME": "PROJ", "PROJ_COMPANY": "COMP", "SDATE": "SDATE", "EDATE": "EDATE", "DESC": "DESC", "URL": "O", "PROJ_TECH": "O", "LINK": "O"},
    "education": {"DEG": "DEG", "DEGREE": "DEG", "INST": "INST", "INSTITUTION": "INST", "SDATE": "SDATE", "EDATE": "EDATE", "DESC": "DESC", "EDESC": "DESC", "GPA": "GPA", "GRADE": "GPA", "SCORE": "GPA"},
    "experience": {"ROLE": "ROLE", "ROLEMETA": "ROLE", "COMP": "COMP", "COMP_LOC": "COMP", "SDATE": "DATE", "EDATE": "DATE", "DESC": "DESC"},
}


def label_vocabulary(spark: SparkSession) -> DataFrame:
    """The dimension table of labels: task, entity, mapped, priority (of the mapped class within its task). Its size is
    that of ``LABEL_MAPS``, which lets a join broadcast it."""
    rows = []
    for task, entities in LABEL_MAPS.items():
        classes = list(dict.fromkeys(entities.values()))
        rows += [(task, e, m, classes.index(m)) for e, m in entities.items()]
    return spark.createDataFrame(rows, "task string, entity string, mapped string, priority int")


def map_label(tokens: DataFrame, task: str, label: str = "bio_label", out: str = "mapped") -> DataFrame:
    """The task's form of each label, by a join with the vocabulary. Skills: BIO or BILOU in any case, all other entities
    O. Projects: known entities, others as they are. Education: the same, in upper case. Experience: the class without
    prefix, null for other entities."""
    # the label without its mark B, I, L or U and in the vocabulary's case
    text = F.coalesce(F.col(label), F.lit("O"))
    text = F.upper(F.trim(text)) if task == "education" else F.upper(text) if task == "skills" else text
    prefix, bare = F.regexp_extract(text, "^([BILU])-", 1), F.regexp_replace(text, "^[BILU]-", "")
    known = label_vocabulary(tokens.sparkSession).filter(F.col("task") == task).select(F.col("entity").alias("_entity"), F.col("mapped").alias("_to"))
    joined = tokens.withColumn("_prefix", prefix).withColumn("_entity", bare).withColumn("_text", text).join(F.broadcast(known), "_entity", "left")
    has = F.col("_prefix") != ""
    begins = F.when(F.col("_prefix").isin("B", "U"), "B-").otherwise("I-")
    if task == "skills":
        value = F.when(has & F.col("_to").isNotNull(), F.concat(begins, "_to")).otherwise("O")
    elif task == "experience":
        value = F.when(F.col("_prefix").isin("B", "I"), F.col("_to"))
    else:
        value = F.when(F.col("_to") == "O", "O").when(F.col("_prefix").isin("B", "I") & F.col("_to").isNotNull(), F.concat(F.col("_prefix"), F.lit("-"), "_to")).otherwise(F.col("_text"))
    return joined.withColumn(out, value).drop("_prefix", "_entity", "_text", "_to")


def class_vote(tokens: DataFrame, keys: tuple[str, ...], task: str = "experience") -> DataFrame:
    """The class of each group: that of its first B- token with a class, else the most frequent one, of equally frequent
    ones that with the highest priority of the vocabulary; null where no token has a class."""
    classed = map_label(tokens, task, out="_class").withColumn("_class", F.regexp_replace("_class", "^[BI]-", ""))
    placed = classed.filter("_class IS NOT NULL AND _class <> 'O'").withColumn("_pos", F.row_number().over(ordered()))
    rank = F.broadcast(label_vocabulary(tokens.sparkSession).filter(F.col("task") == task).groupBy(F.col("mapped").alias("_class")).agg(F.min("priority").alias("_rank")))
    opens = F.col("bio_label").startswith("B-")
    counted = placed.join(rank, "_class").groupBy(*keys, "_class", "_rank").agg(F.count("*").alias("_n"), F.min(F.when(opens, F.col("_pos"))).alias("_first"))
    voted = counted.groupBy(*keys).agg(F.min_by("_class", "_first").alias("first"), F.max_by("_class", F.struct("_n", -F.col("_rank"))).alias("usual"))
    return tokens.select(*keys).distinct().join(voted, list(keys), "left").select(*keys, F.coalesce("first", "usual").alias("label"))


def segment_vote(tokens: DataFrame, keys: tuple[str, ...], classes: dict[str, str], rest: str) -> DataFrame:
    """DATE for groups with a date label or a date in their text, else the class of most tokens (of equally many the first
    seen); ``classes`` maps entities to classes, all others are ``rest``."""
    own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), entity(F.col("bio_label"))), F.lit(rest))
    placed = tokens.withColumn("_pos", F.row_number().over(ordered())).withColumn("_class", own).withColumn("_date", entity(F.col("bio_label")).isin("SDATE", "EDATE"))
    shown = placed.groupBy(*keys).agg(F.max("_date").alias("dated"), ordered_text().alias("text"))
    date = F.col("dated") | F.lower("text").rlike(DATED_RX)
    return shown.join(first_seen_mode(placed, keys, "_class", "_pos", "usual"), list(keys)).select(*keys, F.when(date, "DATE").otherwise(F.col("usual")).alias("label"))


def label_vote(tokens: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """First B- label of a group, else its most frequent one (ties: first seen)."""
    placed = tokens.withColumn("pos", F.row_number().over(ordered())).withColumn("own", entity(F.col("bio_label")))
    first = placed.groupBy(*keys).agg(F.min_by("own", F.when(F.col("bio_label").startswith("B-"), F.col("pos"))).alias("first"), F.max(F.col("bio_label").startswith("B-")).alias("any_b"))
    return first.join(first_seen_mode(placed, keys, "own", "pos", "usual"), list(keys)).select(*keys, F.when(F.col("any_b"), F.col("first")).otherwise(F.col("usual")).alias("label"))


def align_continuation(tokens: DataFrame) -> DataFrame:
    """A B-X that begins a line after X goes on with it, unless a bullet or a colon stands there."""
    w = ordered()
    breaks = (F.col("line_index") != F.lag("line_index").over(w)) | (F.col("page") != F.lag("page").over(w))
    same = entity(F.lag("bio_label").over(w)) == entity(F.col("bio_label"))
    goes_on = breaks & same & F.col("bio_label").startswith("B-") & ~F.col("token").rlike("^[•*-]") & ~F.lag("token").over(w).endswith(":")
    return tokens.withColumn("bio_label", F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.lit("I-"), entity(F.col("bio_label")))).otherwise(F.col("bio_label")))


def decode_constrained(scores: DataFrame, labels: list[str]) -> DataFrame:
    """Greedy labels in token order; an I-X is only allowed after B-X or I-X of its line: a fold over each line."""
    inner = F.array(*[F.lit(x.startswith("I-")) for x in labels])
    own = F.array(*[F.lit(x[2:]) for x in labels])

    def step(s: Column, row: Column) -> Column:
        allowed = F.transform(row["scores"], lambda x, i: F.when(F.get(inner, i) & (F.get(own, i) != s["entity"]), x - 10000).otherwise(x))
        best = (F.array_position(allowed, F.array_max(allowed)) - 1).cast("int")
        return F.struct(F.get(own, best).alias("entity"), F.get(F.array(*[F.lit(x) for x in labels]), best).alias("label"))

    start = F.struct(F.lit("").alias("entity"), F.lit("O").alias("label"))
    rows = scores.select(*LINE_KEY, "token_index", "scores")
    return folded(rows, LINE_KEY, ("token_index",), start, "struct<entity:string,label:string>", step, "label", "string").select(*LINE_KEY, "token_index", "label")


def top_segments(tokens: DataFrame, most: int) -> DataFrame:
    """The first ``most`` lines of a document, as the models take them."""
    n = F.dense_rank().over(ordered(("doc_id",), ("page", "line_index")))
    return tokens.withColumn("nth", n).filter(F.col("nth") <= most)
