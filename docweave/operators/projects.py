"""Project and education rules, skills clean-up, vectors over segments, and stage tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.islands import before, carry_last, folded, next_known, ordered, ordered_text, running
from docweave.operators.fields import entity
from docweave.operators.layout import title_likeness
from docweave.operators.rulepacks import DEGREE_RX, EMAIL_RX, HONOURS_RX, LEAD_RX, MARKS_LINE_RX, PHONE_RX, PLACE_LINE_RX, institution_score
from docweave.schema import LINE_KEY


def likeness(text: Column, kind: str) -> Column:
    """How much a line looks like an institution or a degree, from 0 to 1; bulleted lines and details are neither."""
    core = F.trim(F.regexp_replace(F.trim(text), LEAD_RX, ""))
    low = F.lower(core)
    if kind == "institution":
        score = institution_score(core)
    else:
        score = F.when(low.rlike(DEGREE_RX), 0.5).otherwise(0.0) + F.when(low.rlike(HONOURS_RX), 0.25).otherwise(0.0) + F.when(core.contains("|") & low.rlike(DEGREE_RX), 0.15).otherwise(0.0)
    return F.when(F.trim(text).rlike(LEAD_RX) | low.rlike(MARKS_LINE_RX) | low.rlike(PLACE_LINE_RX), 0.0).otherwise(F.round(score, 6))


def block_context(lines: DataFrame, head: Column) -> DataFrame:
    """Rank in the block, lines since the last head, and the score blended with the neighbours'."""
    w = ordered(("doc_id", "section"), ("page", "line_index"))
    placed = lines.withColumn("rank", F.row_number().over(w))
    since = F.col("rank") - carry_last(F.when(head, F.col("rank")), w)
    blended = F.round(0.6 * F.col("score") + 0.2 * F.coalesce(F.lag("score").over(w), F.lit(0.0)) + 0.2 * F.coalesce(F.lead("score").over(w), F.lit(0.0)), 6)
    return placed.withColumn("since_head", since).withColumn("blended", blended)


#: Verbs and words that tell a tale (lower case).
NARRATIVE_RX = "(?:^|[^a-z0-9_])(?:designed|developed|built|implemented|using|through|we |i |created|based)"


def hard_negative(text: Column) -> Column:
    """A description that looks like a title: a likeness of a quarter, unless it is a tale of more than twelve words."""
    clean = F.trim(F.regexp_replace(F.trim(text), LEAD_RX, ""))
    tale = F.lower(clean).rlike(NARRATIVE_RX) & (F.size(F.split(clean, " +")) > 12)
    return F.coalesce((F.char_length(clean) >= 3) & (title_likeness(text) >= 0.25) & ~tale, F.lit(False))


def context_weight(label: Column, text: Column) -> Column:
    """How much a segment counts in training or evaluation: descriptions more than others, those that look like titles most;
    a segment without label not at all."""
    return F.when(label.isNull(), 0.0).when((label == "DESC") & hard_negative(text), 5.0).when(label == "DESC", 1.5).when(label == "PROJECT_NAME", 1.2).otherwise(1.0)


def decode_starts(tokens: DataFrame) -> DataFrame:
    """One start in each line: its first token with a start label; the line's other starts go on with it."""
    w = ordered(LINE_KEY, ("token_index",))
    start = F.col("bio_label").startswith("B-")
    nth = F.sum(start.cast("int")).over(running(w))
    return tokens.withColumn("decoded", F.when(start & (nth == 1), "B-PROJ_START").when(start, "I-PROJ_START").otherwise("O"))


def proj_style_heads(lines: DataFrame) -> DataFrame:
    """Lines with the columns of ``linerules.proj_line_rules`` and ``is_anchor`` (scored as a title). The first scored line
    that may be one sets size, boldness and place (the first line that may be one, if none was scored); lines within 0.5
    and 10 points of it are heads. Metadata, descriptions, lines that go on with a text and headings of sections may not."""
    low = F.lower(F.regexp_replace(F.trim("text"), "[:.,;]+$", ""))
    header = low.isin("projects", "project") | low.rlike("(?:^|[^a-z])(?:mini|academic|personal|key|selected|recent|course|minor|major) projects?(?:[^a-z]|$)|projects? client") | (low.startswith("projects") & (F.char_length(low) < 40) & ~F.col("has_bullet"))
    valid = ~F.coalesce(F.col("suppress") | F.col("is_continuation") | header, F.lit(False))
    style, place = F.struct("font_median", "is_bold", "x0"), F.struct("page", "line_index")
    chosen = lines.groupBy("doc_id").agg(F.coalesce(F.min_by(style, F.when(valid & F.col("is_anchor"), place)), F.min_by(style, F.when(valid, place))).alias("a"))
    joined = lines.join(chosen, "doc_id", "left")
    same = (F.abs(F.col("font_median") - F.col("a.font_median")) <= 0.5) & (F.col("is_bold") == F.col("a.is_bold")) & (F.abs(F.col("x0") - F.col("a.x0")) <= 10)
    return joined.withColumn("is_head", F.coalesce(same, F.lit(False))).drop("a")


def proj_boundary_fix(lines: DataFrame) -> DataFrame:
    """``is_head`` of lines with the columns of ``proj_line_rules``, ``in_project``, ``begins`` (scored as a start) and
    ``resets`` (the style tier or the gap above begins something new).

    Outside projects nothing begins. A line may open something if it has a bullet or a number, resets, or has no bullet
    after one that had. A scored start goes if a block is open and it may open nothing, if it is metadata, a description
    or goes on with a text, or has a bullet and is no title. A title that was not scored is a start if it may open
    something, or is numbered as a project, dated or linked, and no block is open or it stands out by bullet or form. A
    block stays open to the end of its run of project lines, so that it is open after the first line of the run that
    would open one: a window, no fold."""
    w = ordered(("doc_id",), ("page", "line_index"))
    c = {k: F.coalesce(F.col(k), F.lit(False)) for k in ("in_project", "begins", "resets", "has_bullet", "is_counted", "suppress", "is_continuation", "is_title", "is_numbered", "is_link_title")}
    after_bullet = F.coalesce(F.lag(c["has_bullet"]).over(w), F.lit(False)) & ~c["has_bullet"]
    told = lines.withColumn("_turn", after_bullet).withColumn("_may", c["has_bullet"] | c["is_counted"] | c["resets"] | after_bullet)
    told = told.withColumn("_force", c["is_numbered"] | c["is_link_title"]).withColumn("_fits", ~c["suppress"] & ~c["is_continuation"] & ~(c["has_bullet"] & ~c["is_title"]))
    added = ~c["begins"] & c["is_title"] & (F.col("_may") | F.col("_force"))
    opens = c["in_project"] & ((c["begins"] & F.col("_fits")) | added)
    left = F.coalesce(F.lag(c["in_project"]).over(w) != c["in_project"], F.lit(False))
    runs = told.withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum(left.cast("int")).over(running(w)))
    is_open = F.coalesce(F.max("_opens").over(before(ordered(("doc_id", "_run"), ("page", "line_index")))) == 1, F.lit(False))
    stays = c["begins"] & F.col("_fits") & (~is_open | F.col("_may"))
    stands = added & (~is_open | c["has_bullet"] | F.col("_turn") | F.col("_force"))
    return runs.withColumn("is_head", c["in_project"] & (stays | stands)).select(*LINE_KEY, "is_head")


def cluster_rows(tokens: DataFrame) -> DataFrame:
    """Rows of a page: a token joins while it lies within max(4, 0.4 mean heights) of the row's running mean. A fold over
    the page, as the mean moves with each token."""
    reach = F.greatest(F.lit(4.0), 0.4 * F.avg(F.col("y1") - F.col("y0")).over(Window.partitionBy("doc_id", "page")))
    rows = tokens.select(*LINE_KEY, "token_index", "y0", "x0", reach.alias("reach"))

    def step(s: Column, row: Column) -> Column:
        joins = (s["n"] > 0) & (F.abs(row["y0"] - s["mean"]) < row["reach"])
        return F.struct(
            F.when(joins, (s["mean"] * s["n"] + row["y0"]) / (s["n"] + 1)).otherwise(row["y0"]).alias("mean"),
            F.when(joins, s["n"] + 1).otherwise(1).alias("n"),
            F.when(joins, s["row"]).otherwise(s["row"] + 1).alias("row"),
        )

    start = F.struct(F.lit(0.0).alias("mean"), F.lit(0).alias("n"), F.lit(-1).alias("row"))
    out = folded(rows, ("doc_id", "page"), ("y0", "x0", "line_index", "token_index"), start, "struct<mean:double,n:int,row:int>", step, "row", "int")
    return out.select(*LINE_KEY, "token_index", "row")


def edu_boundary_pipeline(model: DataFrame, style: DataFrame) -> DataFrame:
    """The model's heads; those by style only for documents in which the model has none."""
    return model.union(style.join(model.select("doc_id").distinct(), "doc_id", "left_anti"))


#: Job titles without anything else; technologies, verbs and things that tell lists of technologies from
#: other texts; keywords of roles and companies.
GENERIC_ROLES = [
    "software developer", "automation testing", "qa engineer", "software engineer", "web developer", "full stack developer", "frontend developer", "backend developer", "data scientist",
    "machine learning engineer", "android developer", "ios developer", "devops engineer", "associate software engineer", "senior software engineer", "lead software engineer", "qa analyst",
    "quality assurance engineer", "automation engineer", "java developer", "python developer", "net developer", "c# developer", "ui developer", "ux designer", "ui/ux designer", "frontend engineer",
    "backend engineer", "full stack engineer", "senior java developer", "senior python developer", "database administrator", "system administrator", "network engineer", "security engineer",
    "cloud architect", "solutions architect", "scrum master",
]
TECH = [
    "quantization", "convolutions", "apis", "frameworks", "tools", "languages", "technologies", "libraries", "databases", "python", "pytorch", "java", "c++", "javascript", "react", "html", "css",
    "sql", "git", "aws", "docker", "kubernetes", "tensorflow", "numpy", "pandas", "scikit", "rest", "graphql", "ci/cd", "agile", "scrum", "jira", "maven", "gradle", "jenkins", "terraform", "ansible", "linux",
]
ACTIVE_VERBS = [
    "develop", "developed", "developing", "implement", "implemented", "implementing", "create", "created", "creating", "build", "built", "building", "design", "designed", "designing", "manage",
    "managed", "managing", "lead", "led", "leading", "optimize", "optimized", "optimizing", "write", "wrote", "writing", "integrate", "integrated", "integrating", "program", "programmed",
    "programming", "analyze", "analyzed", "analyzing",
]
THINGS = ["system", "application", "platform", "website", "portal", "dashboard", "project", "model", "tool"]
ROLE_KEYWORDS = [
    "developer", "engineer", "consultant", "analyst", "architect", "manager", "designer", "lead", "associate", "intern", "specialist", "director", "programmer", "administrator", "coordinator",
    "executive", "officer", "head", "founder", "trainee", "apprentice", "graduate", "assistant", "researcher", "scientist", "technician", "operator", "supervisor", "contractor", "freelancer",
    "vp", "president", "cto", "ceo", "coo", "tester", "expert",
]
COMPANY_KEYWORDS = [
    "pvt", "ltd", "inc", "corp", "corporation", "limited", "solutions", "services", "technologies", "university", "college", "school", "bank", "systems", "labs", "consulting", "company",
    "institutions", "association",
]


def _holds(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def noise(text: Column) -> Column:
    """``generic_role``: a job title without anything else. ``tech_stack``: a list of technologies, most of its parts one
    or short, that begins with no verb and names no thing that was made."""
    low = F.lower(F.trim(text))
    parts = F.filter(F.transform(F.split(low, "[,|]"), F.trim), lambda x: x != "")
    tech = F.size(F.filter(parts, lambda x: _holds(x, TECH) | (F.char_length(x) < 15)))
    first = F.regexp_replace(F.get(F.split(low, " +"), F.lit(0)), "[:,.-]+$", "")
    leak = low.rlike("[,|]") & _holds(low, TECH) & (F.size(parts) > 0) & ~first.isin(ACTIVE_VERBS) & ~_holds(low, THINGS) & (tech >= 0.75 * F.size(parts))
    return F.when(F.trim(F.regexp_replace(low, "[.:,;]+$", "")).isin(GENERIC_ROLES), "generic_role").when(leak, "tech_stack").otherwise("none")


def _words(text: Column) -> Column:
    """The words with a letter."""
    return F.filter(F.split(F.trim(text), " +"), lambda w: w.rlike(r"\p{L}"))


def exp_overrides(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, entry, block, text, label) of roles and companies become descriptions if they are in a list of
    technologies, longer than ten words, or longer than four without a keyword or mostly capitals. A list begins at a
    block that says so and ends at a description of more than six words."""
    low, n = F.lower(F.trim("text")), F.size(F.split(F.trim("text"), " +"))
    listed = low.contains("technology stack") | low.contains("tech stack") | low.startswith("technology :") | low.startswith("tech :")
    event = F.when((n > 6) & (F.col("label") == "DESC"), False).when(listed, True)
    inside = F.coalesce(carry_last(event, ordered(("doc_id", "entry"), ("block",))), F.lit(False))
    words = _words(F.col("text"))
    proper = (F.size(words) > 0) & (F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) >= 0.7 * F.size(words))
    plain = (n > 4) & ~(_holds(low, ROLE_KEYWORDS + COMPANY_KEYWORDS) | proper)
    return blocks.withColumn("label", F.when(F.col("label").isin("ROLE", "COMP") & (listed | inside | (n > 10) | plain), "DESC").otherwise(F.col("label")))


def exp_fill_company(blocks: DataFrame) -> DataFrame:
    """In an entry without a company whose first block is a role that ends with a dash or bar, the second block is the
    company if it is a description of one to six words. The whole entry is asked in the order of its blocks, too, so that
    one sort and one window serve."""
    w = ordered(("doc_id", "entry"), ("block",))
    none = F.max((F.col("label") == "COMP").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 0
    second = (F.row_number().over(w) == 2) & (F.lag("label").over(w) == "ROLE") & F.trim(F.lag("text").over(w)).rlike("(?:^| )[|–—-]$")
    filled = none & second & (F.col("label") == "DESC") & F.size(_words(F.col("text"))).between(1, 6)
    return blocks.withColumn("label", F.when(F.coalesce(filled, F.lit(False)), "COMP").otherwise(F.col("label")))


def label_of_segment(tokens: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Label of the first B- token; HETEROGENEOUS where there are several entities."""
    own = F.when(F.col("bio_label") != "O", entity(F.col("bio_label")))
    n = F.count_distinct(own)
    first = F.min_by(own, F.when(F.col("bio_label").startswith("B-"), F.col("token_index")))
    rows = tokens.groupBy(*keys).agg(n.alias("n"), first.alias("first"), F.count("*").alias("size"))
    return rows.select(*keys, F.when(F.col("n") > 1, "HETEROGENEOUS").otherwise(F.coalesce("first", F.lit("O"))).alias("label"), (F.col("n") <= 1).alias("homogeneous"), (F.col("size") > 12).alias("mega"))


def skills_bullets(tokens: DataFrame) -> DataFrame:
    """A word right after a line's leading bullet begins a skill."""
    w = ordered(LINE_KEY, ("token_index",))
    led = (F.row_number().over(w) == 2) & F.lag("token").over(w).rlike("^[•◦●▪*–-]$")
    return tokens.withColumn("bio_label", F.when(F.coalesce(led, F.lit(False)) & F.col("token").rlike("[A-Za-z0-9]"), "B-SKILL").otherwise(F.col("bio_label")))


def skills_lines(tokens: DataFrame) -> DataFrame:
    """The first word of a line goes on with the skill that ended the line before, unless a comma closed it."""
    w = ordered(("doc_id",))
    first = F.coalesce((F.col("line_index") != F.lag("line_index").over(w)) | (F.col("page") != F.lag("page").over(w)), F.lit(False))
    goes_on = first & (F.col("bio_label") == "B-SKILL") & F.lag("bio_label").over(w).endswith("-SKILL") & ~F.lag("token").over(w).rlike("[,|]$")
    return tokens.withColumn("bio_label", F.when(F.coalesce(goes_on, F.lit(False)), "I-SKILL").otherwise(F.col("bio_label")))


def skills_commas(tokens: DataFrame) -> DataFrame:
    """After a comma a skill begins anew; commas themselves have no label."""
    w = ordered(LINE_KEY, ("token_index",))
    anew = F.lag("token").over(w).rlike(",$") & F.col("bio_label").endswith("-SKILL")
    return tokens.withColumn("bio_label", F.when(F.col("token").rlike("^[,|]+$"), "O").when(F.coalesce(anew, F.lit(False)), "B-SKILL").otherwise(F.col("bio_label")))


def stitch_urls(tokens: DataFrame) -> DataFrame:
    """``https``, ``:`` and what follows them on the line are one URL."""
    w = ordered(LINE_KEY, ("token_index",))
    after = next_known(F.when(~F.col("token").isin("https", "http", ":", "//"), F.col("token")), w)
    url = F.when(F.col("token").isin("https", "http") & (F.lead("token").over(w) == ":"), F.concat("token", F.lit("://"), F.regexp_replace(after, "^/+", "")))
    return tokens.withColumn("url", url).filter("url IS NOT NULL")


#: Field names that are no value, and names of portfolio sites.
FIELD_NAMES = ["email", "e-mail", "mail", "mobile", "phone", "tel", "contact", "linkedin", "github", "website", "blog", "address"]
LINK_NAMES = ["portfolio", "behance", "dribbble", "leetcode", "codepen", "medium"]
SITE_RX = r"https?://|www\.|(?:^|[^a-z0-9_-])[a-z0-9_-]+\.(?:com|net|org|io|dev|me|co|in|ai|app|xyz|tech|info|biz|link|site|page|portfolio|cc|gg|sh)(?:[^a-z0-9_]|$)"


def personal_by_text(text: Column, scored: Column) -> Column:
    """The label of a personal segment: what its text shows beyond doubt beats the score. A site that is neither platform
    is no profile of one; a scored label begins."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(raw)
    mail, digits = low.rlike(EMAIL_RX), F.char_length(F.regexp_replace(raw, "[^0-9]", ""))
    phone = (raw.rlike(PHONE_RX) & digits.between(7, 15)) | (raw.startswith("+") & (digits > 0))
    begun = F.regexp_replace(F.coalesce(scored, F.lit("O")), "^I-", "B-")
    other = begun.isin("B-LINKEDIN", "B-GITHUB") & low.rlike(SITE_RX) & ~mail & ~low.contains("linkedin.com") & ~low.contains("github.com")
    return (
        F.when((raw == "") | low.isin(FIELD_NAMES), "O").when(mail, "B-EMAIL").when(low.contains("linkedin.com"), "B-LINKEDIN").when(low.contains("github.com"), "B-GITHUB")
        .when(phone, "B-PHONE").when(low.isin(LINK_NAMES) | other, "B-OTHER_LINK").otherwise(begun)
    )


def score_sequential(lines: DataFrame, labels: list[str], score: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """The best label of each line in order; ``score`` gives one score for each label from the line and the number of the
    label before it (as many as there are labels at the start). A fold over the document, as each label feeds the next."""
    names = F.array(*[F.lit(x) for x in labels])

    def step(s: Column, row: Column) -> Column:
        scores = F.array(*[x.cast("double") for x in score(row, s["last"])])
        best = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
        return F.struct(best.alias("last"), F.get(names, best).alias("label"))

    start = F.struct(F.lit(len(labels)).alias("last"), F.lit("").alias("label"))
    return folded(lines, ("doc_id",), ("page", "line_index"), start, "struct<last:int,label:string>", step, "label", "string").select(*LINE_KEY, "label")


def write_stage(df: DataFrame, folder: str, run_id: str, stage: str) -> None:
    """One partition for each run and stage; writing it again replaces it."""
    marked = df.withColumn("run_id", F.lit(run_id)).withColumn("stage", F.lit(stage))
    marked.write.partitionBy("run_id", "stage").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def read_stage(spark: SparkSession, folder: str, run_id: str, stage: str) -> DataFrame:
    """A stage's rows; the filter prunes the other partitions."""
    return spark.read.parquet(folder).filter((F.col("run_id") == run_id) & (F.col("stage") == stage)).drop("run_id", "stage")


def split_by_line(segments: DataFrame) -> DataFrame:
    """Segments over several lines become one for each line."""
    return segments.groupBy("doc_id", "segment", "page", "line_index").agg(ordered_text(order=("token_index",)).alias("text"))
