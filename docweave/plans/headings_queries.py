"""Queries over headings and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import headings as hd
from docweave.plans.lines_queries import L, lines
from docweave.plans.registry import query
from docweave.plans.twins import on_resumes
from docweave.sources.tables import resume_tokens

BARE = r"trim(regexp_replace(regexp_replace(text, '^[#*>•◦●▪\-\s]+', ''), '[:*\s]+$', ''))"
NORM = rf"""CASE WHEN len(string_split_regex({BARE}, ' +')) > 3 AND len(list_filter(string_split_regex({BARE}, ' +'), lambda w: length(w) = 1)) = len(string_split_regex({BARE}, ' +'))
  THEN array_to_string(list_transform(string_split_regex({BARE}, ' {{2,}}'), lambda w: replace(w, ' ', '')), ' ') ELSE regexp_replace({BARE}, ' +', ' ', 'g') END"""
NORM = f"replace(replace(replace(upper({NORM}), 'EXPERIANCE', 'EXPERIENCE'), 'EDUCTION', 'EDUCATION'), 'SKILSS', 'SKILLS')"
KEYS = ", ".join(f"('{k}', '{v}')" for k, v in hd.HEADINGS.items())
ALONE, NOT_AT_END = (", ".join(f"'{k}'" for k in words) for words in (hd.ALONE, hd.NOT_AT_END))
DICTIONARY = L + f""", n AS (SELECT *, {NORM} AS norm FROM l), hk(key, heading_section) AS (VALUES {KEYS}), u AS (SELECT DISTINCT norm FROM n WHERE length(norm) <= 46),
hm AS (SELECT norm, key, heading_section FROM u JOIN hk ON (norm = key OR (key NOT IN ({ALONE}) AND (starts_with(norm, key || ' ') OR (ends_with(norm, ' ' || key) AND key NOT IN ({NOT_AT_END}))))) AND length(norm) <= length(key) + 15
  QUALIFY row_number() OVER (PARTITION BY norm ORDER BY length(key) DESC, key) = 1),
dk AS (SELECT n.*, key, heading_section FROM n LEFT JOIN hm USING (norm))"""


def rx(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def names(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


UPPER = "({0} = upper({0}) AND {0} <> lower({0}))"
SPELT = "lower(CASE WHEN len(string_split(plain, ' ')) >= 4 AND len(list_filter(string_split(plain, ' '), lambda w: regexp_matches(w, '^\\p{L}$'))) >= 0.75 * len(string_split(plain, ' ')) THEN replace(plain, ' ', '') ELSE plain END)"
for _wrong, _right in hd.SPELLING.items():
    SPELT = f"replace({SPELT}, '{_wrong}', '{_right}')"
HITS = (
    f"list_filter([{names(k for k in hd.SECTION_BY_TEXT if k != 'project')}], lambda k: form = k OR starts_with(form, k || ' ') OR starts_with(form, k || ':')"
    f" OR (k IN ({names(hd.ENDINGS)}) AND (ends_with(form, ' ' || k) OR (length(k) > 4 AND ends_with(form, k) AND form <> k))))"
)
OTHER = "opens = 'OTHER'"
NEVER = f"plain = '' OR length(plain) > {hd.MOST_CHARS} OR {rx('low', hd.FIELD_RX)} OR {rx('low', hd.PART_RX)} OR {rx('low', hd.DATE_ONLY_RX)} OR ({rx('low', '^[-—–]')} AND {OTHER})"
BARS = f"(contains(plain, '|') AND NOT contains(low, 'linkedin') AND {OTHER})"
WEAK = f"(low = 'contact' AND NOT {UPPER.format('trim(text)')}) OR ({rx('low', '^[0-9]')} AND {OTHER}) OR {rx('low', hd._word(['languages? known', 'fresher']))} OR low IN ({names(hd.NO_HEADINGS)})"
FALSE = (
    f"(({NEVER}) OR (NOT ({rx('low', hd.ENTRY_RX)} OR {rx('low', hd.DEGREE_RX)}) AND (({OTHER} AND {rx('low', hd._word(hd.JOB_WORDS))} AND NOT {UPPER.format('plain')})"
    f" OR ({BARS} AND NOT ({rx('plain', hd.SKILL_LABEL_RX)} AND length(plain) < 28)) OR (NOT {BARS} AND ({WEAK})))))"
)
FORMS = L + f""", pl AS (SELECT *, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(text), '^#{{1,6}}\\s+', ''), '[*#_`]+', ' ', 'g'), '{hd.BULLET_RX}', ''), '\\s+', ' ', 'g')), '^[0-9]+% *', '')) AS plain FROM l),
fm AS (SELECT *, lower(plain) AS low, regexp_replace({SPELT}, '[:;. -]+$', '') AS form FROM pl),
uf AS (SELECT DISTINCT form FROM fm), uh AS (SELECT form, list_sort({HITS}) AS hits FROM uf),
ub AS (SELECT form, list_filter(hits, lambda k: length(k) = list_max(list_transform(hits, lambda x: length(x))))[1] AS key, regexp_replace(form, '[^a-z0-9]', '', 'g') AS joined FROM uh),
sk(key, section) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in hd.SECTION_BY_TEXT.items())}),
se AS (SELECT fm.*, CASE WHEN section IS NOT NULL THEN section WHEN form = 'project' AND {UPPER.format('plain')} THEN 'PROJECT' WHEN {rx('joined', hd.JOINED_EXPERIENCE_RX)} THEN 'EXPERIENCE' WHEN {rx('joined', hd.JOINED_DESIGN_RX)} THEN 'PROJECT' ELSE 'OTHER' END AS opens
  FROM fm JOIN ub USING (form) LEFT JOIN sk USING (key))"""
LABEL = f"CASE WHEN ends_with(plain, '|') THEN {rx('plain', hd.SKILL_LABEL_RX)} ELSE len(string_split(plain, ' ')) <= 4 AND regexp_matches(plain, '^\\p{{Lu}}') END"
KNOWN = f"({OTHER.replace('=', '<>')} OR {rx('form', hd.OTHER_RX)})"
DECIDED = FORMS + f""", df AS (SELECT doc_id, quantile_disc(-font_median, 0.5) * -1 AS doc_font FROM l GROUP BY ALL),
sy AS (SELECT *, coalesce(is_bold OR font_median >= 1.03 * doc_font OR ({UPPER.format('plain')} AND (len(string_split(plain, ' ')) BETWEEN 2 AND 6 OR form IN ({names(hd.ONE_WORD)}))) OR (ends_with(plain, ':') AND length(plain) < 55 AND opens <> 'OTHER'), false) AS looks_heading,
  {FALSE} OR length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) > {hd.MOST_LETTERS} AS is_false, {rx('form', '|'.join(hd.SKILL_ANCHORS))} AS sa, {rx('form', '|'.join(hd.WORK_ANCHORS))} AS wa FROM se JOIN df USING (doc_id)),
nr AS (SELECT *, coalesce(bool_or(sa) OVER v, false) AS near_skills, coalesce(bool_or(wa) OVER v, false) AS near_work FROM sy WINDOW v AS (PARTITION BY doc_id ORDER BY page, line_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
hc AS (SELECT *, CAST(CASE WHEN is_false THEN 0.95 WHEN near_skills AND {rx('trim(text)', hd.BULLET_RX)} AND length(plain) <= 28 AND NOT {rx('low', hd._word(hd.SENTENCE_WORDS))} AND {LABEL} THEN 0.78 WHEN {KNOWN} AND looks_heading THEN 0.92 WHEN {KNOWN} AND {UPPER.format('plain')} THEN 0.75
  WHEN near_work AND {rx('low', hd.ENTRY_RX)} AND is_bold THEN 0.82 WHEN {KNOWN} THEN 0.6 ELSE 0.3 END AS DOUBLE) AS heading_confidence FROM nr),
de AS (SELECT *, heading_confidence BETWEEN 0.7 AND 0.93 AS is_heading FROM hc)"""
STAMPED = DECIDED + """, sm AS (SELECT t.*, CASE WHEN de.doc_id IS NULL THEN 'O' WHEN row_number() OVER (PARTITION BY t.doc_id, t.page, t.line_index ORDER BY token_index) = 1 THEN 'B-HEADING' ELSE 'I-HEADING' END AS heading_bio
  FROM t LEFT JOIN (SELECT * FROM de WHERE is_heading) de ON t.doc_id = de.doc_id AND t.page = de.page AND t.line_index = de.line_index),
ch AS (SELECT *, CAST(sum(CASE WHEN heading_bio = 'B-HEADING' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page, line_index, token_index, x0) AS BIGINT) AS chunk_id FROM sm),
ck AS (SELECT doc_id, chunk_id, coalesce(string_agg(token, ' ' ORDER BY page, line_index, token_index) FILTER (heading_bio <> 'O'), '') AS heading, CAST(count(*) FILTER (heading_bio = 'O') AS BIGINT) AS token_count, chunk_id = 0 AS virtual FROM ch GROUP BY ALL)"""
RULED = "CASE " + " ".join(f"WHEN regexp_matches(upper(replace(heading, ' ', '')), '{roots}') THEN '{s}'" for s, roots in hd.SECTION_ROOTS) + " ELSE 'OTHER' END"
SECTIONS = STAMPED + f""", cs AS (SELECT *, CASE WHEN virtual THEN 'PERSONAL' ELSE {RULED} END AS chunk_section FROM ck)"""
KEY = ("doc_id", "page", "line_index")


def decided(spark, sf_dir):
    return hd.decide(lines(spark, sf_dir))


def stamped(spark, sf_dir):
    return hd.stamp(resume_tokens(spark, sf_dir), decided(spark, sf_dir))


@query(on_resumes(L + f" SELECT doc_id, page, line_index, {NORM} AS norm FROM l"))
def heading_normalise(spark, sf_dir):
    return lines(spark, sf_dir).select(*KEY, hd.normalise(F.col("text")).alias("norm"))


@query(on_resumes(DICTIONARY + " SELECT doc_id, page, line_index, norm, key, heading_section FROM dk"))
def heading_dictionary(spark, sf_dir):
    return hd.match_dictionary(lines(spark, sf_dir)).select(*KEY, "norm", "key", "heading_section")


@query(on_resumes(FORMS + f" SELECT doc_id, page, line_index, {FALSE} AS is_false FROM se"))
def false_heading(spark, sf_dir):
    return hd.with_sections(lines(spark, sf_dir)).select(*KEY, hd.false_heading().alias("is_false"))


@query(on_resumes(DECIDED + " SELECT doc_id, page, line_index, looks_heading FROM sy"))
def style_is_heading(spark, sf_dir):
    return hd.with_style(hd.with_sections(lines(spark, sf_dir))).select(*KEY, "looks_heading")


@query(on_resumes(L + """, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index) AS pos FROM l)
SELECT doc_id, page, line_index, pos - max(CASE WHEN regexp_matches(text, 'University|Engineer|Portal') THEN pos END) OVER (PARTITION BY doc_id ORDER BY page, line_index ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS anchor_distance FROM p"""))
def anchor_distance(spark, sf_dir):
    return hd.anchor_distance(lines(spark, sf_dir)).select(*KEY, "anchor_distance")


@query(on_resumes(DECIDED + " SELECT doc_id, page, line_index, heading_confidence, is_heading FROM de"))
def heading_decide(spark, sf_dir):
    return decided(spark, sf_dir).select(*KEY, "heading_confidence", "is_heading")


@query(on_resumes(DECIDED + """, sc AS (SELECT *, CASE WHEN is_false THEN 'rejected' WHEN is_heading THEN 'rule' WHEN 1 / (1 + exp(-(0.9 * CAST(is_bold AS INT) + 0.8 * CAST(is_caps AS INT) - 0.4 * n_tokens))) >= 0.5 THEN 'scorer' ELSE 'none' END AS source FROM de)
SELECT doc_id, page, line_index, source, source IN ('rule', 'scorer') AS is_heading FROM sc"""))
def heading_hybrid(spark, sf_dir):
    """Sure lines by rule; only uncertain ones reach the scorer."""
    d = decided(spark, sf_dir)
    sure = d.filter("is_heading OR is_false").withColumn("source", F.when(F.col("is_heading"), "rule").otherwise("rejected"))
    open_ = d.filter("NOT is_heading AND NOT is_false")
    score = 1 / (1 + F.exp(-(0.9 * F.col("is_bold").cast("int") + 0.8 * F.col("is_caps").cast("int") - 0.4 * F.col("n_tokens"))))
    both = sure.unionByName(open_.withColumn("source", F.when(score >= 0.5, "scorer").otherwise("none")))
    return both.select(*KEY, "source", F.col("source").isin("rule", "scorer").alias("is_heading"))


PROPAGATED = DECIDED + """, bk AS (SELECT doc_id, is_bold, round(font_median, 1) AS size, floor(x0 / 8) AS c, min(x0) AS ax0 FROM de WHERE is_heading GROUP BY ALL HAVING count(*) >= 2),
pr AS (SELECT d.* REPLACE (d.is_heading OR (NOT d.is_false AND d.n_tokens <= 4 AND EXISTS (SELECT 1 FROM bk b WHERE b.doc_id = d.doc_id AND b.is_bold = d.is_bold AND abs(d.font_median - b.size) <= 0.6 AND abs(d.x0 - b.ax0) <= 8)) AS is_heading) FROM de d)"""


@query(on_resumes(PROPAGATED + " SELECT doc_id, page, line_index, is_heading FROM pr"))
def heading_style_propagate(spark, sf_dir):
    return hd.propagate_style(decided(spark, sf_dir)).select(*KEY, "is_heading")


@query(on_resumes(DECIDED + " SELECT doc_id, page, line_index, looks_heading AND NOT coalesce(lag(looks_heading) OVER (PARTITION BY doc_id ORDER BY page, line_index), false) AS is_heading FROM de"))
def heading_dedupe_adjacent(spark, sf_dir):
    return hd.first_of_run(decided(spark, sf_dir).withColumn("is_heading", F.col("looks_heading"))).select(*KEY, "is_heading")


@query(on_resumes(DECIDED + """, lk AS (SELECT *, looks_heading OR text LIKE '• Shipped%' AS h FROM de), hh AS (SELECT doc_id, round(x0) AS indent, count(*) AS n FROM lk WHERE h GROUP BY ALL),
mi AS (SELECT doc_id, arg_max(indent, (n, -indent)) AS main FROM hh GROUP BY ALL)
SELECT doc_id, page, line_index, h AND NOT coalesce(regexp_matches(text, '^[•◦●▪*-]') AND abs(x0 - main) > 8, false) AS is_heading FROM lk LEFT JOIN mi USING (doc_id)"""))
def heading_outliers(spark, sf_dir):
    loose = decided(spark, sf_dir).withColumn("is_heading", F.col("looks_heading") | F.col("text").startswith("• Shipped"))
    return hd.drop_outliers(loose).select(*KEY, "is_heading")


@query(on_resumes(STAMPED + " SELECT doc_id, page, line_index, token_index, heading_bio FROM sm"))
def heading_stamp(spark, sf_dir):
    return stamped(spark, sf_dir).select(*KEY, "token_index", "heading_bio")


@query(on_resumes(DECIDED + " SELECT doc_id, page, line_index, text, heading_confidence, x0, y0 FROM de WHERE is_heading"))
def heading_report(spark, sf_dir):
    return decided(spark, sf_dir).filter("is_heading").select(*KEY, "text", "heading_confidence", "x0", "y0").orderBy(*KEY)


@query(on_resumes(""", b AS (SELECT *, CASE WHEN section <> 'PERSONAL' AND kind = 'heading' AND token_index = 0 THEN 'B-HEADING' ELSE 'O' END AS hb FROM t),
g AS (SELECT *, sum(CASE WHEN hb = 'B-HEADING' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) AS g FROM b),
o AS (SELECT *, min(CASE WHEN (token = upper(token) AND token <> lower(token) AND is_bold) OR hb = 'B-HEADING' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_index, g ORDER BY token_index) AS ok FROM g)
SELECT doc_id, page, line_index, token_index, CASE WHEN g > 0 AND ok = 1 AND hb = 'O' THEN 'I-HEADING' ELSE hb END AS heading_bio FROM o"""))
def heading_merge_words(spark, sf_dir):
    begun = F.when((F.col("kind") == "heading") & (F.col("token_index") == 0), "B-HEADING").otherwise("O")
    return hd.merge_words(resume_tokens(spark, sf_dir).withColumn("heading_bio", begun)).select(*KEY, "token_index", "heading_bio")


@query(on_resumes(STAMPED + " SELECT doc_id, chunk_id, heading, token_count, virtual FROM ck"))
def section_chunks(spark, sf_dir):
    return hd.chunk_rows(hd.chunks(stamped(spark, sf_dir)))


def mended(label: str) -> str:
    out = ""
    for section, roots, only, never in hd.LABEL_ROOTS:
        may = f" AND {label} = '{only}'" if only else f" AND {label} <> '{never}'" if never else ""
        out += f" WHEN regexp_matches(lower(trim(heading)), '{'|'.join(roots)}'){may} THEN '{section}'"
    return f"CASE{out} ELSE {label} END"


@query(on_resumes(SECTIONS + f", la AS (SELECT *, ['EDUCATION', 'OTHER', 'PERSONAL', 'EXPERIENCE'][1 + chunk_id % 4] AS label FROM cs) SELECT doc_id, chunk_id, heading, chunk_section, {mended('label')} AS label FROM la"))
def section_label_normalise(spark, sf_dir):
    """The section that a chunk's heading says, and what becomes of labels that a model may have given."""
    rows = hd.chunk_rows(hd.chunks(stamped(spark, sf_dir)))
    label = F.element_at(F.array(*[F.lit(x) for x in ("EDUCATION", "OTHER", "PERSONAL", "EXPERIENCE")]), (F.col("chunk_id") % 4).cast("int") + 1)
    return rows.select("doc_id", "chunk_id", "heading", hd.section_of(F.col("heading"), F.col("virtual")).alias("chunk_section"), hd.normalise_label(F.col("heading"), label).alias("label"))


@query(on_resumes(STAMPED + f", w AS (SELECT doc_id, chunk_id, heading, 0.5 + 0.1 * (doc_id % 5) AS confidence FROM ck) SELECT doc_id, chunk_id, CASE WHEN confidence < 0.7 AND {RULED} <> 'OTHER' THEN {RULED} ELSE 'OTHER' END AS section FROM w"))
def section_low_conf_override(spark, sf_dir):
    rows = hd.chunk_rows(hd.chunks(stamped(spark, sf_dir))).withColumn("confidence", F.expr("0.5D + 0.1D * (doc_id % 5)")).withColumn("section", F.lit("OTHER"))
    return hd.low_confidence_override(rows).select("doc_id", "chunk_id", "section")


@query(on_resumes(SECTIONS + " SELECT doc_id, page, line_index, token_index, chunk_section FROM ch JOIN cs USING (doc_id, chunk_id)"))
def section_propagate(spark, sf_dir):
    return hd.propagate_section(hd.chunks(stamped(spark, sf_dir))).select(*KEY, "token_index", "chunk_section")


@query(on_resumes(SECTIONS + " SELECT doc_id, chunk_section, count(*) AS n, count(*) = sum(count(*)) OVER (PARTITION BY doc_id) AS all_one FROM ch JOIN cs USING (doc_id, chunk_id) GROUP BY doc_id, chunk_section"))
def section_counts(spark, sf_dir):
    """Tokens of each section, and whether a document has one section only."""
    from pyspark.sql import Window

    n = hd.propagate_section(hd.chunks(stamped(spark, sf_dir))).groupBy("doc_id", "chunk_section").agg(F.count("*").alias("n"))
    return n.withColumn("all_one", F.col("n") == F.sum("n").over(Window.partitionBy("doc_id")))
