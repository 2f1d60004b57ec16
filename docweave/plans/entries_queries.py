"""Queries over entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import entries as en
from docweave.operators.lines import group_by_line_run as group_runs
from docweave.plans.lines_queries import SEGMENTS, L, lines, segments
from docweave.plans.registry import query
from docweave.plans.twins import on_resumes
from docweave.sources.tables import resume_line_rows, resume_tokens

K = ("doc_id", "page", "line_index")
TK = (*K, "token_index")

#: Lines with section, kind and whether the truth has an entry head on them.
LK = L + """, lk AS (SELECT l.*, s.section, s.kind, s.kind IN ('job', 'school', 'project') AS is_head FROM l JOIN (SELECT DISTINCT doc_id, page, line_index, section, kind FROM t) s USING (doc_id, page, line_index))"""


def quoted(rx: str) -> str:
    return rx.replace("'", "''")


def known_lines(spark, sf_dir):
    """Lines with section and kind, which all tokens of a line share, and whether the truth has an entry head on them."""
    return resume_line_rows(spark, sf_dir, "section", "kind").withColumn("is_head", F.col("kind").isin("job", "school", "project"))


@query(on_resumes(L + f" SELECT doc_id, page, line_index, regexp_matches(text, '{quoted(en.DATE_RX)}') AS has_date, CAST(CASE WHEN regexp_matches(text, '(?:19|20)[0-9]{{2}}') THEN length(regexp_extract(text, '^(.*?)(?:19|20)[0-9]{{2}}', 1)) + 1 END AS INT) AS first_year FROM l"))
def date_anchor(spark, sf_dir):
    return en.date_anchor(lines(spark, sf_dir))


def m(rx):
    return f"regexp_matches(text, '{quoted(rx)}')"


def sql_list(words):
    return "[" + ", ".join("'" + quoted(w) + "'" for w in words) + "]"


DATED = quoted(en.DATED_RX)
EXP = f""", el AS (SELECT *, lower(trim(text)) AS low, coalesce(list_filter(string_split_regex(trim(text), ' +'), lambda w: NOT list_contains({sql_list(en.SKIPPED)}, w))[1], '') AS fst FROM lk),
ed AS (SELECT *, regexp_matches(low, '{DATED}') AS has_date, list_contains({sql_list(en.BULLETS)}, fst) OR starts_with(fst, '(') OR list_contains({sql_list(en.DESCRIPTION_VERBS)}, lower(fst)) AS is_bullet,
  len(list_filter(string_split_regex(low, ' +'), lambda w: list_contains({sql_list(en.DESCRIPTION_VERBS)}, regexp_replace(w, '^[.,;:]+|[.,;:]+$', '', 'g')))) > 0 AS verb,
  len(list_filter(list_transform(string_split_regex(regexp_extract(low, '^(.*?)(?:{DATED})', 1), ' +'), lambda w: regexp_replace(w, '^[.,;:|()—–-]+|[.,;:|()—–-]+$', '', 'g')), lambda w: w <> '' AND NOT regexp_matches(w, '{quoted(en.DATE_WORD_RX)}'))) >= 2 AS two FROM el),
er AS (SELECT *, is_bullet OR (NOT has_date AND verb) AS is_description, contains(low, 'internship') AND has_date AND NOT is_bullet AS is_internship, contains(text, '|') AND has_date AS is_continuation,
  contains(text, '|') AND has_date AND regexp_matches(low, 'domain|platform|project') AS is_sub_entry, has_date AND two AS has_role, contains(text, '|') AS has_bar FROM ed)"""


@query(on_resumes(LK + EXP + f" SELECT doc_id, page, line_index, {', '.join(en.EXP_RULES)} FROM er"))
def exp_line_rules(spark, sf_dir):
    return en.exp_line_rules(lines(spark, sf_dir))


def _heads(section):
    def run(spark, sf_dir):
        return en.heads(known_lines(spark, sf_dir), F.col("is_head"), section)

    return run


for _name, _section in (("edu_heads", "EDUCATION"), ("proj_heads", "PROJECT")):
    query(on_resumes(LK + f" SELECT doc_id, page, line_index FROM lk WHERE is_head AND section = '{_section}'"), _name)(_heads(_section))


#: Experience lines whose jobs have a bullet on every second line, and whose bullets are those of sub-entries on every third.
SLICED = """, sx AS (SELECT *, CASE WHEN is_head AND line_index % 2 = 0 THEN '• ' || text WHEN kind = 'bullet' AND line_index % 3 = 0 THEN replace(text, '•', '◦') WHEN kind = 'bullet' AND line_index % 7 = 1 THEN '( 2019 - 2020 )' ELSE text END AS tx,
  is_head OR line_index % 2 = 1 AS bg FROM lk WHERE section = 'EXPERIENCE')"""
_words = lambda x: ", ".join(f"'{w}'" for w in x)


@query(on_resumes(LK + SLICED + f""", sf AS (SELECT *, lower(trim(tx)) AS low, string_split_regex(trim(tx), ' +') AS ws, list_filter(string_split_regex(trim(tx), ' +'), lambda w: NOT list_contains({sql_list(en.LINE_MARKS)}, w))[1] AS fst FROM sx),
sd AS (SELECT *, regexp_matches(low, '{DATED}') AS dt, len(list_filter(ws, lambda w: length(w) > 3 AND NOT regexp_matches(lower(w), '{quoted(en.DATE_WORD_RX)}') AND NOT regexp_matches(lower(w), '{DATED}') AND w NOT IN ({_words(en.MAIN_BULLETS + en.SUB_BULLETS)}))) > 0 AS oth FROM sf)
SELECT doc_id, page, line_index FROM sd WHERE bg AND fst IS NOT NULL AND NOT (dt AND (fst IN ('(', '|') OR NOT oth)) AND fst NOT IN ({_words(en.SUB_BULLETS)}) AND NOT (fst NOT IN ({_words(en.MAIN_BULLETS)}) AND (fst IN ('(', '|') OR dt OR regexp_matches(low, '{'|'.join(en.FIRM_FORMS)}')))
  AND low NOT IN ({_words(en.WORK_TITLES)})"""))
def exp_heads(spark, sf_dir):
    k, i = known_lines(spark, sf_dir).filter("section = 'EXPERIENCE'"), F.col("line_index")
    bullet = F.col("kind") == "bullet"
    text = F.when(F.col("is_head") & (i % 2 == 0), F.concat(F.lit("• "), "text")).when(bullet & (i % 3 == 0), F.replace("text", F.lit("•"), F.lit("◦"))).when(bullet & (i % 7 == 1), "( 2019 - 2020 )").otherwise(F.col("text"))
    return en.slice_heads(k.withColumn("text", text).withColumn("begins", F.col("is_head") | (i % 2 == 1)))


@query(on_resumes(LK + """, e AS (SELECT * FROM lk WHERE section = 'EXPERIENCE'), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index) AS pos FROM e WHERE is_bold AND kind <> 'heading'),
st AS (SELECT doc_id, font_median, round(x0) AS ind, count(*) AS n, min(pos) AS f FROM b GROUP BY ALL), be AS (SELECT doc_id, arg_max({'f': font_median, 'i': ind}, (n, -f)) AS z FROM st GROUP BY ALL)
SELECT doc_id, page, line_index, coalesce(is_bold AND kind <> 'heading' AND font_median = z.f AND round(x0) = z.i, false) AS is_head FROM e LEFT JOIN be USING (doc_id)"""))
def exp_style_heads(spark, sf_dir):
    return en.exp_style_heads(known_lines(spark, sf_dir).filter("section = 'EXPERIENCE'")).select(*K, "is_head")


@query(on_resumes(LK + EXP + """, kx AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index) AS pos, (is_head AND line_index % 2 = 0) OR (kind = 'bullet' AND line_index % 5 = 0) AS b, is_head AND line_index % 3 = 0 AS h FROM er WHERE section = 'EXPERIENCE'),
ky AS (SELECT *, CASE WHEN b THEN h OR NOT (is_description OR NOT has_date OR is_continuation) ELSE h AND (has_date OR is_internship OR is_sub_entry OR is_bullet) END AS sure, NOT b AND NOT is_description AND has_date AND NOT has_bar AND has_role AS may FROM kx),
fo AS (SELECT doc_id, page, line_index, pos, sure OR may AS is_head, CASE WHEN sure OR may THEN page END AS hp, CASE WHEN sure OR may THEN line_index END AS hl FROM ky WHERE pos = 1
  UNION ALL SELECT k.doc_id, k.page, k.line_index, k.pos, k.sure OR (k.may AND NOT coalesce(k.page = f.hp AND k.line_index - f.hl BETWEEN 1 AND 5, false)),
  CASE WHEN k.sure OR (k.may AND NOT coalesce(k.page = f.hp AND k.line_index - f.hl BETWEEN 1 AND 5, false)) THEN k.page ELSE f.hp END, CASE WHEN k.sure OR (k.may AND NOT coalesce(k.page = f.hp AND k.line_index - f.hl BETWEEN 1 AND 5, false)) THEN k.line_index ELSE f.hl END
  FROM fo f JOIN ky k ON k.doc_id = f.doc_id AND k.pos = f.pos + 1)
SELECT doc_id, page, line_index, is_head FROM fo"""))
def exp_boundary_fix(spark, sf_dir):
    """Starts scored on every second job and on some bullets, a third of the jobs hinted; the fold mends them."""
    k = known_lines(spark, sf_dir).filter("section = 'EXPERIENCE'").withColumn("inside", F.lit(True))
    k = k.withColumn("begins", (F.col("is_head") & (F.col("line_index") % 2 == 0)) | ((F.col("kind") == "bullet") & (F.col("line_index") % 5 == 0))).withColumn("hinted", F.col("is_head") & (F.col("line_index") % 3 == 0))
    return en.exp_boundary_fix(en.exp_line_rules(k, "begins", "inside", "hinted"))


SPAN = LK + """, hd AS (SELECT doc_id, page, line_index FROM lk WHERE is_head AND section = 'EXPERIENCE'),
x AS (SELECT t.*, hd.doc_id IS NOT NULL AS h, regexp_matches(token, '[A-Za-z0-9]') AS an FROM t LEFT JOIN hd USING (doc_id, page, line_index) WHERE section = 'EXPERIENCE'),
sp AS (SELECT *, CASE WHEN h AND an AND sum(CAST(an AS INT)) OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) = 1 THEN 'B-ENTRY' WHEN max(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY page, line_index, token_index, x0) = 1 THEN 'I-ENTRY' ELSE 'O' END AS entry_label FROM x)"""


def spans(spark, sf_dir):
    k = known_lines(spark, sf_dir)
    return en.expand_span(resume_tokens(spark, sf_dir).filter("section = 'EXPERIENCE'"), en.heads(k, F.col("is_head"), "EXPERIENCE"))


@query(on_resumes(SPAN + " SELECT doc_id, page, line_index, token_index, entry_label FROM sp"))
def expand_span(spark, sf_dir):
    return spans(spark, sf_dir).select(*TK, "entry_label")


DATE_TOKEN = quoted(rf"^(?:{en.MONTHS})[’'.,]?[0-9]*$|^[(]?(?:19|20)[0-9]{{2}}|^(?:{en.OPEN_END})$")


@query(on_resumes(f" SELECT doc_id, page, line_index, token_index, CASE WHEN bio_label LIKE 'B-%' AND regexp_matches(token, '{DATE_TOKEN}') THEN 'I-ENTRY' WHEN bio_label LIKE 'B-%' THEN 'B-ENTRY' ELSE 'O' END AS entry_label FROM t"))
def demote_dates(spark, sf_dir):
    marked = resume_tokens(spark, sf_dir).withColumn("entry_label", F.when(F.col("bio_label").startswith("B-"), "B-ENTRY").otherwise("O"))
    return en.demote_dates(marked).select(*TK, "entry_label")


ENTRIES = LK + """, hd AS (SELECT doc_id, page, line_index FROM lk WHERE is_head AND section = 'EXPERIENCE'),
x AS (SELECT t.*, CASE WHEN hd.doc_id IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) = 1 THEN 1 ELSE 0 END AS f FROM t LEFT JOIN hd USING (doc_id, page, line_index) WHERE section = 'EXPERIENCE'),
g AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY page, line_index, token_index, x0) AS n, sum(f) OVER (PARTITION BY doc_id) AS a FROM x),
ge AS (SELECT * EXCLUDE (f, n, a), CAST(greatest(n - 1, 0) AS BIGINT) AS entry_id FROM g WHERE n > 0 OR a = 0)"""


def entries(spark, sf_dir):
    k = known_lines(spark, sf_dir)
    return en.group_entries(resume_tokens(spark, sf_dir).filter("section = 'EXPERIENCE'"), en.heads(k, F.col("is_head"), "EXPERIENCE"))


@query(on_resumes(ENTRIES + " SELECT doc_id, page, line_index, token_index, entry_id FROM ge"))
def group_entries(spark, sf_dir):
    return entries(spark, sf_dir).select(*TK, "entry_id")


@query(on_resumes(LK + """, h AS (SELECT doc_id, page, y0 AS top, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0) - 1 AS band, coalesce(lead(y0) OVER (PARTITION BY doc_id, page ORDER BY y0), 1e9) AS bottom FROM lk WHERE is_head)
SELECT t.doc_id, t.page, t.line_index, t.token_index, CAST(band AS INT) AS band FROM t JOIN h ON h.doc_id = t.doc_id AND h.page = t.page AND t.y0 >= top - 3 AND t.y0 < bottom - 1.5"""))
def group_entries_y0(spark, sf_dir):
    heads = known_lines(spark, sf_dir).filter("is_head")
    return en.group_entries_by_height(resume_tokens(spark, sf_dir), heads).select(*TK, "band")


@query(on_resumes(L + " SELECT doc_id, page, round_even(y0 / 3, 0) * 3 AS band, arg_min(line_index, (x0, line_index)) AS line_index FROM l GROUP BY ALL"))
def collapse_y0(spark, sf_dir):
    return en.collapse_heights(lines(spark, sf_dir))


@query(on_resumes(LK + """, n AS (SELECT *, CASE WHEN is_head OR kind = 'heading' THEN CASE WHEN kind = 'heading' THEN first_value(CASE WHEN kind IN ('job', 'school', 'project') THEN {'p': page, 'l': line_index} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, line_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
 ELSE {'p': page, 'l': line_index} END END AS z FROM lk) SELECT DISTINCT doc_id, z.p AS page, z.l AS line_index FROM n WHERE z IS NOT NULL"""))
def shift_heads(spark, sf_dir):
    k = known_lines(spark, sf_dir).withColumn("cand", F.col("is_head")).withColumn("is_head", F.col("is_head") | (F.col("kind") == "heading"))
    return en.shift_heads(k, F.col("kind") == "heading", F.col("cand"))


@query(on_resumes(SEGMENTS + """, lk AS (SELECT DISTINCT doc_id, page, line_index FROM t WHERE kind IN ('job', 'school', 'project')),
c AS (SELECT *, coalesce(page <> lag(page) OVER v OR line_index <> lag(line_index) OVER v, true) AS ch FROM si WINDOW v AS (PARTITION BY doc_id ORDER BY seg_index)),
r AS (SELECT *, sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg_index) AS run FROM c)
SELECT doc_id, seg_index, text, CASE WHEN (doc_id, page, line_index) NOT IN (SELECT doc_id, page, line_index FROM lk) OR run > min(run) OVER (PARTITION BY doc_id, page, line_index) THEN 'O' WHEN seg_index = min(seg_index) OVER (PARTITION BY doc_id, run) THEN 'B-ENTRY' ELSE 'I-ENTRY' END AS label FROM r"""))
def label_segments(spark, sf_dir):
    runs = group_runs(segments(spark, sf_dir))
    return en.label_segments(runs, known_lines(spark, sf_dir).filter("is_head").select(*K)).select("doc_id", "seg_index", "text", "label")


@query(on_resumes(LK + " SELECT doc_id, page, line_index, section = 'EXPERIENCE' AS in_section FROM lk WHERE is_head"))
def scope_heads(spark, sf_dir):
    k = known_lines(spark, sf_dir)
    return en.scope_heads(k.filter("is_head").select(*K), k.filter("section = 'EXPERIENCE'").select(*K))


@query(on_resumes(ENTRIES + rf""", dx AS (SELECT *, bio_label = 'B-ROLE' AS ti, regexp_matches(token, '^[(]?(?:19|20)[0-9]{{2}}[)]?$|^(?:{en.OPEN_END})$') AS dt, regexp_matches(lower(token), '{en.OPEN_RANGE_RX}') AS op FROM ge),
r AS (SELECT *, sum(CASE WHEN ti THEN 1 ELSE 0 END) OVER v AS run FROM dx WINDOW v AS (PARTITION BY doc_id ORDER BY page, line_index, token_index, x0)),
n AS (SELECT *, sum(CASE WHEN dt AND NOT op THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY page, line_index, token_index, x0) AS nth FROM r)
SELECT doc_id, page, line_index, token_index, entry_id, CASE WHEN op OR nth % 2 = 0 THEN 'EDATE' ELSE 'SDATE' END AS date_role FROM n WHERE dt"""))
def date_roles(spark, sf_dir):
    """Years and open ends of the jobs as dates, roles as titles, with the entry that each date belongs to."""
    dated = F.col("token").rlike(rf"^[(]?(?:19|20)[0-9]{{2}}[)]?$|^(?:{en.OPEN_END})$")
    return en.date_roles(entries(spark, sf_dir), F.col("bio_label") == "B-ROLE", dated, F.col("token")).select(*TK, "entry_id", "date_role")
