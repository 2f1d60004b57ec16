"""Queries over layout and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import layout as lo
from docweave.plans.lines_queries import L, lines
from docweave.plans.registry import query
from docweave.plans.twins import on_resumes
from docweave.sources.tables import resume_tokens

TK = ("doc_id", "page", "line_index", "token_index")


@query(on_resumes(" SELECT doc_id, page, line_index, token_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, token_index) AS INT) AS read_pos FROM t"))
def order_simple(spark, sf_dir):
    return lo.order_simple(resume_tokens(spark, sf_dir)).select(*TK, "read_pos")


#: Tokens tc whose education and skills are sections of no known kind, the education in two columns.
COLUMNS = """, tc AS (SELECT * REPLACE (x0 + CASE WHEN section = 'EDUCATION' AND token_index > 0 THEN 60 ELSE 0 END AS x0, x1 + CASE WHEN section = 'EDUCATION' AND token_index > 0 THEN 60 ELSE 0 END AS x1,
  CASE section WHEN 'EDUCATION' THEN 'STUDIES' WHEN 'SKILLS' THEN CASE WHEN doc_id % 2 = 0 THEN 'TOOLS' ELSE 'SKILLS' END ELSE section END AS section) FROM t)"""
GUTTERS = COLUMNS + """, ex AS (SELECT doc_id, page, section, min(x0) AS low, max(x1) - min(x0) AS width, count(*) AS n FROM tc GROUP BY ALL),
sc AS (SELECT *, CAST(trunc(low + 0.05 * width) AS INT) AS s, CAST(trunc(low + 0.55 * width) AS INT) AS e FROM ex),
ca AS (SELECT DISTINCT tc.doc_id, tc.page, tc.section, unnest([s, CAST(ceil(x1) AS INT)]) AS x FROM tc JOIN sc USING (doc_id, page, section) WHERE e > s),
cn AS (SELECT ca.doc_id, ca.page, ca.section, ca.x, count(tc.x0) AS n FROM ca JOIN sc ON sc.doc_id = ca.doc_id AND sc.page = ca.page AND sc.section = ca.section AND ca.x BETWEEN s AND e
  LEFT JOIN tc ON tc.doc_id = ca.doc_id AND tc.page = ca.page AND tc.section = ca.section AND tc.x0 < ca.x AND ca.x < tc.x1 AND regexp_matches(tc.token, '[A-Za-z0-9]') GROUP BY ALL),
be AS (SELECT doc_id, page, section, arg_min(x, (n, x)) AS gutter_x, min(n) AS "overlaps" FROM cn GROUP BY ALL),
fr AS (SELECT doc_id, page, section, line_index, min(CASE WHEN x0 >= gutter_x THEN x0 END) - max(CASE WHEN x1 <= gutter_x THEN x1 END) AS gap FROM tc JOIN be USING (doc_id, page, section) GROUP BY ALL HAVING NOT max(x0 < gutter_x AND gutter_x < x1)),
fl AS (SELECT doc_id, page, section, count(*) AS free FROM fr WHERE gap BETWEEN 10 AND 150 GROUP BY ALL),
gu AS (SELECT doc_id, page, section, gutter_x, CAST("overlaps" AS BIGINT) AS "overlaps", ("overlaps" <= 3 OR "overlaps" < 0.08 * n) AND coalesce(free, 0) >= 2 AS has_gutter FROM be JOIN ex USING (doc_id, page, section) LEFT JOIN fl USING (doc_id, page, section))"""


def two_columns(spark, sf_dir):
    apart = F.when((F.col("section") == "EDUCATION") & (F.col("token_index") > 0), 60).otherwise(0)
    section = F.when(F.col("section") == "EDUCATION", "STUDIES").when((F.col("section") == "SKILLS") & (F.col("doc_id") % 2 == 0), "TOOLS").otherwise(F.col("section"))
    return resume_tokens(spark, sf_dir).withColumn("x0", F.col("x0") + apart).withColumn("x1", F.col("x1") + apart).withColumn("section", section)


@query(on_resumes(GUTTERS + """, nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index, token_index, x0) AS ath, round(avg(y0) OVER (PARTITION BY doc_id, page, section), 6) AS sy FROM tc),
se AS (SELECT *, min(ath) OVER (PARTITION BY doc_id, page, section) AS seen FROM nu),
kr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, section ORDER BY y0, line_index, token_index) AS pos FROM se WHERE section IN ('PERSONAL', 'SKILLS')),
fo AS (SELECT doc_id, page, section, ath, pos, y0 AS high, y1 - y0 AS tall, 1 AS n, 0 AS row FROM kr WHERE pos = 1
  UNION ALL SELECT k.doc_id, k.page, k.section, k.ath, k.pos, CASE WHEN abs(k.y0 - high / n) < greatest(4.0, 0.4 * tall / n) THEN high + k.y0 ELSE k.y0 END, CASE WHEN abs(k.y0 - high / n) < greatest(4.0, 0.4 * tall / n) THEN tall + k.y1 - k.y0 ELSE k.y1 - k.y0 END,
  CASE WHEN abs(k.y0 - high / n) < greatest(4.0, 0.4 * tall / n) THEN n + 1 ELSE 1 END, CASE WHEN abs(k.y0 - high / n) < greatest(4.0, 0.4 * tall / n) THEN row ELSE row + 1 END FROM fo f JOIN kr k ON k.doc_id = f.doc_id AND k.page = f.page AND k.section = f.section AND k.pos = f.pos + 1),
ke AS (SELECT se.*, fo.row, CASE WHEN has_gutter AND se.section NOT IN ('PERSONAL', 'SKILLS', 'EXPERIENCE', 'EDUCATION', 'PROJECT') THEN gutter_x END AS g FROM se LEFT JOIN fo ON fo.doc_id = se.doc_id AND fo.ath = se.ath LEFT JOIN gu ON gu.doc_id = se.doc_id AND gu.page = se.page AND gu.section = se.section)
SELECT doc_id, page, line_index, token_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, sy, seen, CASE WHEN (x0 + x1) / 2 >= g THEN 1 ELSE 0 END, CASE WHEN row IS NOT NULL THEN row WHEN g IS NOT NULL THEN y0 ELSE line_index END, x0, ath) AS INT) AS read_pos FROM ke"""))
def order_reading(spark, sf_dir):
    return lo.order_reading(two_columns(spark, sf_dir)).select(*TK, "read_pos")


@query(on_resumes(GUTTERS + " SELECT * FROM gu"))
def detect_gutter(spark, sf_dir):
    return lo.detect_gutter(two_columns(spark, sf_dir))


@query(on_resumes(""", s AS (SELECT *, coalesce(line_index <> lag(line_index) OVER v OR section <> lag(section) OVER v OR x0 - lag(x1) OVER v > 30, false) AS st FROM t WINDOW v AS (PARTITION BY doc_id, page ORDER BY line_index, token_index))
SELECT doc_id, page, line_index, token_index, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_index, token_index) AS new_line FROM s"""))
def rebuild_line_index(spark, sf_dir):
    return lo.rebuild_line_index(resume_tokens(spark, sf_dir)).select(*TK, "new_line")


@query(on_resumes(""", mv AS (SELECT * REPLACE (line_index + CASE WHEN token_index % 3 = 2 THEN 5 ELSE 0 END AS line_index, x0 + CASE WHEN token_index % 5 = 4 THEN 0.25 ELSE 0.001 END AS x0) FROM t),
og AS (SELECT doc_id, page, CAST(round(x0 * 100) AS BIGINT) AS rx, CAST(round(y0 * 100) AS BIGINT) AS ry, arg_max(line_index, (line_index, token_index)) AS restored_line FROM t GROUP BY ALL)
SELECT mv.doc_id, mv.page, mv.line_index, mv.token_index, restored_line FROM mv LEFT JOIN og ON og.doc_id = mv.doc_id AND og.page = mv.page AND og.rx = CAST(round(mv.x0 * 100) AS BIGINT) AND og.ry = CAST(round(mv.y0 * 100) AS BIGINT)"""))
def restore_line_index(spark, sf_dir):
    """Tokens whose lines were renumbered find their own by place; those that moved find none."""
    t = resume_tokens(spark, sf_dir)
    moved = t.withColumn("line_index", F.col("line_index") + F.when(F.col("token_index") % 3 == 2, 5).otherwise(0)).withColumn("x0", F.col("x0") + F.when(F.col("token_index") % 5 == 4, 0.25).otherwise(0.001))
    return lo.restore_line_index(moved, t).select(*TK, "restored_line")


@query(on_resumes(" SELECT DISTINCT doc_id, page, line_index, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY page, line_index) - 1 AS INT) AS doc_line FROM t"))
def line_ordinal_map(spark, sf_dir):
    return lo.line_ordinals(resume_tokens(spark, sf_dir))


MEDIANS = """, ga AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) AS gp, y1 - y0 AS h FROM t),
md AS (SELECT doc_id, median(font_size) AS font, median(CASE WHEN gp > 0 THEN gp END) AS gap, quantile_disc(h, 0.5) AS height FROM ga GROUP BY ALL)"""


@query(on_resumes(MEDIANS + " SELECT * FROM md"))
def doc_medians(spark, sf_dir):
    return lo.doc_medians(resume_tokens(spark, sf_dir))


def scaled(c):
    return f"CASE WHEN max({c}) OVER d > min({c}) OVER d THEN least(1.0, greatest(0.0, ({c} - min({c}) OVER d) / (max({c}) OVER d - min({c}) OVER d))) ELSE 0.0 END"


LINE_VECTORS = L + f""", f AS (SELECT doc_id, page, line_index, [{', '.join(scaled(c) for c in ('x0', 'y0', 'x1', 'y1', 'font_median'))}, CAST(CAST(is_bold AS INT) AS DOUBLE), CAST(CAST(is_caps AS INT) AS DOUBLE), least(1.0, n_tokens / 20.0), CAST(CAST(ends_with(text, ':') AS INT) AS DOUBLE),
 (row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index) - 1) / greatest(1, count(*) OVER d - 1)] AS v FROM l WINDOW d AS (PARTITION BY doc_id)),
lv AS (SELECT doc_id, page, line_index, list_transform(v, lambda x: round(CAST(x AS DOUBLE), 6)) AS v FROM f)"""


@query(on_resumes(LINE_VECTORS + " SELECT * FROM lv"))
def line_vector10(spark, sf_dir):
    return lo.line_vector(lines(spark, sf_dir))


@query(on_resumes(L + """ SELECT doc_id, page, line_index, coalesce(substr(lag(text) OVER v, 1, 120), '') || ' [SEP] ' || text || ' [SEP] ' || coalesce(substr(lead(text) OVER v, 1, 120), '') AS context,
CASE WHEN lag(page) OVER v = page THEN y0 - lag(y1) OVER v END AS gap FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY page, line_index)"""))
def line_context(spark, sf_dir):
    return lo.line_context(lines(spark, sf_dir))


@query(on_resumes(""", p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) AS pos FROM t)
SELECT doc_id, page, line_index, token_index, CAST(least(10, pos - max(CASE WHEN token IN ('|', '-', '(', ')', '•', ',', ':') OR pos = 1 THEN pos END) OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index)) AS INT) AS delimiter_distance FROM p"""))
def delimiter_distance(spark, sf_dir):
    return lo.delimiter_distance(resume_tokens(spark, sf_dir)).select(*TK, "delimiter_distance")


@query(on_resumes(L + " SELECT doc_id, page, line_index, coalesce(line_index - max(CASE WHEN is_caps THEN line_index END) OVER (PARTITION BY doc_id, page ORDER BY line_index), 99) AS heading_distance FROM l"))
def heading_distance(spark, sf_dir):
    return lo.heading_distance(lines(spark, sf_dir), F.col("is_caps")).select("doc_id", "page", "line_index", "heading_distance")


@query(on_resumes(MEDIANS + """, lw AS (SELECT doc_id, page, line_index, string_agg(token, '' ORDER BY token_index) AS whole, least(count(*), 15) / 15 AS len, arg_min(token, (x0, token_index)) AS head FROM t GROUP BY ALL),
s AS (SELECT t.*, greatest(coalesce(md.gap, 1.0), 0.000001) AS mg, greatest(md.height, 0.000001) AS mh, whole, len, head, lag(page) OVER v AS pp, lag(line_index) OVER v AS pl, lag(x1) OVER v AS px, lag(y1) OVER v AS py, greatest(max(y1) OVER d - min(y0) OVER d, 0.000001) AS hi, max(font_size) OVER d AS mf, max(line_index) OVER (PARTITION BY doc_id, page) AS ml
  FROM t JOIN md USING (doc_id) JOIN lw USING (doc_id, page, line_index) WINDOW v AS (PARTITION BY doc_id ORDER BY page, line_index, token_index, x0), d AS (PARTITION BY doc_id))
SELECT doc_id, page, line_index, token_index, list_transform([CASE WHEN pp = page THEN (x0 - px) / mg ELSE 0.0 END, CASE WHEN pp = page THEN (y0 - py) / mh WHEN pp IS NOT NULL THEN y0 / hi ELSE 0.0 END, CASE WHEN pp = page AND pl = line_index THEN 0 ELSE 1 END, CAST(is_bold AS INT),
  CAST(token = upper(token) AND token <> lower(token) AND length(token) > 1 AS INT), font_size / mf, len, CAST(whole = upper(whole) AND whole <> lower(whole) AND length(whole) > 1 AS INT), CAST(head IN ('•', '*', '-', '▪', '◦', '■', '–', '—', '·', '✓', '✔') AS INT), line_index / greatest(ml, 1)], lambda x: round(CAST(x AS DOUBLE), 6)) AS v FROM s"""))
def token_vector10(spark, sf_dir):
    return lo.token_vector(resume_tokens(spark, sf_dir))


@query(on_resumes(", c AS (SELECT doc_id, section, font_size, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, section, max(font_size) AS largest, arg_min(font_size, (-n, font_size)) AS usual, min(font_size) AS smallest FROM c GROUP BY ALL"))
def font_stats(spark, sf_dir):
    return lo.font_stats(resume_tokens(spark, sf_dir))


def shown(value: str, weight: float, rx: str, most: int | None) -> str:
    few = "" if most is None else f" AND len(string_split_regex(c, ' +')) <= {most}"
    return f"CASE WHEN regexp_matches({value}, '{rx}'){few} THEN {weight} ELSE 0.0 END"


LIKENESS = " + ".join([*(shown("lower(c)", *rule) for rule in lo.TITLE_RULES), shown("c", *lo.COLON_TITLE)])


@query(on_resumes(L + f", cl AS (SELECT *, trim(regexp_replace(trim(text), '^[•*●·▪■◦✓✔ -]+', '')) AS c FROM l) SELECT doc_id, page, line_index, CASE WHEN c = '' THEN 0.0 ELSE round(CAST(least(1.0, {LIKENESS}) AS DOUBLE), 6) END::DOUBLE AS likeness FROM cl"))
def title_likeness(spark, sf_dir):
    return lo.with_likeness(lines(spark, sf_dir)).select("doc_id", "page", "line_index", "likeness")
