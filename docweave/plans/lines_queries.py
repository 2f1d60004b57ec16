"""Queries over lines, segments and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import lines as ln
from docweave.plans.registry import query
from docweave.plans.twins import on_resumes
from docweave.sources.tables import resume_line_rows, resume_lines, resume_tokens

#: Lines l of the résumés, as build_lines makes them.
L = """, l0 AS (SELECT doc_id, page, line_index, string_agg(token, ' ' ORDER BY x0, token_index) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  median(font_size) AS font_median, arg_min(is_bold, (x0, token_index)) AS is_bold, CAST(count(*) AS INT) AS n_tokens FROM t GROUP BY ALL),
l AS (SELECT *, text = upper(text) AND text <> lower(text) AS is_caps FROM l0)"""
STYLES = L + """, dm AS (SELECT doc_id, quantile_disc(-font_median, 0.5) * -1 AS doc_font FROM l GROUP BY ALL),
st AS (SELECT DISTINCT doc_id, font_median, is_bold, is_caps FROM l JOIN dm USING (doc_id) WHERE is_bold OR is_caps OR font_median > doc_font),
ti AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY font_median DESC, is_bold DESC, is_caps DESC) AS tier FROM st) WHERE tier <= 3),
lt AS (SELECT l.*, CAST(tier AS INT) AS tier FROM l LEFT JOIN ti USING (doc_id, font_median, is_bold, is_caps))"""
PARAS = """, pj AS (SELECT *, (y0 - lag(y1) OVER v) BETWEEN -3 AND 5.5 AND is_bold = lag(is_bold) OVER v AND abs(font_median - lag(font_median) OVER v) < 0.5 AND abs(x0 - lag(x0) OVER v) <= 5
  AND NOT regexp_matches(text, '^[•◦●▪*–-] ') AS joined FROM lt WINDOW v AS (PARTITION BY doc_id, page ORDER BY y0, x0)),
pa AS (SELECT *, sum(CASE WHEN coalesce(joined, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0) AS paragraph FROM pj)"""


def lines(spark, sf_dir):
    """The résumés' lines, as ``build_lines`` makes them."""
    return resume_line_rows(spark, sf_dir)


@query(on_resumes(L + " SELECT * FROM l"))
def build_lines(spark, sf_dir):
    return ln.build_lines(resume_tokens(spark, sf_dir))


@query(on_resumes(""", fm AS (SELECT doc_id, page, line_index, font_size, count(*) AS n, min(token_index) AS f FROM t GROUP BY ALL),
bm AS (SELECT doc_id, page, line_index, is_bold, count(*) AS n, min(token_index) AS f FROM t GROUP BY ALL)
SELECT a.*, b.is_bold, c.content_x0 FROM (SELECT doc_id, page, line_index, arg_max(font_size, (n, -f)) AS font_size FROM fm GROUP BY ALL) a
JOIN (SELECT doc_id, page, line_index, arg_max(is_bold, (n, -f)) AS is_bold FROM bm GROUP BY ALL) b USING (doc_id, page, line_index)
JOIN (SELECT doc_id, page, line_index, coalesce(min(CASE WHEN NOT (token_index = 0 AND regexp_matches(token, '^[•◦●▪\\-*–]$')) THEN x0 END), min(x0)) AS content_x0 FROM t GROUP BY ALL) c USING (doc_id, page, line_index)"""))
def line_majority(spark, sf_dir):
    return ln.line_majority(resume_tokens(spark, sf_dir))


@query(on_resumes(" SELECT doc_id, section, quantile_disc(-font_size, 0.5) * -1 AS font_size, avg(CAST(is_bold AS INT)) > 0.5 AS is_bold FROM t GROUP BY ALL"))
def dominant_style(spark, sf_dir):
    return ln.dominant_style(resume_tokens(spark, sf_dir), ("doc_id", "section"))


@query(on_resumes(STYLES + " SELECT doc_id, page, line_index, text, tier FROM lt"))
def style_tiers(spark, sf_dir):
    return ln.style_tiers(lines(spark, sf_dir)).select("doc_id", "page", "line_index", "text", "tier")


SHIFTED = """, m AS (SELECT * REPLACE (x0 + CASE WHEN token IN ('|', '(') THEN 40 ELSE 0 END AS x0, x1 + CASE WHEN token IN ('|', '(') THEN 40 ELSE 0 END AS x1, is_bold AND token <> 'Portal' AS is_bold) FROM t)"""


def shifted(spark, sf_dir):
    """Résumé tokens with some gaps and some changes of style inside lines."""
    moved = F.when(F.col("token").isin("|", "("), 40).otherwise(0)
    return resume_tokens(spark, sf_dir).withColumn("x0", F.col("x0") + moved).withColumn("x1", F.col("x1") + moved).withColumn("is_bold", F.col("is_bold") & (F.col("token") != "Portal"))


@query(on_resumes(SHIFTED + """, s AS (SELECT *, first_value(regexp_matches(token, '^[•◦●▪\\-*–]$')) OVER v AS bullet, x0 - lag(x1) OVER v > 35 AS wide, is_bold <> lag(is_bold) OVER v OR abs(font_size - lag(font_size) OVER v) > 0.5 AS chg FROM m
  WINDOW v AS (PARTITION BY doc_id, page, line_index ORDER BY x0, token_index))
SELECT doc_id, page, line_index, token_index, sum(CASE WHEN coalesce(wide OR (chg AND NOT bullet), false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_index ORDER BY x0, token_index) AS part FROM s"""))
def split_horizontal(spark, sf_dir):
    return ln.split_horizontal(shifted(spark, sf_dir)).select("doc_id", "page", "line_index", "token_index", "part")


@query(on_resumes(STYLES + PARAS + " SELECT doc_id, page, line_index, paragraph FROM pa"))
def merge_vertical(spark, sf_dir):
    return ln.merge_vertical(lines(spark, sf_dir)).select("doc_id", "page", "line_index", "paragraph")


@query(on_resumes(STYLES + PARAS + """, r AS (SELECT doc_id, page, paragraph, string_agg(text, ' ' ORDER BY y0, x0) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(tier) AS tier FROM pa GROUP BY ALL)
SELECT * REPLACE (CASE WHEN tier = 1 AND lag(tier) OVER (PARTITION BY doc_id ORDER BY page, paragraph) = 1 THEN NULL ELSE tier END AS tier) FROM r"""))
def sentence_records(spark, sf_dir):
    return ln.sentence_records(lines(spark, sf_dir))


SEGMENTS = SHIFTED + """, s AS (SELECT *, first_value(regexp_matches(token, '^[•◦●▪\\-*–]$')) OVER v AS bullet, x0 - lag(x1) OVER v > 35 AS wide, is_bold <> lag(is_bold) OVER v OR abs(font_size - lag(font_size) OVER v) > 0.5 AS chg FROM m
  WINDOW v AS (PARTITION BY doc_id, page, line_index ORDER BY x0, token_index)),
sp AS (SELECT *, sum(CASE WHEN coalesce(wide OR (chg AND NOT bullet), false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_index ORDER BY x0, token_index) AS part FROM s),
sg AS (SELECT doc_id, page, line_index, part, string_agg(token, ' ' ORDER BY x0, token_index) AS text FROM sp GROUP BY ALL),
si AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index, part) - 1 AS INT) AS seg_index FROM sg)"""


def segments(spark, sf_dir):
    from docweave.functions.islands import ordered, ordered_text

    parts = ln.split_horizontal(shifted(spark, sf_dir)).groupBy("doc_id", "page", "line_index", "part").agg(ordered_text(order=("x0", "token_index")).alias("text"))
    return parts.withColumn("seg_index", (F.row_number().over(ordered(("doc_id",), ("page", "line_index", "part"))) - 1).cast("int"))


@query(on_resumes(SEGMENTS + """, c AS (SELECT *, coalesce(page <> lag(page) OVER v OR line_index <> lag(line_index) OVER v, true) AS ch FROM si WINDOW v AS (PARTITION BY doc_id ORDER BY seg_index))
SELECT doc_id, seg_index, text, sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg_index) AS line_run FROM c"""))
def group_by_line_run(spark, sf_dir):
    return ln.group_by_line_run(segments(spark, sf_dir)).select("doc_id", "seg_index", "text", "line_run")


@query(on_resumes(""", w AS (SELECT doc_id, line_no, string_split(txt, ' ') AS w, txt FROM rl), a AS (SELECT *, least(coalesce(nullif(list_position(w, '-'), 0), 9999), coalesce(nullif(list_position(w, '–'), 0), 9999)) AS cutp FROM w),
s AS (SELECT doc_id, line_no, CASE WHEN cutp BETWEEN 2 AND 9998 THEN [array_to_string(w[:cutp-1], ' '), array_to_string(w[cutp+1:], ' ')] ELSE [txt] END AS p FROM a)
SELECT doc_id, line_no, coalesce(len(p) = 2 AND regexp_matches(p[1], '(19|20)[0-9]{2}|Present') AND regexp_matches(p[2], '(19|20)[0-9]{2}|Present'), false) AS is_range, CAST(unnest(range(len(p))) AS INT) AS side, unnest(p) AS side_text FROM s"""))
def split_hyphen(spark, sf_dir):
    rows = resume_lines(spark, sf_dir).withColumnRenamed("txt", "text")
    return ln.split_hyphen(rows).select("doc_id", "line_no", "is_range", "side", "side_text")


@query(on_resumes(""", c AS (SELECT doc_id, page, section, count(*) AS n, min(line_index * 1000 + token_index) AS f FROM t GROUP BY ALL) SELECT doc_id, page, arg_max(section, (n, -f)) AS section FROM c GROUP BY ALL"""))
def majority_section(spark, sf_dir):
    t = resume_tokens(spark, sf_dir).withColumn("token_index", F.col("line_index") * 1000 + F.col("token_index"))
    return ln.majority_section(t, ("doc_id", "page"))


@query(on_resumes(" SELECT doc_id, page, line_index, string_agg(token, ' ' ORDER BY token_index) AS text FROM t GROUP BY ALL"))
def physical_line_text(spark, sf_dir):
    from docweave.functions.islands import ordered_text

    return resume_tokens(spark, sf_dir).groupBy("doc_id", "page", "line_index").agg(ordered_text(order=("token_index",)).alias("text"))


@query(on_resumes(r""", p AS (SELECT *, CASE WHEN contains(token, '@') THEN 'email' WHEN regexp_matches(token, '^\+?[0-9][0-9\-]{7,}$') THEN 'phone' WHEN regexp_matches(token, 'https?://|github|linkedin|www[.]') THEN 'link' ELSE 'text' END AS kind_of,
  token IN ('|', '•', '·', ',', '/') AS separator FROM t WHERE section = 'PERSONAL'),
s AS (SELECT *, separator OR lag(separator) OVER v OR x0 - lag(x1) OVER v > 35 OR bio_label LIKE 'B-%' OR kind_of <> lag(kind_of) OVER v AS st FROM p WINDOW v AS (PARTITION BY doc_id, page, line_index ORDER BY x0, token_index)),
r AS (SELECT *, sum(CASE WHEN coalesce(st, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_index ORDER BY x0, token_index) AS run FROM s)
SELECT doc_id, page, line_index, run, string_agg(token, ' ' ORDER BY x0, token_index) AS text, min(kind_of) AS kind FROM r WHERE NOT separator GROUP BY ALL"""))
def personal_segments(spark, sf_dir):
    return ln.personal_segments(resume_tokens(spark, sf_dir).filter("section = 'PERSONAL'"))
