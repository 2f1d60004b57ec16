"""Queries over truth alignment. Predictions are the truth with regular errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import alignment as al
from docweave.plans.entries_queries import LK, known_lines
from docweave.plans.lines_queries import L, lines
from docweave.plans.registry import query
from docweave.plans.twins import on_resumes
from docweave.sources.tables import resume_tokens, staged

K = ("doc_id", "page", "line_index")
TK = (*K, "token_index")

#: Predicted tokens p: some moved, some with a character more, some labels lost.
P = """, p AS (SELECT * REPLACE (x0 + CASE WHEN token_index % 6 = 5 THEN 3 ELSE 0 END AS x0, y0 + CASE WHEN token_index % 6 = 5 THEN 14 ELSE 0 END AS y0, CASE WHEN token_index % 7 = 6 THEN token || 'x' ELSE token END AS token, CASE WHEN token_index % 5 = 4 THEN 'O' ELSE bio_label END AS bio_label) FROM t WHERE doc_id % 11 <> 10 OR token_index <> 2)"""


def predicted(spark, sf_dir):
    i = F.col("token_index")
    t = resume_tokens(spark, sf_dir).filter("doc_id % 11 <> 10 OR token_index <> 2")
    return (
        t.withColumn("x0", F.col("x0") + F.when(i % 6 == 5, 3).otherwise(0)).withColumn("y0", F.col("y0") + F.when(i % 6 == 5, 14).otherwise(0))
        .withColumn("token", F.when(i % 7 == 6, F.concat("token", F.lit("x"))).otherwise(F.col("token"))).withColumn("bio_label", F.when(i % 5 == 4, "O").otherwise(F.col("bio_label")))
    )


COORD = P + """, kn AS (SELECT doc_id, page, CAST(round(x0) AS BIGINT) AS rx, CAST(round(y0) AS BIGINT) AS ry, min(bio_label) AS truth FROM t GROUP BY ALL),
co AS (SELECT p.*, truth FROM p LEFT JOIN kn ON kn.doc_id = p.doc_id AND kn.page = p.page AND rx = CAST(round(p.x0) AS BIGINT) AND ry = CAST(round(p.y0) AS BIGINT))"""


@query(on_resumes(COORD + " SELECT doc_id, page, line_index, token_index, truth FROM co"))
def align_coord(spark, sf_dir):
    return al.align_coord(predicted(spark, sf_dir), resume_tokens(spark, sf_dir)).select(*TK, "truth")


@query(on_resumes(L + """, q AS (SELECT doc_id, page, line_index, list_distinct(string_split_regex(CASE WHEN line_index % 3 = 0 THEN text || ' more' ELSE text END, ' +')) AS w FROM l), b AS (SELECT doc_id, page, line_index, list_distinct(string_split_regex(text, ' +')) AS w FROM l),
s AS (SELECT q.doc_id, q.page, q.line_index AS a_line, b.line_index AS b_line, len(list_intersect(q.w, b.w)) AS c, len(q.w) + len(b.w) - len(list_intersect(q.w, b.w)) AS u FROM q JOIN b ON q.doc_id = b.doc_id AND q.page = b.page)
SELECT doc_id, page, a_line, b_line, round(c / u, 6) AS score FROM s WHERE c > 0 AND c / u >= 0.85 QUALIFY row_number() OVER (PARTITION BY doc_id, page, a_line ORDER BY c / u DESC, b_line) = 1"""))
def align_line_jaccard(spark, sf_dir):
    known = lines(spark, sf_dir)
    longer = known.withColumn("text", F.when(F.col("line_index") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return al.align_line_jaccard(longer, known)


FUZZY = """ SELECT {src}.doc_id, {src}.page, {src}.line_index, {src}.token_index, arg_min(t.bio_label, (abs({src}.y0 - t.y0), abs({src}.x0 - t.x0), t.y0, t.x0, t.bio_label)) AS truth FROM {src} JOIN t ON t.doc_id = {src}.doc_id AND t.page = {src}.page AND t.token = {src}.token AND abs({src}.x0 - t.x0) <= 5 AND abs({src}.y0 - t.y0) <= 80 GROUP BY ALL"""
MERGED = """ SELECT {src}.doc_id, {src}.page, {src}.line_index, {src}.token_index, arg_min(t.bio_label, (t.line_index, t.token_index, t.bio_label)) AS truth FROM {src} JOIN t ON t.doc_id = {src}.doc_id AND t.page = {src}.page AND abs({src}.y0 - t.y0) <= 3
  AND ((abs({src}.x0 - t.x0) <= 1 AND (starts_with({src}.token, t.token) OR starts_with(t.token, {src}.token)))
    OR (contains(t.token, {src}.token) AND NOT regexp_matches(split_part(t.token, {src}.token, 1), '[A-Za-z0-9]$') AND NOT regexp_matches(substr(t.token, instr(t.token, {src}.token) + length({src}.token)), '^[A-Za-z0-9]'))) GROUP BY ALL"""


@query(on_resumes(P + FUZZY.format(src="p")))
def align_fuzzy_token(spark, sf_dir):
    return al.align_fuzzy_token(predicted(spark, sf_dir), resume_tokens(spark, sf_dir))


@query(on_resumes(P + MERGED.format(src="p")))
def align_merged(spark, sf_dir):
    return al.align_merged(predicted(spark, sf_dir), resume_tokens(spark, sf_dir))


BY_LINE = """pl AS (SELECT doc_id, page, line_index, list_distinct(string_split(string_agg(token, ' ' ORDER BY token_index), ' ')) AS w FROM p GROUP BY ALL), tl AS (SELECT doc_id, page, line_index, list_distinct(string_split(string_agg(token, ' ' ORDER BY token_index), ' ')) AS w FROM t GROUP BY ALL),
ls AS (SELECT pl.doc_id, pl.page, pl.line_index, tl.line_index AS b_line, len(list_intersect(pl.w, tl.w)) AS c, len(pl.w) + len(tl.w) - len(list_intersect(pl.w, tl.w)) AS u FROM pl JOIN tl ON pl.doc_id = tl.doc_id AND pl.page = tl.page),
lb AS (SELECT * FROM ls WHERE c > 0 AND c / u >= 0.85 QUALIFY row_number() OVER (PARTITION BY doc_id, page, line_index ORDER BY c / u DESC, b_line) = 1),
pn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) AS nth FROM p), tn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) AS nth FROM t),
li AS (SELECT pn.doc_id, pn.page, pn.line_index, pn.token_index, tn.bio_label AS truth FROM pn JOIN lb USING (doc_id, page, line_index) JOIN tn ON tn.doc_id = pn.doc_id AND tn.page = pn.page AND tn.line_index = lb.b_line AND tn.nth = pn.nth WHERE tn.bio_label NOT IN ('O', 'B-HEADING', 'I-HEADING'))"""


@query(on_resumes(COORD + ", " + BY_LINE + ", fu AS (" + FUZZY.format(src="p") + "), me AS (" + MERGED.format(src="p") + """) SELECT p.doc_id, p.page, p.line_index, p.token_index, CASE WHEN co.truth IS NOT NULL THEN co.truth WHEN li.truth IS NOT NULL THEN li.truth WHEN fu.truth IS NOT NULL THEN fu.truth ELSE me.truth END AS truth,
 CASE WHEN co.truth IS NOT NULL THEN 'coord' WHEN li.truth IS NOT NULL THEN 'line' WHEN fu.truth IS NOT NULL THEN 'fuzzy' ELSE 'merged' END AS rule
 FROM p JOIN co USING (doc_id, page, line_index, token_index) LEFT JOIN li USING (doc_id, page, line_index, token_index) LEFT JOIN fu USING (doc_id, page, line_index, token_index) LEFT JOIN me USING (doc_id, page, line_index, token_index) WHERE coalesce(co.truth, li.truth, fu.truth, me.truth) IS NOT NULL"""))
def align_cascade(spark, sf_dir):
    return al.align_cascade(predicted(spark, sf_dir), resume_tokens(spark, sf_dir))


@query(on_resumes(LK + """, h AS (SELECT doc_id, page * 100 + line_index AS head_id, string_split(regexp_replace(text, ' [^ ]+$', ''), ' ') AS hw FROM lk WHERE is_head), b AS (SELECT doc_id, page, line_index, string_split(text, ' ') AS lw FROM lk),
s AS (SELECT h.doc_id, head_id, page, line_index, CAST(coalesce(list_min(list_filter(range(1, least(len(hw), len(lw)) + 1), lambda i: hw[i] <> lw[i])) - 1, least(len(hw), len(lw))) AS INT) AS prefix, CAST(len(list_distinct(list_intersect(hw, lw))) AS INT) AS shared FROM h JOIN b USING (doc_id))
SELECT * FROM s WHERE prefix > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, head_id ORDER BY prefix DESC, shared DESC, page, line_index) = 1"""))
def align_head_content(spark, sf_dir):
    k = staged(spark, sf_dir, "resume_known_lines", lambda _: known_lines(spark, sf_dir))
    heads = k.filter("is_head").select("doc_id", (F.col("page") * 100 + F.col("line_index")).alias("head_id"), F.regexp_replace("text", " [^ ]+$", "").alias("head_text"))
    return al.align_head_content(heads, k)


@query(on_resumes(P + """, a AS (SELECT doc_id, page, line_index, CAST(row_number() OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) AS INT) AS nth, token AS found FROM p), b AS (SELECT doc_id, page, line_index, CAST(row_number() OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) AS INT) AS nth, token AS expected, bio_label AS truth FROM t)
SELECT * FROM a LEFT JOIN b USING (doc_id, page, line_index, nth)"""))
def align_line_order(spark, sf_dir):
    return al.align_line_order(predicted(spark, sf_dir), resume_tokens(spark, sf_dir))


#: Head lines: truth h, and predictions f with misses and extras.
HEADS = LK + """, h AS (SELECT doc_id, page, line_index FROM lk WHERE is_head), f AS (SELECT doc_id, page, line_index FROM lk WHERE (is_head AND line_index % 4 <> 3) OR (kind = 'bullet' AND line_index % 7 = 0))"""


def head_lines(spark, sf_dir):
    k = known_lines(spark, sf_dir)
    return k.filter("is_head").select(*K), k.filter("(is_head AND line_index % 4 <> 3) OR (kind = 'bullet' AND line_index % 7 = 0)").select(*K)


@query(on_resumes(HEADS + " SELECT doc_id, page, line_index, CASE WHEN f.a IS NULL THEN 'MISSED' WHEN h.b IS NULL THEN 'EXTRA' ELSE 'MATCH' END AS outcome FROM (SELECT *, 1 AS b FROM h) h FULL JOIN (SELECT *, 1 AS a FROM f) f USING (doc_id, page, line_index)"))
def line_compare(spark, sf_dir):
    return al.line_compare(*head_lines(spark, sf_dir))


@query(on_resumes(P + " SELECT doc_id, count(*) FILTER (t.bio_label = p.bio_label) AS match, count(*) FILTER (t.bio_label <> p.bio_label) AS mismatch, count(*) FILTER (p.bio_label IS NULL) AS not_extracted, count(*) FILTER (t.bio_label IS NULL) AS not_in_truth FROM t FULL JOIN p USING (doc_id, page, line_index, token_index) GROUP BY doc_id"))
def token_compare(spark, sf_dir):
    return al.token_compare(resume_tokens(spark, sf_dir), predicted(spark, sf_dir))


@query(on_resumes(HEADS + ", m AS (SELECT * FROM h EXCEPT SELECT * FROM f) SELECT m.doc_id, m.page, m.line_index, arg_min(f.page, (abs(m.page - f.page), abs(m.line_index - f.line_index), f.page, f.line_index)) AS near_page, arg_min(f.line_index, (abs(m.page - f.page), abs(m.line_index - f.line_index), f.page, f.line_index)) AS near_line FROM m JOIN f ON m.doc_id = f.doc_id GROUP BY ALL"))
def nearest_head(spark, sf_dir):
    truth, found = head_lines(spark, sf_dir)
    return al.nearest_head(truth.subtract(found), found)


@query(on_resumes(P + " SELECT t.doc_id, t.page, t.line_index, t.token_index, coalesce(p.bio_label, t.bio_label) AS bio_label FROM t LEFT JOIN p USING (doc_id, page, line_index, token_index)"))
def write_back(spark, sf_dir):
    return al.write_back(resume_tokens(spark, sf_dir), predicted(spark, sf_dir).select(*TK, "bio_label"), "bio_label").select(*TK, "bio_label")


@query(on_resumes(HEADS + " SELECT * FROM h UNION SELECT * FROM f"))
def union_heads(spark, sf_dir):
    truth, found = head_lines(spark, sf_dir)
    return truth.union(found).distinct()


@query(on_resumes(HEADS + " SELECT * FROM h INTERSECT SELECT * FROM f"))
def intersect_heads(spark, sf_dir):
    truth, found = head_lines(spark, sf_dir)
    return truth.intersect(found)


@query(on_resumes(HEADS + " SELECT * FROM f EXCEPT SELECT * FROM h"))
def except_heads(spark, sf_dir):
    truth, found = head_lines(spark, sf_dir)
    return found.subtract(truth)
