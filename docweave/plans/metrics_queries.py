"""Queries over evaluation and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import metrics as mt
from docweave.plans.alignment_queries import HEADS, P, head_lines, predicted
from docweave.plans.fields_queries import ENT
from docweave.plans.registry import query
from docweave.plans.twins import on_resumes
from docweave.sources.tables import read, resume_tokens

TK = ("doc_id", "page", "line_index", "token_index")

SCORES = HEADS + """, cm AS (SELECT doc_id, b IS NOT NULL AND a IS NOT NULL AS hit, a IS NULL AS miss, b IS NULL AS ext FROM (SELECT *, 1 AS b FROM h) h FULL JOIN (SELECT *, 1 AS a FROM f) f USING (doc_id, page, line_index)),
sc AS (SELECT doc_id, count(*) FILTER (hit) AS m, count(*) FILTER (miss) AS s, count(*) FILTER (ext) AS x FROM cm GROUP BY doc_id)"""


@query(on_resumes(SCORES + " SELECT doc_id, m AS \"match\", s AS missed, x AS extra, CASE WHEN m + x > 0 THEN round(m / (m + x), 6) END AS \"precision\", CASE WHEN m + s > 0 THEN round(m / (m + s), 6) END AS fba_recall, CASE WHEN 2 * m + s + x > 0 THEN round(2 * m / (2 * m + s + x), 6) END AS fba_f1, round(100 * m / (m + s + x), 4) AS fha FROM sc"))
def metric_prf(spark, sf_dir):
    return mt.head_scores(*head_lines(spark, sf_dir))


@query(on_resumes(SCORES + " SELECT doc_id, round(100 * m / (m + s + x), 4) AS fha FROM sc"))
def metric_fha(spark, sf_dir):
    return mt.head_scores(*head_lines(spark, sf_dir)).select("doc_id", "fha")


@query(on_resumes(SCORES + " SELECT round(sum(m) / sum(m + s), 6) AS fba_recall, round(2 * sum(m) / sum(2 * m + s + x), 6) AS fba_f1 FROM sc"))
def metric_fba(spark, sf_dir):
    """Boundary accuracy over all documents, under both of its names."""
    n = mt.head_scores(*head_lines(spark, sf_dir)).agg(*[F.sum(c).alias(c) for c in ("match", "missed", "extra")])
    return n.select(F.expr("round(match / (match + missed), 6)").alias("fba_recall"), F.expr("round(2 * match / (2 * match + missed + extra), 6)").alias("fba_f1"))


def pairs(spark, sf_dir):
    t = resume_tokens(spark, sf_dir).select(*TK, "token", "section", F.col("bio_label").alias("truth"))
    return t.join(predicted(spark, sf_dir).select(*TK, F.col("bio_label").alias("found")), list(TK))


PAIRS = P + ", pr AS (SELECT t.doc_id, t.section, t.token, t.bio_label AS truth, p.bio_label AS found FROM t JOIN p USING (doc_id, page, line_index, token_index))"


@query(on_resumes(PAIRS + " SELECT doc_id, count(*) AS n, round(avg(CAST(truth = found AS INT)), 6) AS accuracy FROM pr WHERE regexp_matches(token, '[A-Za-z0-9]') GROUP BY doc_id"))
def metric_token_acc(spark, sf_dir):
    return mt.token_accuracy(pairs(spark, sf_dir))


@query(on_resumes(PAIRS + """, a AS (SELECT truth AS label, count(*) AS t, count(*) FILTER (truth = found) AS hit FROM pr GROUP BY ALL), b AS (SELECT found AS label, count(*) AS f FROM pr GROUP BY ALL), n AS (SELECT label, coalesce(t, 0) AS t, coalesce(f, 0) AS f, coalesce(hit, 0) AS hit FROM a FULL JOIN b USING (label))
SELECT label, t, f, hit, CASE WHEN f > 0 THEN round(hit / f, 6) END AS "precision", CASE WHEN t > 0 THEN round(hit / t, 6) END AS recall, CASE WHEN t + f > 0 THEN round(2 * hit / (t + f), 6) END AS f1 FROM n"""))
def metric_block_acc(spark, sf_dir):
    return mt.label_scores(pairs(spark, sf_dir))


@query(on_resumes(" SELECT doc_id, page, line_index, max(CASE WHEN bio_label IN ('B-ROLE', 'B-INSTITUTION', 'B-PROJECT_NAME') THEN 2 WHEN bio_label = 'O' THEN 0 ELSE 1 END) AS boundary FROM t GROUP BY ALL"))
def derive_truth(spark, sf_dir):
    b = mt.derive_boundary(F.col("bio_label"))
    rank = F.when(b == "B-ENTRY", 2).when(b == "I-ENTRY", 1).otherwise(0)
    return resume_tokens(spark, sf_dir).groupBy("doc_id", "page", "line_index").agg(F.max(rank).alias("boundary"))


@query(on_resumes(PAIRS + " SELECT section, count(*) FILTER (truth = found) AS matched, count(*) AS total, round(100 * count(*) FILTER (truth = found) / count(*), 2) AS pct FROM pr GROUP BY section"))
def compare_summary(spark, sf_dir):
    hit = F.count_if(F.col("truth") == F.col("found"))
    return pairs(spark, sf_dir).groupBy("section").agg(hit.alias("matched"), F.count("*").alias("total"), F.round(100 * hit / F.count("*"), 2).alias("pct"))


@query("SELECT event_type AS section, round(100 * avg(CASE WHEN value / 1000 > 0 THEN value / 1000 END), 1) AS confidence FROM events GROUP BY ALL")
def section_confidence(spark, sf_dir):
    return mt.section_confidence(read(spark, sf_dir, "events").select(F.col("event_type").alias("section"), (F.col("value") / 1000).alias("confidence")))


@query("SELECT event_type AS section, round(sum(value), 4) AS duration, round(max(value), 4) AS memory, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def section_scorecard(spark, sf_dir):
    return mt.scorecard(read(spark, sf_dir, "events").selectExpr("event_type AS section", "value AS duration", "value AS memory"))


@query("SELECT user_id AS run_id, event_type AS stage, round(sum(value), 4) AS total_ms, max(value) AS peak, count(*) AS n FROM events GROUP BY ALL")
def stage_summary(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("total_ms"), F.max("value").alias("peak"), F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN value <= 50 THEN 'good' WHEN value <= 150 THEN 'warn' ELSE 'bad' END AS band, round(least(1.0, value / 150), 6) AS fill FROM events")
def health_band(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", mt.health(F.col("value"), 50, 150).alias("band"), F.round(F.least(F.lit(1.0), F.col("value") / 150), 6).alias("fill"))


@query(on_resumes(SCORES + " SELECT doc_id, s + x AS errors, CASE WHEN m + s > 0 THEN round(m / (m + s), 6) END AS fba_recall FROM sc ORDER BY fba_recall, errors DESC, doc_id LIMIT 25"))
def worst_first(spark, sf_dir):
    """The 25 documents with the worst boundaries: a top-k report."""
    s = mt.head_scores(*head_lines(spark, sf_dir)).select("doc_id", (F.col("missed") + F.col("extra")).alias("errors"), "fba_recall")
    return s.orderBy(F.col("fba_recall").asc_nulls_last(), F.desc("errors"), "doc_id").limit(25)


E_ = ENT.format("bio_label")


@query(on_resumes(f" SELECT doc_id, section, count(*) AS tokens, count(*) FILTER (bio_label <> 'O') AS labelled, list_sort(list(DISTINCT {E_})) AS labels FROM t GROUP BY ALL"))
def stage_counts(spark, sf_dir):
    own = F.regexp_replace("bio_label", "^[BI]-", "")
    return resume_tokens(spark, sf_dir).groupBy("doc_id", "section").agg(F.count("*").alias("tokens"), F.count_if(F.col("bio_label") != "O").alias("labelled"), F.array_sort(F.collect_set(own)).alias("labels"))


@query(on_resumes(" SELECT doc_id, page, line_index, token_index, CASE WHEN count(*) OVER (PARTITION BY doc_id) < 3 THEN 'O' ELSE bio_label END AS bio_label FROM t WHERE section = 'EXPERIENCE' AND bio_label NOT LIKE '%HEADING'"))
def filter_section(spark, sf_dir):
    from pyspark.sql import Window

    t = resume_tokens(spark, sf_dir).filter("section = 'EXPERIENCE' AND NOT endswith(bio_label, 'HEADING')")
    return t.withColumn("bio_label", F.when(F.count("*").over(Window.partitionBy("doc_id")) < 3, "O").otherwise(F.col("bio_label"))).select(*TK, "bio_label")


@query("SELECT doc_id, substr(text, 1, 80) AS preview, length(text) AS n FROM documents")
def preview_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 80).alias("preview"), F.char_length("text").alias("n"))
