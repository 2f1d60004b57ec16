"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.islands import ordered
from docweave.plans.registry import query
from docweave.plans.twins import on_documents, on_resumes
from docweave.sources import tables
from docweave.sources.tables import first_artifact, read, resume_tokens


@query(on_documents("SELECT doc_id, page, line_index, token_index, token, x0, y0, x1, y1 FROM d"))
def src_text_lines(spark, sf_dir):
    return tables.text_tokens(read(spark, sf_dir, "documents"))


@query(on_resumes("SELECT doc_id, page, line_index, token_index, token, x0, y0, x1, y1, font_size, is_bold, section, kind, bio_label FROM t"))
def src_truth(spark, sf_dir):
    return resume_tokens(spark, sf_dir)


@query(r"""
WITH c AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?s)<((?:h1|h2|p|li)>.*?)</(?:h1|h2|p|li)>', 1) AS f FROM pages),
b AS (SELECT page_id, CAST(unnest(range(len(f))) AS INT) AS block_index, unnest(f) AS raw FROM c)
SELECT page_id, block_index, regexp_extract(raw, '^(h1|h2|p|li)>', 1) AS tag,
  CAST(CASE regexp_extract(raw, '^(h1|h2|p|li)>', 1) WHEN 'h1' THEN 20 WHEN 'h2' THEN 16 ELSE 10 END AS DOUBLE) AS font_size,
  raw LIKE 'h%' OR raw LIKE '%<b>%' AS is_bold,
  trim(regexp_replace(regexp_replace(regexp_replace(raw, '^[a-z0-9]+>', ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM b
""")
def src_html_blocks(spark, sf_dir):
    return tables.html_blocks(read(spark, sf_dir, "pages"))


@query(r"""
WITH f AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS u, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS a FROM pages)
SELECT page_id, CAST(unnest(range(len(u))) AS INT) AS link_index, unnest(u) AS uri, unnest(a) AS anchor FROM f
""")
def src_html_links(spark, sf_dir):
    return tables.html_links(read(spark, sf_dir, "pages"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)")
def src_exclude(spark, sf_dir):
    """Documents that are not on the exclusion list."""
    excluded = read(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    return read(spark, sf_dir, "documents").join(excluded, "doc_id", "left_anti").select("doc_id", "source", "n_chars")


@query(on_resumes("""
, c AS (SELECT *, max(CASE WHEN regexp_matches(token, '[A-Za-z0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_index) AS alnum FROM t),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM c WHERE alnum = 1 AND token <> 'cid')
SELECT doc_id, page, line_index, token_index, token, CASE WHEN bio_label LIKE '%HEADING' THEN 'O' ELSE bio_label END AS bio_label, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM k WHERE n >= 3"""))
def src_clean_labelled(spark, sf_dir):
    """Labelled tokens of all documents: lines with text only, headings unlabelled, documents of three tokens or more; ``split`` tells every fifth document as validation."""
    return clean_labelled(resume_tokens(spark, sf_dir)).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train"))


def clean_labelled(tokens):
    line, doc = ordered(("doc_id", "page", "line_index"), ()), ordered(("doc_id",), ())
    worded = tokens.withColumn("alnum", F.max(F.col("token").rlike("[A-Za-z0-9]")).over(line)).filter("alnum AND token <> 'cid'")
    kept = worded.withColumn("n", F.count("*").over(doc)).filter("n >= 3")
    label = F.when(F.col("bio_label").endswith("HEADING"), "O").otherwise(F.col("bio_label"))
    return kept.select("doc_id", "page", "line_index", "token_index", "token", label.alias("bio_label"))


@query("""
WITH a AS (SELECT doc_id, 0 AS prio, 'labels' AS artifact, quality AS value FROM labels
  UNION ALL SELECT doc_id, 1, 'long_documents', 1 FROM documents WHERE n_chars >= 200
  UNION ALL SELECT doc_id, 2, 'documents', 0 FROM documents)
SELECT doc_id, artifact, value FROM a QUALIFY rank() OVER (PARTITION BY doc_id ORDER BY prio) = 1""")
def src_artifact_fallback(spark, sf_dir):
    """The newest artifact of each document: its label, else a value of its text; one of the names was never written."""
    docs = read(spark, sf_dir, "documents")
    artifacts = {
        "documents": docs.select("doc_id", F.lit(0).alias("value")),
        "long_documents": docs.filter("n_chars >= 200").select("doc_id", F.lit(1).alias("value")),
        "labels": read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value")),
    }
    return first_artifact(artifacts, ["scores", "labels", "long_documents", "documents"], "doc_id").select("doc_id", "artifact", "value")


RUNS_SQL = """
SELECT user_id AS run_id, min(ts) AS created_at, max(ts) AS updated_at, CAST(count(*) AS BIGINT) AS events,
  CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed' WHEN arg_max(event_type, (ts, event_id)) = 'purchase' THEN 'completed' ELSE 'running' END AS status
FROM events GROUP BY user_id"""


def run_catalog(events):
    """One manifest row per run from its events; the last event decides the status."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    status = F.when(F.col("last") == "error", "failed").when(F.col("last") == "purchase", "completed").otherwise("running")
    runs = events.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("events"), last.alias("last"))
    return runs.withColumn("status", status).drop("last")


@query(RUNS_SQL)
def src_run_catalog(spark, sf_dir):
    return run_catalog(read(spark, sf_dir, "events")).orderBy(F.desc("created_at"))


@query(r"""
WITH s AS (SELECT s_suppkey, s_nationkey, trim(regexp_replace(lower(concat(s_name, ' of ', n_name)), '[^a-z0-9]+', '-', 'g'), '-') AS full_slug FROM supplier JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT s_suppkey, regexp_replace(full_slug, '[0-9]+-of', 'of') AS base FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY s_suppkey) AS k FROM b)
SELECT s_suppkey, CASE WHEN k = 1 THEN base ELSE concat(base, '-', substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 6)) END AS slug FROM r""")
def slug_key(spark, sf_dir):
    """URL-safe run names; only names that collide get a suffix, which depends on the key alone."""
    named = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.expr("n_nationkey = s_nationkey"))
    full = F.btrim(F.regexp_replace(F.lower(F.concat("s_name", F.lit(" of "), "n_name")), "[^a-z0-9]+", "-"), F.lit("-"))
    based = named.select("s_suppkey", F.regexp_replace(full, "[0-9]+-of", "of").alias("base"))
    k = F.row_number().over(ordered(("base",), ("s_suppkey",)))
    suffix = F.concat("base", F.lit("-"), F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 6))
    return based.withColumn("k", k).select("s_suppkey", F.when(F.col("k") == 1, F.col("base")).otherwise(suffix).alias("slug"))
