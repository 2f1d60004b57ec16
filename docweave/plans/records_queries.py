"""Queries over entities and records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.operators import fields as fd
from docweave.operators import records as rc
from docweave.plans.entries_queries import ENTRIES, entries
from docweave.plans.fields_queries import CONTACT, DOC, ENT
from docweave.plans.registry import query
from docweave.plans.twins import on_documents, on_resumes
from docweave.sources.tables import read, resume_lines, resume_tokens, text_tokens, shared_folder

E_ = ENT.format("bio_label")


def entity_sql(base: str, name: str = "en", keep: str = "") -> str:
    """Entities of the labelled tokens in ``base``."""
    return f""", {name}0 AS (SELECT *, CASE WHEN bio_label <> 'O' THEN {E_} END AS own, bio_label LIKE 'B-%' OR (bio_label <> 'O' AND coalesce({ENT.format('lag(bio_label) OVER v')} <> {E_}, true)) AS st FROM {base} WINDOW v AS ({DOC})),
{name}1 AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER ({DOC}) AS entity_id FROM {name}0),
{name}2 AS (SELECT doc_id, entity_id, min(own) AS label{keep}, string_agg(token, ' ' ORDER BY page, line_index, token_index, x0) AS raw FROM {name}1 WHERE own IS NOT NULL GROUP BY doc_id, entity_id),
{name} AS (SELECT * EXCLUDE (raw), regexp_replace(CASE WHEN label IN ('LINKEDIN', 'GITHUB', 'OTHER_LINK', 'EMAIL') THEN replace(raw, ' ', '') ELSE regexp_replace(raw, ' ([,.;:!?])', '\\1', 'g') END, '(https?) ?: ?// ?', '\\1://', 'g') AS value FROM {name}2)"""


def contacts(spark, sf_dir):
    return fd.contact_labels(text_tokens(read(spark, sf_dir, "documents")))


CONTACTS = f""", c0 AS (SELECT *, CASE WHEN {CONTACT} = 'O' THEN 'O' ELSE 'B-' || {CONTACT} END AS lb FROM d),
c1 AS (SELECT * EXCLUDE (lb), CASE WHEN lb = 'O' THEN 'O' WHEN {ENT.format('lb')} = coalesce({ENT.format('lag(lb) OVER v')}, 'O') THEN 'I-' || {ENT.format('lb')} ELSE 'B-' || {ENT.format('lb')} END AS bio_label FROM c0 WINDOW v AS ({DOC}))"""
FIELDS = ["EMAIL", "PHONE", "LINKEDIN", "GITHUB", "OTHER_LINK"]


@query(on_documents(CONTACTS + entity_sql("c1") + ", r AS (SELECT doc_id, " + ", ".join(f"string_agg(value, '; ' ORDER BY entity_id) FILTER (label = '{x}') AS {x.lower()}" for x in FIELDS) + " FROM en GROUP BY doc_id) SELECT documents.doc_id, " + ", ".join(x.lower() for x in FIELDS) + " FROM documents LEFT JOIN r USING (doc_id)"))
def build_record(spark, sf_dir):
    """Contact details of every document of the corpus, end to end: text, tokens, labels, runs, values, one record."""
    found = contacts(spark, sf_dir).withColumn("bio_label", F.col("clean_label"))
    return rc.build_record(read(spark, sf_dir, "documents"), rc.extract_entities(found), FIELDS)


@query(on_resumes(entity_sql("t") + " SELECT * FROM en"))
def extract_entities(spark, sf_dir):
    return rc.extract_entities(resume_tokens(spark, sf_dir))


@query(on_resumes(entity_sql("t") + ", h AS (SELECT * FROM en WHERE label = 'HEADING' QUALIFY row_number() OVER (PARTITION BY doc_id, upper(value) ORDER BY entity_id) = 1) SELECT doc_id, list(value ORDER BY entity_id) AS headings FROM h GROUP BY ALL"))
def heading_list(spark, sf_dir):
    return rc.heading_list(rc.extract_entities(resume_tokens(spark, sf_dir)))


@query(on_resumes(" SELECT doc_id, string_agg(token, ' ' ORDER BY page, line_index, token_index) AS summary FROM t WHERE section = 'PERSONAL' AND bio_label NOT LIKE '%HEADING' GROUP BY ALL"))
def summary_text(spark, sf_dir):
    from docweave.functions.islands import ordered_text

    return resume_tokens(spark, sf_dir).filter("section = 'PERSONAL' AND NOT endswith(bio_label, 'HEADING')").groupBy("doc_id").agg(ordered_text().alias("summary"))


@query(on_resumes(""", w AS (SELECT *, CASE WHEN token = 'units,' THEN '87.5' WHEN token = 'size' THEN '%' ELSE token END AS tk FROM t), g AS (SELECT *, lag(tk) OVER (PARTITION BY doc_id, page, line_index ORDER BY x0) AS b FROM w)
SELECT doc_id, page, line_index, token_index, b || '%' AS gpa FROM g WHERE tk = '%' AND regexp_matches(b, '^[0-9]+([.][0-9]+)?$')"""))
def marks_column(spark, sf_dir):
    marked = resume_tokens(spark, sf_dir).withColumn("token", F.when(F.col("token") == "units,", "87.5").when(F.col("token") == "size", "%").otherwise(F.col("token")))
    return rc.marks_column(marked).select("doc_id", "page", "line_index", "token_index", "gpa")


JOBS = ENTRIES + entity_sql("ge", "en", ", min(entry_id) AS entry") + """, fl AS (SELECT doc_id, entry, CAST(row_number() OVER (PARTITION BY doc_id, entry ORDER BY entity_id) - 1 AS INT) AS pos, label, value FROM en)"""


def jobs(spark, sf_dir):
    # the entry of an entity is that of its tokens
    return rc.entries_flat(rc.extract_entities(entries(spark, sf_dir), "bio_label", "entry_id").withColumnRenamed("entry_id", "entry"))


@query(on_resumes(JOBS + " SELECT * FROM fl"))
def entries_array(spark, sf_dir):
    """The flat form of the nested entries; ``records.entries_array`` nests it for the sink."""
    return jobs(spark, sf_dir)


@query(on_resumes(JOBS + ", n AS (SELECT doc_id, entry, list({'label': label, 'value': value} ORDER BY pos) AS f FROM fl GROUP BY ALL) SELECT doc_id, CAST(count(*) AS INT) AS n_entries, CAST(sum(len(f)) AS INT) AS n_fields, min_by(f[1].value, entry) AS first_value FROM n GROUP BY ALL"))
def sink_structured(spark, sf_dir):
    """Nested entries written as JSON files and read with a declared schema keep their shape."""
    folder = f"{shared_folder(spark)}/structured-{uuid.uuid4().hex}"
    rc.entries_array(jobs(spark, sf_dir)).select("doc_id", "entries").write.json(folder)
    back = spark.read.schema("doc_id long, entries array<array<struct<label:string,value:string>>>").json(folder)
    e = F.col("entries")
    return back.select("doc_id", F.size(e).alias("n_entries"), F.aggregate(e, F.lit(0), lambda a, x: a + F.size(x)).alias("n_fields"), e[0][0]["value"].alias("first_value"))


@query(on_resumes(entity_sql("t") + ", s AS (SELECT doc_id, value, min(entity_id) AS f FROM en WHERE label = 'SKILL' GROUP BY ALL) SELECT doc_id, list(value ORDER BY f) AS skills FROM s GROUP BY ALL"))
def skills_distinct(spark, sf_dir):
    return rc.skills_distinct(rc.extract_entities(resume_tokens(spark, sf_dir)))


@query(on_resumes(f""", o AS (SELECT *, {E_} AS own, CAST(1.0 / (1 + token_index) AS DOUBLE) AS confidence FROM t), r AS (SELECT *, sum(CASE WHEN coalesce(own <> p, true) THEN 1 ELSE 0 END) OVER ({DOC}) AS field FROM (SELECT *, lag(own) OVER ({DOC}) AS p FROM o))
SELECT doc_id, field, min(own) AS label, string_agg(token, ' ' ORDER BY page, line_index, token_index, x0) AS value, arg_min(confidence, (page, line_index, token_index)) AS confidence FROM r WHERE own <> 'O' GROUP BY ALL"""))
def predicted_fields(spark, sf_dir):
    return rc.predicted_fields(resume_tokens(spark, sf_dir).withColumn("confidence", F.lit(1.0) / (1 + F.col("token_index"))))


@query(on_resumes(entity_sql("t") + """, g AS (SELECT *, last_value(CASE WHEN label = 'SKILL_TYPE' THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY entity_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS type FROM en WHERE label IN ('SKILL', 'SKILL_TYPE'))
SELECT doc_id, type, value, min(entity_id) AS first_at FROM g WHERE label = 'SKILL' GROUP BY ALL"""))
def skill_groups(spark, sf_dir):
    return rc.skill_groups(rc.extract_entities(resume_tokens(spark, sf_dir)))


@query(on_resumes(JOBS + """ SELECT doc_id, entry, string_agg(value, ' ' ORDER BY pos) FILTER (label = 'ROLE') AS role, regexp_replace(string_agg(value, ' ' ORDER BY pos) FILTER (label = 'DATE'), ' ?[-–] ?', ' - ', 'g') AS dates, string_agg(value, ' ' ORDER BY pos) FILTER (label = 'DESC') AS description FROM fl GROUP BY doc_id, entry"""))
def fold_fields(spark, sf_dir):
    return rc.fold_fields(jobs(spark, sf_dir))


@query(on_resumes(entity_sql("t") + " SELECT doc_id, entity_id, sum(CASE WHEN label IN ('ROLE', 'DEGREE', 'PROJECT_NAME') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY entity_id) AS entry FROM en"))
def fallback_regroup(spark, sf_dir):
    return rc.fallback_regroup(rc.extract_entities(resume_tokens(spark, sf_dir))).select("doc_id", "entity_id", "entry")


@query(on_resumes(entity_sql("t") + " SELECT doc_id, entity_id, CASE WHEN count(*) OVER (PARTITION BY doc_id, label) > 1 THEN lower(label) || ' ' || row_number() OVER (PARTITION BY doc_id, label ORDER BY entity_id) ELSE lower(label) END AS key, value FROM en"))
def profile_numbering(spark, sf_dir):
    return rc.profile_numbering(rc.extract_entities(resume_tokens(spark, sf_dir))).select("doc_id", "entity_id", "key", "value")


@query(on_resumes(r" SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(txt, '^[•◦●▪*–\-\s]+', '', 'g'), '[|,;\s]+$', '', 'g'), '\s+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '(https?) ?: ?// ?', '\1://', 'g') AS clean FROM rl"))
def clean_text(spark, sf_dir):
    return resume_lines(spark, sf_dir).select("doc_id", "line_no", rc.clean_text(F.col("txt")).alias("clean"))


@query(on_documents(CONTACTS + entity_sql("c1") + " SELECT doc_id, entity_id, CASE WHEN label IN ('GITHUB', 'LINKEDIN') THEN 'https://' || regexp_replace(value, '^(https?://)?(www[.])?', '') WHEN label = 'EMAIL' THEN lower(regexp_replace(value, '[.,;]+$', '')) ELSE value END AS value FROM en"))
def clean_contact(spark, sf_dir):
    found = rc.extract_entities(contacts(spark, sf_dir).withColumn("bio_label", F.col("clean_label")))
    return found.select("doc_id", "entity_id", rc.clean_contact(F.col("label"), F.col("value")).alias("value"))
