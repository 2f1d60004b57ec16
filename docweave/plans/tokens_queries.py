"""Queries over the re-tokenising operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import table_functions as tf
from docweave.operators import tokenise as tk
from docweave.plans.registry import query
from docweave.plans.twins import on_documents, on_resumes
from docweave.sources.tables import read, resume_tokens, text_lines, text_tokens

KEY = ("doc_id", "page", "line_index", "token_index")

#: Parts p of the tokens in ``src``, with boxes shared out.
BOXES = """
, e AS (SELECT *, unnest(range(len(parts))) AS part, unnest(parts) AS piece FROM src),
x AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, page, line_index, token_index) AS tot,
  coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, page, line_index, token_index ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
p AS (SELECT doc_id, page, line_index, token_index, CAST(part AS INT) AS part, piece AS token, round(x0 + before * ((x1 - x0) / tot), 2) AS x0,
  round(x0 + (before + length(piece)) * ((x1 - x0) / tot), 2) AS x1, bio_label FROM x)
"""


def twin(parts: str, tail: str = "SELECT * EXCLUDE (bio_label) FROM p", base: str = "t") -> str:
    over = on_resumes if base == "t" else on_documents
    label = "" if base == "t" else ", 'O' AS bio_label"
    return over(f", src AS (SELECT *{label}, {parts} AS parts FROM {base}){BOXES.rstrip()} {tail}")


def shown(rows, *more):
    return rows.select(*KEY, "part", "token", "x0", "x1", *more)


PIPES = "list_filter(list_transform(string_split(token, '|'), lambda x: trim(x)), lambda x: x <> '')"


LONG = f"CASE WHEN length(w) >= 25 AND contains(w, '|') AND len({PIPES.replace('token', 'w')}) > 0 THEN {PIPES.replace('token', 'w')} WHEN length(w) >= 20 AND regexp_matches(w, '[a-z][A-Z]') THEN regexp_extract_all(w, '([A-Z]?[^A-Z]+|[A-Z])') ELSE [w] END"
STEPS = [
    LONG,
    f"CASE WHEN contains(w, '|') AND len({PIPES.replace('token', 'w')}) > 0 THEN {PIPES.replace('token', 'w')} ELSE [w] END",
    "CASE WHEN contains(w, ',') AND w <> ',' THEN regexp_extract_all(w, '([^,]+|,)') ELSE [w] END",
    "CASE WHEN contains(w, ':') AND w <> ':' AND NOT contains(w, '://') THEN regexp_extract_all(w, '([^:]+|:)') ELSE [w] END",
    r"CASE WHEN regexp_matches(w, '[()\[\]{}]') AND NOT regexp_matches(w, 'https?://|www\.|@') AND NOT regexp_matches(w, '^[()\[\]{}]+$') THEN regexp_extract_all(w, '([^()\[\]{}]+|[()\[\]{}])') ELSE [w] END",
    f"CASE WHEN regexp_matches(w, '{tk.DATE_RANGE}') THEN [regexp_extract(w, '{tk.DATE_RANGE}', 1), regexp_extract(w, '{tk.DATE_RANGE}', 2), regexp_extract(w, '{tk.DATE_RANGE}', 3)] ELSE [w] END",
]
SPLIT = "[token]"
for _step in STEPS:
    SPLIT = f"flatten(list_transform({SPLIT}, lambda w: {_step}))"


@query(f"""WITH a AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT doc_id, line_no, unnest(range(len(string_split(line, ' ')))) AS token_index, unnest(string_split(line, ' ')) AS token FROM a),
c AS (SELECT doc_id, line_no, token_index, {SPLIT} AS parts FROM b)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(token_index AS INT) AS token_index, CAST(unnest(range(len(parts))) AS INT) AS part, unnest(parts) AS token FROM c""")
def retokenise(spark, sf_dir):
    """The registered table function over every line of the documents."""
    tf.register(spark)
    lines = text_lines(read(spark, sf_dir, "documents"))
    return spark.sql("SELECT doc_id, line_no, r.* FROM {lines}, LATERAL retokenise(line) AS r", lines=lines)


@query(twin(f"CASE WHEN length(token) >= 25 AND contains(token, '|') AND len({PIPES}) > 0 THEN {PIPES} WHEN length(token) >= 20 AND regexp_matches(token, '[a-z][A-Z]') THEN regexp_extract_all(token, '([A-Z]?[^A-Z]+|[A-Z])') ELSE [token] END", base="d"))
def expand_long(spark, sf_dir):
    return shown(tk.split_into(text_tokens(read(spark, sf_dir, "documents")), tk.long_token_parts(F.col("token"))))


@query(twin(f"CASE WHEN contains(token, '|') AND len({PIPES}) > 0 THEN {PIPES} ELSE [token] END"))
def split_pipe(spark, sf_dir):
    return shown(tk.split_into(resume_tokens(spark, sf_dir), tk.pipe_parts(F.col("token"))))


COMMAS = "CASE WHEN contains(token, ',') AND token <> ',' THEN regexp_extract_all(token, '([^,]+|,)') ELSE [token] END"


@query(twin(COMMAS, """, y AS (SELECT *, sum(CASE WHEN token <> ',' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_index, token_index ORDER BY part) AS words FROM p)
SELECT doc_id, page, line_index, token_index, part, token, x0, x1, CASE WHEN token = ',' THEN 'O' WHEN words > 1 AND bio_label <> 'O' THEN 'I-' || regexp_replace(bio_label, '^[BI]-', '') ELSE bio_label END AS bio_label FROM y"""))
def split_comma(spark, sf_dir):
    return shown(tk.split_comma(resume_tokens(spark, sf_dir)), "bio_label")


COLONS = "CASE WHEN contains(token, ':') AND token <> ':' AND NOT contains(token, '://') THEN regexp_extract_all(token, '([^:]+|:)') ELSE [token] END"


@query(twin(COLONS, "SELECT * REPLACE (CASE WHEN part = max(part) OVER (PARTITION BY doc_id, page, line_index, token_index) THEN bio_label ELSE 'O' END AS bio_label) FROM p"))
def split_colon(spark, sf_dir):
    return shown(tk.split_colon(resume_tokens(spark, sf_dir)), "bio_label")


@query(twin(r"CASE WHEN regexp_matches(token, '[()\[\]{}]') AND NOT regexp_matches(token, 'https?://|www\.|@') AND NOT regexp_matches(token, '^[()\[\]{}]+$') THEN regexp_extract_all(token, '([^()\[\]{}]+|[()\[\]{}])') ELSE [token] END"))
def split_bracket(spark, sf_dir):
    return shown(tk.split_into(resume_tokens(spark, sf_dir), tk.bracket_parts(F.col("token"))))


RX = tk.DATE_RANGE.replace("'", "''")


@query(twin(f"CASE WHEN regexp_matches(token, '{RX}') THEN [regexp_extract(token, '{RX}', 1), regexp_extract(token, '{RX}', 2), regexp_extract(token, '{RX}', 3)] ELSE [token] END",
            "SELECT * REPLACE (CASE WHEN max(part) OVER (PARTITION BY doc_id, page, line_index, token_index) > 0 THEN ['B-SDATE', 'O', 'B-EDATE'][part + 1] ELSE bio_label END AS bio_label) FROM p"))
def split_date_range(spark, sf_dir):
    return shown(tk.split_date_range(resume_tokens(spark, sf_dir)), "bio_label")


@query(twin(COMMAS, "SELECT doc_id, page, line_index, round(sum(x1 - x0), 1) AS width, count(*) AS parts FROM p GROUP BY ALL"))
def alloc_bbox(spark, sf_dir):
    """Widths of the parts add up to those of the tokens."""
    parts = tk.split_into(resume_tokens(spark, sf_dir), tk.comma_parts(F.col("token")))
    return parts.groupBy("doc_id", "page", "line_index").agg(F.round(F.sum(F.col("x1") - F.col("x0")), 1).alias("width"), F.count("*").alias("parts"))


@query(twin(COMMAS, "SELECT doc_id, page, line_index, CAST(row_number() OVER (PARTITION BY doc_id, page, line_index ORDER BY x0, token_index, part) - 1 AS INT) AS token_index, token FROM p"))
def reindex_tokens(spark, sf_dir):
    return tk.reindex(tk.split_into(resume_tokens(spark, sf_dir), tk.comma_parts(F.col("token")))).select(*KEY, "token")


@query(on_documents("SELECT doc_id, page, line_index, token_index, token FROM d QUALIFY max(CASE WHEN regexp_matches(token, '[A-Za-z0-9]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_index) = 1"))
def drop_nonalnum_lines(spark, sf_dir):
    return tk.drop_lines_without_words(text_tokens(read(spark, sf_dir, "documents"))).select(*KEY, "token")


@query(on_resumes(""", f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) = 1 AND row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index, token_index) > 1 AS sep FROM t)
SELECT doc_id, page, line_index, token_index, token, false AS is_separator FROM f UNION ALL SELECT doc_id, page, line_index, token_index, '[LINE]', true FROM f WHERE sep"""))
def insert_separators(spark, sf_dir):
    return tk.insert_separators(resume_tokens(spark, sf_dir)).select(*KEY, "token", "is_separator")


CID = """, w AS (SELECT doc_id, page, line_index, token_index, x0, CASE WHEN token_index % 7 = 3 THEN 'cid' WHEN token_index % 7 = 4 THEN ':' WHEN token_index % 7 = 5 AND doc_id % 2 = 0 THEN '42' ELSE token END AS token FROM t),
f AS (SELECT *, token = 'cid' AND coalesce(lead(token, 1) OVER v = ':' AND regexp_matches(lead(token, 2) OVER v, '^[0-9]+$'), false) AS h FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY page, line_index, token_index, x0)),
g AS (SELECT *, h OR coalesce(lag(h, 1) OVER v, false) OR coalesce(lag(h, 2) OVER v, false) AS i FROM f WINDOW v AS (PARTITION BY doc_id ORDER BY page, line_index, token_index, x0))
SELECT doc_id, page, line_index, token_index, token FROM g WHERE NOT i"""


@query(on_resumes(CID))
def strip_cid(spark, sf_dir):
    """Résumé tokens in which some glyphs were replaced by their numbers."""
    k = F.col("token_index") % 7
    marked = F.when(k == 3, "cid").when(k == 4, ":").when((k == 5) & (F.col("doc_id") % 2 == 0), "42").otherwise(F.col("token"))
    return tk.strip_cid(resume_tokens(spark, sf_dir).withColumn("token", marked)).select(*KEY, "token")


GLYPHS = """, g0 AS (SELECT doc_id, page, CAST(line_index AS INT) AS true_line, token_index, y0 AS top, x0, font_size AS size, token, is_bold, unnest(range(length(token) + 1)) AS i FROM t),
g AS (SELECT doc_id, page, CAST(true_line * 100000 + token_index * 500 + i AS BIGINT) AS seq, CASE WHEN i = length(token) THEN ' ' ELSE substr(token, CAST(i + 1 AS INT), 1) END AS text, x0 + 6.0 * i AS x0, x0 + 6.0 * i + 6 AS x1, top + (i % 2) AS top, size,
  CASE WHEN is_bold AND i % 3 <> 0 THEN 'Arial-BoldMT' ELSE 'ArialMT' END AS fontname FROM g0),
gl AS (SELECT *, sum(CASE WHEN abs(top - p) > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY top, seq) AS line_index FROM (SELECT *, lag(top) OVER (PARTITION BY doc_id, page ORDER BY top, seq) AS p FROM g))"""


def glyphs(spark, sf_dir):
    """Glyph rows of all résumés: one for each character and one for the space after a token."""
    t = resume_tokens(spark, sf_dir)
    rows = t.select("*", F.explode(F.sequence(F.lit(0), F.char_length("token"))).alias("i"))
    return rows.select(
        "doc_id", "page", (F.col("line_index").cast("long") * 100000 + F.col("token_index") * 500 + F.col("i")).alias("seq"),
        F.when(F.col("i") == F.char_length("token"), " ").otherwise(F.substring("token", F.col("i") + 1, F.lit(1))).alias("text"),
        (F.col("x0") + 6.0 * F.col("i")).alias("x0"), (F.col("x0") + 6.0 * F.col("i") + 6).alias("x1"), (F.col("y0") + F.col("i") % 2).alias("top"), F.col("font_size").alias("size"),
        F.when(F.col("is_bold") & (F.col("i") % 3 != 0), "Arial-BoldMT").otherwise("ArialMT").alias("fontname"),
    )


@query(on_resumes(GLYPHS + " SELECT doc_id, page, line_index, count(*) AS n, min(top) AS top FROM gl GROUP BY ALL"))
def chars_to_lines(spark, sf_dir):
    return tk.chars_to_lines(tk.heights(glyphs(spark, sf_dir))).groupBy("doc_id", "page", "line_index").agg(F.sum("n").alias("n"), F.min("top").alias("top"))


@query(on_resumes(GLYPHS + """, w AS (SELECT *, lag(trim(text) = '') OVER v OR x0 - lag(x1) OVER v > 0.2 * size OR x0 - lag(x1) OVER v >= 1.2 AS s FROM gl WINDOW v AS (PARTITION BY doc_id, page, line_index ORDER BY x0, seq)),
r AS (SELECT *, sum(CASE WHEN coalesce(s, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_index ORDER BY x0, seq) AS run FROM w)
SELECT doc_id, page, line_index, run, string_agg(text, '' ORDER BY x0, seq) AS token, min(x0) AS x0, max(x1) AS x1, max(size) AS font_size FROM r WHERE trim(text) <> '' GROUP BY ALL"""))
def glyphs_to_tokens(spark, sf_dir):
    return tk.glyphs_to_tokens(tk.chars_to_lines(glyphs(spark, sf_dir)))


@query(on_resumes(GLYPHS + """, c AS (SELECT doc_id, page, line_index, fontname, count(*) AS n, sum(size) AS s FROM gl GROUP BY ALL)
SELECT doc_id, page, line_index, arg_min(fontname, (-n, fontname)) AS fontname, sum(s) / sum(n) AS font_size FROM c GROUP BY ALL"""))
def dominant_font(spark, sf_dir):
    return tk.dominant_font(tk.chars_to_lines(tk.heights(glyphs(spark, sf_dir), "fontname", "size")), ["doc_id", "page", "line_index"], "n")


@query(on_resumes(GLYPHS + " SELECT doc_id, fontname, regexp_matches(lower(fontname), 'bold|black|heavy|semibold|demi') AS is_bold, count(*) AS n FROM gl GROUP BY ALL"))
def bold_flag(spark, sf_dir):
    return glyphs(spark, sf_dir).groupBy("doc_id", "fontname", tk.is_bold_font(F.col("fontname")).alias("is_bold")).agg(F.count("*").alias("n"))


@query(on_resumes(""", r AS (SELECT doc_id, page, x0 - 4 AS rx0, x1 + 60 AS rx1, y0 - 9 AS top, y1 + 4 AS bottom, 'https://example.org/' || token AS uri FROM t WHERE token LIKE 'github%' OR token LIKE '%@%' OR token = 'Portal'),
o AS (SELECT t.doc_id, t.page, line_index, token_index, uri, (least(x1, rx1) - greatest(x0, rx0)) * (least(y1, bottom) - greatest(y0, top)) AS area
  FROM t JOIN r ON t.doc_id = r.doc_id AND t.page = r.page AND least(x1, rx1) > greatest(x0, rx0) AND least(y1, bottom) > greatest(y0, top)),
b AS (SELECT doc_id, page, line_index, token_index, arg_max(uri, (area, uri)) AS embedded_url FROM o GROUP BY ALL)
SELECT t.doc_id, t.page, t.line_index, t.token_index, token, embedded_url FROM t LEFT JOIN b USING (doc_id, page, line_index, token_index)"""))
def attach_link(spark, sf_dir):
    t = resume_tokens(spark, sf_dir)
    links = t.filter("token LIKE 'github%' OR token LIKE '%@%' OR token = 'Portal'").selectExpr(
        "doc_id", "page", "x0 - 4 AS x0", "x1 + 60 AS x1", "y0 - 9 AS top", "y1 + 4 AS bottom", "'https://example.org/' || token AS uri"
    )
    return tk.attach_links(t, links).select(*KEY, "token", "embedded_url")
