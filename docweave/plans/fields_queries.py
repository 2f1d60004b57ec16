"""Queries over phrase segments, scores and labels."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from docweave.operators import fields as fd
from docweave.operators.layout import line_vector
from docweave.operators.scoring import linear_text, score_with
from docweave.plans.entries_queries import ENTRIES, LK, entries, known_lines
from docweave.plans.layout_queries import LINE_VECTORS
from docweave.plans.lines_queries import SHIFTED, lines, shifted
from docweave.plans.registry import query
from docweave.plans.twins import on_documents, on_resumes
from docweave.sources.tables import read, resume_tokens, text_tokens

TK = ("doc_id", "page", "line_index", "token_index")
LINE = "PARTITION BY doc_id, page, line_index ORDER BY token_index"
DOC = "PARTITION BY doc_id ORDER BY page, line_index, token_index, x0"
ENT = "regexp_replace({}, '^[BI]-', '')"
SEPS = ", ".join(f"'{s}'" for s in fd.SEPARATORS)


@query(on_resumes(SHIFTED + f""", g AS (SELECT *, x0 - lag(x1) OVER v AS gap, regexp_matches(token, '[A-Za-z0-9]') AS wd, lag(regexp_matches(token, '[A-Za-z0-9]')) OVER v AS pw FROM m WINDOW v AS ({LINE})),
md AS (SELECT doc_id, page, line_index, quantile_disc(-gap, 0.5) * -1 AS mg FROM g WHERE gap > 0 GROUP BY ALL)
SELECT doc_id, page, line_index, token_index, CASE WHEN coalesce(wd AND pw AND gap >= greatest(40.0, 3 * coalesce(mg, 0.0)), false) THEN 'B-SEG' ELSE 'I-SEG' END AS seg FROM g LEFT JOIN md USING (doc_id, page, line_index)"""))
def seg_gap(spark, sf_dir):
    return fd.seg_gap(shifted(spark, sf_dir)).select(*TK, "seg")


STYLE = SHIFTED + f""", ss AS (SELECT *, CASE WHEN coalesce(is_bold <> lag(is_bold) OVER v OR abs(font_size - lag(font_size) OVER v) > 0.5 OR x0 - lag(x1) OVER v > 35, true) THEN 'B-SEG' ELSE 'I-SEG' END AS seg FROM m WINDOW v AS ({LINE}))"""


@query(on_resumes(STYLE + " SELECT doc_id, page, line_index, token_index, seg FROM ss"))
def seg_style(spark, sf_dir):
    return fd.seg_style(shifted(spark, sf_dir)).select(*TK, "seg")


@query(on_resumes(STYLE + f""" SELECT doc_id, page, line_index, token_index, CASE WHEN coalesce(seg = 'B-SEG' AND regexp_matches(token, '[A-Za-z0-9]') AND lag(regexp_matches(token, '[A-Za-z0-9]')) OVER v AND lag(seg) OVER v <> 'O', false) THEN 'I-SEG' ELSE seg END AS seg FROM ss WINDOW v AS ({LINE})"""))
def seg_continuity(spark, sf_dir):
    return fd.seg_continuity(fd.seg_style(shifted(spark, sf_dir))).select(*TK, "seg")


@query(on_resumes(ENTRIES + """, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entry_id ORDER BY page, line_index, token_index, x0) AS pos, CASE WHEN token_index % 3 = 0 THEN 'B-SEG' ELSE 'I-SEG' END AS seg FROM ge)
SELECT doc_id, page, line_index, token_index, CASE WHEN coalesce(pos BETWEEN min(CASE WHEN bio_label LIKE '%-DESC' THEN pos END) OVER e + 1 AND max(CASE WHEN bio_label LIKE '%-DESC' THEN pos END) OVER e, false) THEN 'I-SEG' ELSE seg END AS seg FROM p WINDOW e AS (PARTITION BY doc_id, entry_id)"""))
def desc_lock(spark, sf_dir):
    cut = entries(spark, sf_dir).withColumn("seg", F.when(F.col("token_index") % 3 == 0, "B-SEG").otherwise("I-SEG"))
    return fd.desc_lock(cut).select(*TK, "seg")


@query(on_resumes(STYLE + f""" SELECT doc_id, page, line_index, token_index, CASE WHEN token IN ({SEPS}) THEN 'O' WHEN coalesce(lag(token IN ({SEPS})) OVER v, true) OR seg = 'B-SEG' THEN 'B-SEG' ELSE 'I-SEG' END AS seg FROM ss WINDOW v AS ({LINE})"""))
def seg_repair(spark, sf_dir):
    return fd.seg_repair(fd.seg_style(shifted(spark, sf_dir))).select(*TK, "seg")


BLOCKS = f""", bs AS (SELECT *, (token = '(' AND coalesce(lead(bio_label) OVER v, 'O') LIKE '%-DATE') OR token IN ('|', '•') OR lag(token) OVER v IN ('|', '•') OR page <> lag(page) OVER v OR line_index <> lag(line_index) OVER v OR x0 - lag(x1) OVER v > 40 AS st FROM t WINDOW v AS ({DOC})),
bn AS (SELECT *, sum(CASE WHEN coalesce(st, true) THEN 1 ELSE 0 END) OVER ({DOC}) AS run FROM bs),
bw AS (SELECT *, last_value(CASE WHEN bio_label LIKE 'B-%' THEN substr(bio_label, 3) END IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY page, line_index, token_index, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM bn),
bl AS (SELECT * EXCLUDE (run, lb), sum(CASE WHEN coalesce(st, true) OR coalesce(bio_label LIKE 'B-%' AND substr(bio_label, 3) <> lb, false) THEN 1 ELSE 0 END) OVER ({DOC}) AS block FROM bw),
br AS (SELECT doc_id, block, string_agg(token, ' ' ORDER BY page, line_index, token_index, x0) AS text, coalesce(arg_min(regexp_replace(bio_label, '^[BI]-', ''), (page, line_index, token_index)) FILTER (bio_label LIKE 'B-%'), 'O') AS label FROM bl GROUP BY ALL)"""


def blocks(spark, sf_dir):
    return fd.split_blocks(resume_tokens(spark, sf_dir))


@query(on_resumes(BLOCKS + " SELECT * FROM br"))
def split_blocks(spark, sf_dir):
    return fd.block_rows(blocks(spark, sf_dir)).drop("at")


DATED = fd.DATED_RX.replace("'", "''")
PIECE = f"NOT regexp_matches(lt, '^[•◦▪∗*■●]') AND lt <> '' AND (NOT regexp_matches(lt, '[\\p{{L}}\\p{{N}}]') OR (regexp_matches(lt, '{DATED}') AND len(list_intersect(string_split_regex(lt, ' +'), {fd.NOT_A_DATE})) = 0))"


@query(on_resumes(BLOCKS + f""", d AS (SELECT *, {PIECE} AS is_date FROM (SELECT *, lower(trim(text)) AS lt FROM br)),
r AS (SELECT *, sum(CASE WHEN coalesce(NOT (is_date AND pd), true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block) AS merged FROM (SELECT *, lag(is_date) OVER (PARTITION BY doc_id ORDER BY block) AS pd FROM d))
SELECT doc_id, merged, string_agg(text, ' ' ORDER BY block) AS text, min(is_date) AS is_date FROM r GROUP BY ALL"""))
def merge_date_blocks(spark, sf_dir):
    return fd.merge_date_blocks(fd.block_rows(blocks(spark, sf_dir)).drop("at"))


WEIGHTS = [[0.5, -1.0, 0.25, 0.1, 2.0, 1.5, 1.0, -2.0, 0.5, 0.1], [0.1, 0.4, -0.5, 0.2, 0.3, -1.0, 0.2, 2.0, 0.1, 0.7], [-0.3, 0.2, 0.1, 0.9, -0.8, 0.3, 0.4, 0.5, 1.0, -0.6]]
LABELS = ["HEADING", "BODY", "OTHER"]
DOTS = ", ".join(f"list_inner_product(v, {w}::DOUBLE[])" for w in WEIGHTS)


@query(on_resumes(LINE_VECTORS + f""", sc AS (SELECT *, [{DOTS}] AS s FROM lv), ex AS (SELECT *, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM sc), pb AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex)
SELECT doc_id, page, line_index, {LABELS}[list_position(p, list_max(p))] AS label, round(list_max(p), 4) AS confidence FROM pb"""))
def score_segments(spark, sf_dir):
    """The built-in linear scorer over line vectors."""
    return fd.score_segments(line_vector(lines(spark, sf_dir)), F.col("v"), WEIGHTS, LABELS).select("doc_id", "page", "line_index", "label", "confidence")


TEXT_DOTS = DOTS.replace("::DOUBLE[])", "::DOUBLE[]) + 0.1 * (length(text) - length(replace(text, ':', '')))", 1)


@query(on_resumes(LINE_VECTORS + f""", sc AS (SELECT *, [{TEXT_DOTS}] AS s FROM lv JOIN l USING (doc_id, page, line_index)), ex AS (SELECT *, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM sc), pb AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex)
SELECT doc_id, page, line_index, {LABELS}[list_position(p, list_max(p))] AS label, round(list_max(p), 4) AS confidence FROM pb"""))
def score_protocol(spark, sf_dir):
    """A user's scorer over the text and the vector of every line."""
    rows = lines(spark, sf_dir)
    both = line_vector(rows).join(rows.select("doc_id", "page", "line_index", "text"), ["doc_id", "page", "line_index"])
    return score_with(both, "linear_text", partial(linear_text, WEIGHTS, 0.1), LABELS, ["doc_id", "page", "line_index"])


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
e AS (SELECT vec_id, list_transform(s, lambda x: exp(x - list_max(s))) AS e FROM v), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT vec_id, list_position(p, list_max(p)) AS best, round(list_max(p), 4) AS confidence FROM p""")
def softmax_conf(spark, sf_dir):
    """Softmax of the components of every vector, and the confidence of the largest."""
    v = read(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL AND size(embedding) > 0").select("vec_id", fd.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return v.select("vec_id", F.array_position("p", F.array_max("p")).cast("int").alias("best"), F.round(F.array_max("p"), 4).alias("confidence"))


WINDOWED = """, tp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index, token_index, x0) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM t),
wi AS (SELECT DISTINCT doc_id, n, unnest(range(0, greatest(1, CASE WHEN n <= 250 THEN 1 ELSE n - 100 END), 150)) AS start FROM tp),
wt AS (SELECT tp.*, start, least(start + 250, tp.n) AS fin FROM tp JOIN wi ON wi.doc_id = tp.doc_id AND pos >= start AND pos < least(start + 250, tp.n)),
ws AS (SELECT *, CASE WHEN (pos + start) % 3 = 0 THEN 'O' ELSE bio_label END AS lab, abs(pos - (start + fin) / 2) AS away FROM wt)"""


@query(on_resumes(WINDOWED + """, wl AS (SELECT doc_id, page, line_index, token_index, list(lab ORDER BY start) AS l, list(away ORDER BY start) AS a FROM ws GROUP BY ALL)
SELECT doc_id, page, line_index, token_index, CASE WHEN len(l) = 1 OR (l[2] = 'O' AND a[2] >= a[1] - CASE WHEN l[1] = 'O' THEN 0 ELSE 100 END) THEN l[1] ELSE l[2] END AS label FROM wl"""))
def overlap_windows(spark, sf_dir):
    """Labels scored window by window, here with every third one of a window lost, and merged token by token."""
    windowed = fd.overlap_windows(resume_tokens(spark, sf_dir))
    scored = windowed.withColumn("label", F.when((F.col("pos") + F.col("start")) % 3 == 0, "O").otherwise(F.col("bio_label")))
    return fd.merge_windows(scored).select(*TK, "label")


@query(on_documents("""
 , a AS (SELECT doc_id, list(length(token) ORDER BY page, line_index, token_index) AS v FROM d GROUP BY ALL)
SELECT doc_id, CASE WHEN len(v) > 256 THEN list_concat(v[1:128], v[len(v)-127:]) ELSE list_concat(v, list_transform(range(256 - len(v)), lambda x: 0)) END AS v FROM a"""))
def head_tail_truncate(spark, sf_dir):
    t = text_tokens(read(spark, sf_dir, "documents"))
    rows = F.array_sort(F.collect_list(F.struct("page", "line_index", "token_index", F.char_length("token").alias("n"))))
    return t.groupBy("doc_id").agg(fd.head_tail(F.transform(rows, lambda r: r["n"]), 128, F.lit(0)).alias("v"))


@query(on_resumes(" SELECT doc_id, page, line_index, token_index FROM t QUALIFY dense_rank() OVER (PARTITION BY doc_id ORDER BY page, line_index) <= 12"))
def top_n_segments(spark, sf_dir):
    return fd.top_segments(resume_tokens(spark, sf_dir), 12).select(*TK)


@query(on_resumes(BLOCKS + f""", k AS (SELECT doc_id, block, label, coalesce(lag(label) OVER (PARTITION BY doc_id ORDER BY block) = label AND NOT starts_with(text, '•'), false) AS same FROM br)
SELECT doc_id, page, line_index, token_index, CASE WHEN label = 'O' THEN 'O' WHEN row_number() OVER (PARTITION BY doc_id, block ORDER BY page, line_index, token_index, x0) = 1 AND NOT same THEN 'B-' || label ELSE 'I-' || label END AS stamped FROM bl JOIN k USING (doc_id, block)"""))
def stamp_bio(spark, sf_dir):
    return fd.stamp_bio(blocks(spark, sf_dir)).select(*TK, "stamped")


NOISY = """, z AS (SELECT * REPLACE (CASE WHEN token_index % 4 = 1 AND bio_label LIKE 'I-%' THEN 'B-' || regexp_replace(bio_label, '^[BI]-', '') WHEN token_index % 5 = 2 AND bio_label <> 'O' THEN 'I-' || regexp_replace(bio_label, '^[BI]-', '') ELSE bio_label END AS bio_label) FROM t)"""


def noisy(spark, sf_dir):
    t, own = resume_tokens(spark, sf_dir), fd.entity(F.col("bio_label"))
    label = (
        F.when((F.col("token_index") % 4 == 1) & F.col("bio_label").startswith("I-"), F.concat(F.lit("B-"), own)).when((F.col("token_index") % 5 == 2) & (F.col("bio_label") != "O"), F.concat(F.lit("I-"), own)).otherwise(F.col("bio_label"))
    )
    return t.withColumn("bio_label", label)


@query(on_resumes(NOISY + f" SELECT doc_id, page, line_index, token_index, CASE WHEN bio_label = 'O' THEN 'O' WHEN {ENT.format('bio_label')} = coalesce({ENT.format('lag(bio_label) OVER v')}, 'O') THEN 'I-' || {ENT.format('bio_label')} ELSE 'B-' || {ENT.format('bio_label')} END AS clean_label FROM z WINDOW v AS ({DOC})"))
def bio_sanitise(spark, sf_dir):
    return fd.bio_sanitise(noisy(spark, sf_dir)).select(*TK, "clean_label")


CONTACT = "CASE " + " ".join(f"WHEN regexp_matches({'lower(token)' if n != 'PHONE' else 'token'}, '{rx}') THEN '{n}'" for n, rx in fd.CONTACT) + " ELSE 'O' END"


@query(on_documents(f" SELECT doc_id, page, line_index, token_index, token, {CONTACT} AS kind FROM d WHERE {CONTACT} <> 'O'"))
def contact_classify(spark, sf_dir):
    """Contact details in the corpus itself."""
    return text_tokens(read(spark, sf_dir, "documents")).withColumn("kind", fd.contact_classify(F.col("token"))).filter("kind <> 'O'").select(*TK, "token", "kind")


@query(on_resumes(f""", k AS (SELECT doc_id, page, line_index, token_index, CASE WHEN token_index = 2 AND section = 'PERSONAL' THEN 'https' WHEN token_index = 3 AND section = 'PERSONAL' THEN ':' ELSE token END AS tk, {CONTACT} AS kind FROM t WHERE section = 'PERSONAL')
, n AS (SELECT *, first_value(CASE WHEN tk NOT IN ('https', 'http', ':', '//') THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM k)
SELECT doc_id, page, line_index, token_index, CASE WHEN tk IN ('https', 'http', ':', '//') AND coalesce(nx, 'O') IN ('LINKEDIN', 'GITHUB', 'OTHER_LINK') THEN nx ELSE kind END AS kind FROM n"""))
def contact_refine(spark, sf_dir):
    t = resume_tokens(spark, sf_dir).filter("section = 'PERSONAL'").withColumn("kind", fd.contact_classify(F.col("token")))
    cut = F.when(F.col("token_index") == 2, "https").when(F.col("token_index") == 3, ":").otherwise(F.col("token"))
    return fd.contact_refine(t.withColumn("token", cut)).select(*TK, "kind")


@query(on_resumes(f""", gh AS (SELECT * REPLACE (CASE WHEN token LIKE 'Git|%' THEN 'Git' WHEN token = 'SQL' AND doc_id % 2 = 0 THEN 'hub' ELSE token END AS token) FROM t WHERE section = 'SKILLS'),
pv AS (SELECT *, coalesce(max(CASE WHEN bio_label LIKE '%-SKILL' THEN 1 ELSE 0 END) OVER v, 0) = 1 AS later, last_value(CASE WHEN regexp_matches(token, '[A-Za-z0-9]') THEN lower(trim(token)) END IGNORE NULLS) OVER v AS prev FROM gh WINDOW v AS ({LINE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, page, line_index, token_index, CASE WHEN bio_label = 'O' AND regexp_matches(token, '[A-Za-z0-9]') AND later THEN CASE WHEN lower(token) = 'hub' AND coalesce(prev = 'git', false) THEN 'I-SKILL' ELSE 'B-SKILL' END ELSE bio_label END AS bio_label FROM pv"""))
def skills_promote_gaps(spark, sf_dir):
    """Skill lines in which some words are ``Git`` and ``hub``."""
    t = resume_tokens(spark, sf_dir).filter("section = 'SKILLS'")
    token = F.when(F.col("token").startswith("Git|"), "Git").when((F.col("token") == "SQL") & (F.col("doc_id") % 2 == 0), "hub").otherwise(F.col("token"))
    return fd.skills_promote(t.withColumn("token", token)).select(*TK, "bio_label")


@query(on_resumes(NOISY + f""" SELECT doc_id, page, line_index, token_index, CASE WHEN coalesce(bio_label = 'B-SKILL' AND lag(bio_label) OVER v LIKE '%-SKILL' AND NOT regexp_matches(lag(token) OVER v, '[,|]$'), false) THEN 'I-SKILL' ELSE bio_label END AS bio_label FROM z WHERE section = 'SKILLS' WINDOW v AS ({LINE})"""))
def skills_merge(spark, sf_dir):
    return fd.skills_merge(noisy(spark, sf_dir).filter("section = 'SKILLS'")).select(*TK, "bio_label")


CLEAN = r"trim(regexp_replace(lower(text), '[^a-z\s]', '', 'g'))"


def names(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(on_resumes(LK + f""" SELECT doc_id, page, line_index, coalesce(last_value(CASE WHEN {CLEAN} IN ({names(fd.OTHER_SECTIONS)}) AND NOT contains(text, ':') THEN 0 WHEN {CLEAN} IN ({names(fd.SKILL_HEADINGS)}) OR kind = 'skill' THEN 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, line_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS in_skills FROM lk"""))
def skills_region(spark, sf_dir):
    return fd.skills_region(known_lines(spark, sf_dir), F.col("kind") == "skill").select("doc_id", "page", "line_index", "in_skills")


E_ = ENT.format("bio_label")


#: Tokens with the labels of the sources: projects and dates have other names there.
SOURCE_LABELS = f""", sl AS (SELECT * REPLACE (replace(CASE WHEN bio_label LIKE '%-DATE' THEN left(bio_label, 2) || CASE WHEN token_index % 2 = 0 THEN 'SDATE' ELSE 'EDATE' END ELSE bio_label END, 'PROJECT_NAME', 'PROJ_NAME') AS bio_label) FROM t),
n AS (SELECT *, {E_} AS e, coalesce(lead(bio_label) OVER ({DOC}) = 'I-' || {E_}, false) AS g FROM sl),
nb AS (SELECT *, CASE WHEN bio_label LIKE 'B-%' THEN CASE WHEN g THEN 'B-' ELSE 'U-' END || e WHEN bio_label LIKE 'I-%' THEN CASE WHEN g THEN 'I-' ELSE 'L-' END || e ELSE bio_label END AS bilou FROM n)"""


def source_labels(spark, sf_dir):
    dated = F.concat(F.substring("bio_label", 1, 2), F.when(F.col("token_index") % 2 == 0, "SDATE").otherwise("EDATE"))
    label = F.when(F.col("bio_label").endswith("-DATE"), dated).otherwise(F.col("bio_label"))
    return resume_tokens(spark, sf_dir).withColumn("bio_label", F.replace(label, F.lit("PROJECT_NAME"), F.lit("PROJ_NAME")))


def mapped(task: str, value: str = "e") -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fd.LABEL_MAPS[task].items()) + " END"


KEPT = "CASE WHEN {0} = 'O' THEN 'O' WHEN {0} IS NOT NULL THEN left(bio_label, 2) || {0} ELSE bio_label END"


@query(on_resumes(SOURCE_LABELS + f""" SELECT doc_id, page, line_index, token_index, bilou, CASE WHEN {mapped('skills')} IS NULL THEN 'O' ELSE CASE WHEN left(bilou, 1) IN ('B', 'U') THEN 'B-' ELSE 'I-' END || {mapped('skills')} END AS skills,
 {KEPT.format(mapped('project'))} AS project, {KEPT.format(mapped('education'))} AS education, CASE WHEN bio_label <> 'O' THEN {mapped('experience')} END AS experience FROM nb"""))
def map_labels(spark, sf_dir):
    """BIO as BILOU, and every task's form of the label by a join with the vocabulary."""
    out = fd.to_bilou(source_labels(spark, sf_dir))
    out = fd.map_label(out, "skills", "bilou", "skills")
    for task in ("project", "education", "experience"):
        out = fd.map_label(out, task, out=task)
    return out.select(*TK, "bilou", "skills", "project", "education", "experience")


@query(on_resumes(BLOCKS + """, mk AS (SELECT doc_id, block, label, NOT regexp_matches(text, '[A-Za-z0-9]') AS mark, lead(label) OVER v AS nx, sum(CASE WHEN regexp_matches(text, '[A-Za-z0-9]') THEN 1 ELSE 0 END) OVER v AS run FROM br WINDOW v AS (PARTITION BY doc_id ORDER BY block)),
mp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY block) AS pos FROM mk),
fo AS (SELECT doc_id, block, run, pos, label FROM mp WHERE pos = 1
  UNION ALL SELECT k.doc_id, k.block, k.run, k.pos, CASE WHEN k.mark AND coalesce(f.label = k.nx, false) THEN f.label ELSE k.label END FROM fo f JOIN mp k ON k.doc_id = f.doc_id AND k.run = f.run AND k.pos = f.pos + 1)
SELECT doc_id, block, label FROM fo"""))
def bridge_punct(spark, sf_dir):
    return fd.bridge_punct(fd.block_rows(blocks(spark, sf_dir)).drop("at")).select("doc_id", "block", "label")


PRIORITY = "CASE c " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(dict.fromkeys(fd.LABEL_MAPS["experience"].values()))) + " END"


@query(on_resumes(SOURCE_LABELS + f""", p AS (SELECT *, row_number() OVER ({DOC}) AS pos, CASE WHEN bio_label <> 'O' THEN {mapped('experience')} END AS c, CASE WHEN e IN ('PROJ_NAME', 'PROJ') THEN 'PROJECT_NAME' ELSE 'DESC' END AS v FROM nb),
f AS (SELECT doc_id, page, line_index, arg_min(c, pos) FILTER (bio_label LIKE 'B-%' AND c IS NOT NULL) AS f, max(e IN ('SDATE', 'EDATE')) AS dated, lower(string_agg(token, ' ' ORDER BY pos)) AS text FROM p GROUP BY ALL),
u AS (SELECT doc_id, page, line_index, arg_max(c, (n, -{PRIORITY})) AS u FROM (SELECT doc_id, page, line_index, c, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY ALL) GROUP BY ALL),
s AS (SELECT doc_id, page, line_index, arg_max(v, (n, -q)) AS s FROM (SELECT doc_id, page, line_index, v, count(*) AS n, min(pos) AS q FROM p GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, page, line_index, coalesce(f, u) AS label, CASE WHEN dated OR regexp_matches(text, '{DATED}') THEN 'DATE' ELSE s END AS segment FROM f JOIN s USING (doc_id, page, line_index) LEFT JOIN u USING (doc_id, page, line_index)"""))
def label_vote(spark, sf_dir):
    """The class of each line as a block of work experience, and as a segment of a project."""
    t, keys = source_labels(spark, sf_dir), ("doc_id", "page", "line_index")
    segment = fd.segment_vote(t, keys, {"PROJ_NAME": "PROJECT_NAME", "PROJ": "PROJECT_NAME"}, "DESC").withColumnRenamed("label", "segment")
    return fd.class_vote(t, keys).join(segment, list(keys))


@query(on_resumes(f""" SELECT doc_id, page, line_index, token_index, CASE WHEN coalesce((line_index <> lag(line_index) OVER v OR page <> lag(page) OVER v) AND {ENT.format('lag(bio_label) OVER v')} = {E_} AND bio_label LIKE 'B-%' AND NOT regexp_matches(token, '^[•*-]') AND NOT ends_with(lag(token) OVER v, ':'), false) THEN 'I-' || {E_} ELSE bio_label END AS bio_label FROM t WINDOW v AS ({DOC})"""))
def align_continuation(spark, sf_dir):
    return fd.align_continuation(resume_tokens(spark, sf_dir)).select(*TK, "bio_label")


@query(on_resumes(""", kd AS (SELECT doc_id, page, line_index, token_index, [length(token) % 5, token_index % 3, length(token) % 3 + 1, token_index % 4, length(token) % 4] AS s, row_number() OVER (PARTITION BY doc_id, page, line_index ORDER BY token_index) AS pos FROM t),
fo AS (SELECT doc_id, page, line_index, token_index, pos, [s[1], s[2], s[3] - 10000, s[4], s[5] - 10000] AS a FROM kd WHERE pos = 1
  UNION ALL SELECT k.doc_id, k.page, k.line_index, k.token_index, k.pos, [s[1], s[2], s[3] - CASE WHEN list_position(f.a, list_max(f.a)) IN (2, 3) THEN 0 ELSE 10000 END, s[4], s[5] - CASE WHEN list_position(f.a, list_max(f.a)) IN (4, 5) THEN 0 ELSE 10000 END]
  FROM fo f JOIN kd k ON k.doc_id = f.doc_id AND k.page = f.page AND k.line_index = f.line_index AND k.pos = f.pos + 1)
SELECT doc_id, page, line_index, token_index, ['O', 'B-A', 'I-A', 'B-B', 'I-B'][list_position(a, list_max(a))] AS label FROM fo"""))
def decode_constrained(spark, sf_dir):
    """Greedy decoding of scores derived from token shape."""
    t = resume_tokens(spark, sf_dir)
    n = F.char_length("token")
    scores = F.array((n % 5).cast("double"), (F.col("token_index") % 3).cast("double"), (n % 3 + 1).cast("double"), (F.col("token_index") % 4).cast("double"), (n % 4).cast("double"))
    return fd.decode_constrained(t.select(*TK, scores.alias("scores")), ["O", "B-A", "I-A", "B-B", "I-B"])


