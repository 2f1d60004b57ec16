"""Queries over project and education rules, skills clean-up, segment vectors and stage tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.operators import entries as en
from docweave.operators import linerules as lr
from docweave.operators import projects as pj
from docweave.operators import rulepacks as rp
from docweave.operators.lines import group_by_line_run
from docweave.plans.entries_queries import LK, known_lines
from docweave.operators.rulepacks import EMAIL_RX, LEAD_RX, PHONE_RX
from docweave.plans.fields_queries import BLOCKS, DOC, ENT, LINE, NOISY, blocks, noisy
from docweave.plans.layout_queries import LIKENESS
from docweave.plans.linerules_queries import PROJ
from docweave.plans.lines_queries import SEGMENTS, L, lines, segments
from docweave.plans.registry import query
from docweave.plans.streams_queries import shared
from docweave.plans.twins import on_resumes
from docweave.sources.tables import resume_tokens

K = ("doc_id", "page", "line_index")
TK = (*K, "token_index")
CORE = f"trim(regexp_replace(trim(text), '{rp.LEAD_RX}', ''))"


def rx_in(column, rx):
    return f"regexp_matches({column}, '{rx}')"


def like(kind):
    """SQL of the likeness of a line."""
    words = f"len(string_split_regex({CORE}, '\\s+'))"
    parts = {
        "institution": [(0.45, rx_in(f"lower({CORE})", rp.INSTITUTION_RX)), (0.2, f"{CORE} = upper({CORE}) AND {CORE} <> lower({CORE}) AND {words} <= 8"), (0.15, rx_in(CORE, r"\b(?:of|at)\s+[A-Z]")), (0.1, f"{words} <= 6 AND NOT {rx_in(f'lower({CORE})', rp.DEGREE_RX)}")],
        "degree": [(0.5, rx_in(f"lower({CORE})", rp.DEGREE_RX)), (0.25, rx_in(f"lower({CORE})", rp.HONOURS_RX)), (0.15, f"contains({CORE}, '|') AND {rx_in(f'lower({CORE})', rp.DEGREE_RX)}")],
    }[kind]
    total = " + ".join(f"CASE WHEN {CORE} <> '' AND {c} THEN CAST({w} AS DOUBLE) ELSE 0.0 END" for w, c in parts)
    return f"CASE WHEN {rx_in('trim(text)', rp.LEAD_RX)} OR {rx_in(f'lower({CORE})', rp.MARKS_LINE_RX)} OR {rx_in(f'lower({CORE})', rp.PLACE_LINE_RX)} THEN 0.0 ELSE round({total}, 6) END"


@query(on_resumes(L + f" SELECT doc_id, page, line_index, {like('institution')} AS institution, {like('degree')} AS degree FROM l"))
def institution_degree_likeness(spark, sf_dir):
    return lines(spark, sf_dir).select(*K, *[pj.likeness(F.col("text"), k).alias(k) for k in ("institution", "degree")])


@query(on_resumes(LK + f""", s AS (SELECT *, {like('institution')} AS score, row_number() OVER w AS rank FROM lk WINDOW w AS (PARTITION BY doc_id, section ORDER BY page, line_index))
SELECT doc_id, page, line_index, CAST(rank AS INT) AS rank, CAST(rank - max(CASE WHEN is_head THEN rank END) OVER w AS INT) AS since_head, round(0.6 * score + 0.2 * coalesce(lag(score) OVER w, 0.0) + 0.2 * coalesce(lead(score) OVER w, 0.0), 6) AS blended FROM s WINDOW w AS (PARTITION BY doc_id, section ORDER BY page, line_index)"""))
def block_context(spark, sf_dir):
    k = known_lines(spark, sf_dir).withColumn("score", pj.likeness(F.col("text"), "institution"))
    return pj.block_context(k, F.col("is_head")).select(*K, "rank", "since_head", "blended")


CORE_TEXT = f"trim(regexp_replace(trim(text), '{LEAD_RX}', ''))"


@query(on_resumes(L + f""", li AS (SELECT doc_id, page, line_index, text, {CORE_TEXT} AS core, trim(regexp_replace(trim(text), '^[•*●·▪■◦✓✔ -]+', '')) AS c, ks.kind FROM l JOIN (SELECT DISTINCT doc_id, page, line_index, kind FROM t) ks USING (doc_id, page, line_index)),
la AS (SELECT *, CASE kind WHEN 'project' THEN 'PROJECT_NAME' WHEN 'job' THEN 'DATE' WHEN 'name' THEN NULL ELSE 'DESC' END AS label, CASE WHEN c = '' THEN 0.0 ELSE round(CAST(least(1.0, {LIKENESS}) AS DOUBLE), 6) END AS likeness FROM li)
SELECT doc_id, page, line_index, CAST(CASE WHEN label IS NULL THEN 0.0 WHEN label = 'DESC' AND length(core) >= 3 AND likeness >= 0.25 AND NOT (regexp_matches(lower(core), '{pj.NARRATIVE_RX}') AND len(string_split_regex(core, ' +')) > 12) THEN 5.0
  WHEN label = 'DESC' THEN 1.5 WHEN label = 'PROJECT_NAME' THEN 1.2 ELSE 1.0 END AS DOUBLE) AS weight FROM la"""))
def context_weights(spark, sf_dir):
    k = known_lines(spark, sf_dir)
    label = F.when(F.col("kind") == "project", "PROJECT_NAME").when(F.col("kind") == "job", "DATE").when(F.col("kind") == "name", None).otherwise("DESC")
    return k.select(*K, pj.context_weight(label, F.col("text")).cast("double").alias("weight"))


@query(on_resumes(NOISY + f" SELECT doc_id, page, line_index, token_index, CASE WHEN bio_label LIKE 'B-%' AND sum(CASE WHEN bio_label LIKE 'B-%' THEN 1 ELSE 0 END) OVER ({LINE}) = 1 THEN 'B-PROJ_START' WHEN bio_label LIKE 'B-%' THEN 'I-PROJ_START' ELSE 'O' END AS decoded FROM z WHERE section = 'PROJECT'"))
def proj_decode(spark, sf_dir):
    return pj.decode_starts(noisy(spark, sf_dir).filter("section = 'PROJECT'")).select(*TK, "decoded")


HEADER = (
    "(low IN ('projects', 'project') OR regexp_matches(low, '(?:^|[^a-z])(?:mini|academic|personal|key|selected|recent|course|minor|major) projects?(?:[^a-z]|$)|projects? client') OR (starts_with(low, 'projects') AND length(low) < 40 AND NOT bul))"
)


@query(on_resumes(LK + PROJ + f""", ps AS (SELECT lk.doc_id, lk.page, lk.line_index, lk.font_median, lk.is_bold, lk.x0, kind = 'project' AND lk.line_index % 2 = 0 AS anchor, NOT (suppress OR is_continuation OR {HEADER.replace('low', "lower(regexp_replace(trim(lk.text), '[:.,;]+$', ''))")}) AS valid FROM lk JOIN pr3 USING (doc_id, page, line_index) WHERE section = 'PROJECT'),
a AS (SELECT doc_id, arg_min({{'f': font_median, 'b': is_bold, 'x': x0}}, (page, line_index)) FILTER (anchor AND valid) AS s, arg_min({{'f': font_median, 'b': is_bold, 'x': x0}}, (page, line_index)) FILTER (valid) AS r FROM ps GROUP BY ALL),
b AS (SELECT doc_id, coalesce(s, r) AS a FROM a)
SELECT doc_id, page, line_index, coalesce(abs(font_median - a.f) <= 0.5 AND is_bold = a.b AND abs(x0 - a.x) <= 10, false) AS is_head FROM ps LEFT JOIN b USING (doc_id)"""))
def proj_style_heads(spark, sf_dir):
    """Titles scored on every second line only."""
    k = known_lines(spark, sf_dir).filter("section = 'PROJECT'").withColumn("is_anchor", (F.col("kind") == "project") & (F.col("line_index") % 2 == 0))
    return pj.proj_style_heads(lr.proj_line_rules(k, "is_anchor", "font_median", "is_bold", "x0")).select(*K, "is_head")


@query(on_resumes(LK + PROJ + """, kp AS (SELECT lk.doc_id, lk.page, lk.line_index, row_number() OVER v AS pos, section = 'PROJECT' AS pj, is_head OR kind = 'bullet' AS b, is_bold AS rs, pr3.bul AS hb, pr3.counted AS ct, is_title, suppress, is_continuation, is_numbered OR is_link_title AS fo,
  coalesce(lag(pr3.bul) OVER v, false) AND NOT pr3.bul AS tr FROM lk JOIN pr3 USING (doc_id, page, line_index) WINDOW v AS (PARTITION BY lk.doc_id ORDER BY lk.page, lk.line_index)),
ka AS (SELECT *, hb OR ct OR rs OR tr AS may, NOT suppress AND NOT is_continuation AND NOT (hb AND NOT is_title) AS fits FROM kp),
st AS (SELECT doc_id, page, line_index, pos, pj AND ((b AND fits) OR (NOT b AND is_title AND (may OR fo))) AS is_head, pj AND ((b AND fits) OR (NOT b AND is_title AND (may OR fo))) AS inside FROM ka WHERE pos = 1
  UNION ALL SELECT k.doc_id, k.page, k.line_index, k.pos, k.pj AND CASE WHEN k.b THEN NOT (s.inside AND NOT k.may) AND k.fits ELSE k.is_title AND (k.may OR k.fo) AND (NOT s.inside OR k.hb OR k.tr OR k.fo) END,
  k.pj AND (s.inside OR CASE WHEN k.b THEN k.fits ELSE k.is_title AND (k.may OR k.fo) END) FROM st s JOIN ka k ON k.doc_id = s.doc_id AND k.pos = s.pos + 1)
SELECT doc_id, page, line_index, is_head FROM st"""))
def proj_boundary_fix(spark, sf_dir):
    """Starts scored on every title and on bullets, over all lines of the documents."""
    k = known_lines(spark, sf_dir).withColumn("in_project", F.col("section") == "PROJECT").withColumn("begins", F.col("is_head") | (F.col("kind") == "bullet")).withColumn("resets", F.col("is_bold"))
    return pj.proj_boundary_fix(lr.proj_line_rules(k, "in_project", "begins", "resets"))


@query(on_resumes(LK + PROJ + " SELECT lk.doc_id, lk.page, lk.line_index FROM lk JOIN pr3 USING (doc_id, page, line_index) WHERE is_head AND NOT is_metadata AND NOT regexp_matches(pr3.tx, '^[•*▪◦■–—·✓✔●❖‣⁃╋▸-]')"))
def proj_metadata_prune(spark, sf_dir):
    """Starts that stand neither on a metadata line nor on a bullet."""
    k = lr.proj_line_rules(known_lines(spark, sf_dir).filter("is_head"))
    return k.filter(~F.col("is_metadata") & ~F.col("text").rlike(f"^{lr.BULLET}")).select(*K)


@query(on_resumes(SEGMENTS + """, c AS (SELECT si.*, k.section = 'EXPERIENCE' AND k.kind <> 'heading' AS inside, coalesce(si.page <> lag(si.page) OVER v OR si.line_index <> lag(si.line_index) OVER v, true) AS ch
  FROM si JOIN (SELECT DISTINCT doc_id, page, line_index, section, kind FROM t) k USING (doc_id, page, line_index) WINDOW v AS (PARTITION BY si.doc_id ORDER BY seg_index)),
r AS (SELECT *, sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seg_index) AS line_run FROM c)
SELECT doc_id, CAST(line_run AS BIGINT) AS line_run, min(seg_index) AS seg_index FROM r WHERE inside GROUP BY ALL"""))
def collapse_anchor(spark, sf_dir):
    """The anchor segment of each physical line of the section."""
    known = known_lines(spark, sf_dir).select(*K, ((F.col("section") == "EXPERIENCE") & (F.col("kind") != "heading")).alias("in_section"))
    return en.collapse_anchor(group_by_line_run(segments(spark, sf_dir)).join(known, list(K)))


@query(on_resumes(LK + ", mo AS (SELECT doc_id, page, line_index FROM lk WHERE kind = 'school' AND doc_id % 4 = 0), sy AS (SELECT doc_id, page, line_index FROM lk WHERE section = 'EDUCATION' AND is_bold AND kind <> 'heading') SELECT * FROM mo UNION ALL SELECT * FROM sy WHERE doc_id NOT IN (SELECT doc_id FROM mo)"))
def edu_boundary_pipeline(spark, sf_dir):
    k = known_lines(spark, sf_dir)
    return pj.edu_boundary_pipeline(k.filter("kind = 'school' AND doc_id % 4 = 0").select(*K), k.filter("section = 'EDUCATION' AND is_bold AND kind <> 'heading'").select(*K))


def any_of(column: str, words) -> str:
    """Whether the text holds one of the words, as parts of its own words too."""
    listed = ", ".join("'" + w + "'" for w in words)
    return f"len(list_filter([{listed}], lambda k: contains({column}, k))) > 0"


PARTS = "list_filter(list_transform(regexp_split_to_array(lower(trim(text)), '[,|]'), lambda x: trim(x)), lambda x: x <> '')"
NOISE = (
    f"CASE WHEN trim(regexp_replace(lower(trim(text)), '[.:,;]+$', '')) IN {tuple(pj.GENERIC_ROLES)} THEN 'generic_role' WHEN regexp_matches(text, '[,|]') AND {any_of('lower(text)', pj.TECH)} AND len({PARTS}) > 0"
    f" AND NOT regexp_replace(string_split_regex(lower(trim(text)), ' +')[1], '[:,.-]+$', '') IN {tuple(pj.ACTIVE_VERBS)} AND NOT {any_of('lower(text)', pj.THINGS)}"
    f" AND len(list_filter({PARTS}, lambda p: length(p) < 15 OR {any_of('p', pj.TECH)})) >= 0.75 * len({PARTS}) THEN 'tech_stack' ELSE 'none' END"
)


@query(on_resumes(BLOCKS + f" SELECT doc_id, block, {NOISE} AS noise FROM br"))
def noise_filters(spark, sf_dir):
    from docweave.operators.fields import block_rows

    return block_rows(blocks(spark, sf_dir)).select("doc_id", "block", pj.noise(F.col("text")).alias("noise"))


#: Blocks eb of five, as if each five were an entry, with roles and technologies among them.
ENTRY_BLOCKS = BLOCKS + r""", eb AS (SELECT doc_id, block, CAST(floor(block / 5) AS BIGINT) AS entry, CASE WHEN block % 11 = 3 THEN 'Tech Stack : ' || text WHEN block % 5 = 0 AND block % 3 = 0 THEN text || ' –' ELSE text END AS text,
  CASE WHEN label IN ('PROJECT_NAME', 'SKILL') OR block % 5 = 0 THEN 'ROLE' WHEN label IN ('DATE', 'INSTITUTION') THEN 'DESC' ELSE label END AS label FROM br)"""
LETTERED = "list_filter(string_split_regex(trim(text), ' +'), lambda w: regexp_matches(w, '\\p{L}'))"


def entry_blocks(spark, sf_dir):
    from docweave.operators.fields import block_rows

    rows, n = block_rows(blocks(spark, sf_dir)).drop("at").withColumn("entry", F.floor(F.col("block") / 5)), F.col("block")
    text = F.when(n % 11 == 3, F.concat(F.lit("Tech Stack : "), "text")).when((n % 5 == 0) & (n % 3 == 0), F.concat("text", F.lit(" –"))).otherwise(F.col("text"))
    label = F.when(F.col("label").isin("PROJECT_NAME", "SKILL") | (n % 5 == 0), "ROLE").when(F.col("label").isin("DATE", "INSTITUTION"), "DESC").otherwise(F.col("label"))
    return rows.withColumn("label", label).withColumn("text", text)


@query(on_resumes(ENTRY_BLOCKS + f""", ev AS (SELECT *, lower(trim(text)) AS low, len(string_split_regex(trim(text), ' +')) AS n, contains(lower(text), 'technology stack') OR contains(lower(text), 'tech stack') OR starts_with(lower(trim(text)), 'technology :') OR starts_with(lower(trim(text)), 'tech :') AS li, {LETTERED} AS w FROM eb),
cx AS (SELECT *, coalesce(last_value(CASE WHEN n > 6 AND label = 'DESC' THEN false WHEN li THEN true END IGNORE NULLS) OVER (PARTITION BY doc_id, entry ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS inside,
  len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= 0.7 * len(w) AS proper FROM ev)
SELECT doc_id, block, CASE WHEN label IN ('ROLE', 'COMP') AND (li OR inside OR n > 10 OR (n > 4 AND NOT ({any_of('low', pj.ROLE_KEYWORDS + pj.COMPANY_KEYWORDS)} OR proper))) THEN 'DESC' ELSE label END AS label FROM cx"""))
def exp_overrides(spark, sf_dir):
    return pj.exp_overrides(entry_blocks(spark, sf_dir)).select("doc_id", "block", "label")


@query(on_resumes(ENTRY_BLOCKS + f""", rk AS (SELECT *, row_number() OVER e AS rk, lag(label) OVER e AS pl, lag(text) OVER e AS pt, max(CASE WHEN label = 'COMP' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, entry) AS comp FROM eb WINDOW e AS (PARTITION BY doc_id, entry ORDER BY block))
SELECT doc_id, block, CASE WHEN comp = 0 AND rk = 2 AND pl = 'ROLE' AND regexp_matches(trim(pt), '(?:^| )[|–—-]$') AND label = 'DESC' AND len({LETTERED}) BETWEEN 1 AND 6 THEN 'COMP' ELSE label END AS label FROM rk"""))
def exp_fill_company(spark, sf_dir):
    return pj.exp_fill_company(entry_blocks(spark, sf_dir)).select("doc_id", "block", "label")


OWN = ENT.format("bio_label")


@query(on_resumes(f" SELECT doc_id, page, line_index, CASE WHEN count(DISTINCT CASE WHEN bio_label <> 'O' THEN {OWN} END) > 1 THEN 'HETEROGENEOUS' ELSE coalesce(arg_min({OWN}, token_index) FILTER (bio_label LIKE 'B-%'), 'O') END AS label, count(DISTINCT CASE WHEN bio_label <> 'O' THEN {OWN} END) <= 1 AS homogeneous, count(*) > 12 AS mega FROM t GROUP BY ALL"))
def bio_label_of_segment(spark, sf_dir):
    return pj.label_of_segment(resume_tokens(spark, sf_dir), K)


@query(on_resumes(f" SELECT doc_id, page, line_index, token_index, CASE WHEN coalesce(row_number() OVER v = 2 AND regexp_matches(lag(token) OVER v, '^[•◦●▪*–-]$'), false) AND regexp_matches(token, '[A-Za-z0-9]') THEN 'B-SKILL' ELSE bio_label END AS bio_label FROM t WINDOW v AS ({LINE})"))
def skills_bullet_cont(spark, sf_dir):
    return pj.skills_bullets(resume_tokens(spark, sf_dir)).select(*TK, "bio_label")


ALL_SKILL = ", sk AS (SELECT * REPLACE (CASE WHEN token = ',' THEN 'O' ELSE 'B-SKILL' END AS bio_label) FROM t WHERE section = 'SKILLS')"


def all_skills(spark, sf_dir):
    return resume_tokens(spark, sf_dir).filter("section = 'SKILLS'").withColumn("bio_label", F.when(F.col("token") == ",", "O").otherwise("B-SKILL"))


@query(on_resumes(ALL_SKILL + f" SELECT doc_id, page, line_index, token_index, CASE WHEN coalesce((line_index <> lag(line_index) OVER v OR page <> lag(page) OVER v) AND bio_label = 'B-SKILL' AND lag(bio_label) OVER v LIKE '%-SKILL' AND NOT regexp_matches(lag(token) OVER v, '[,|]$'), false) THEN 'I-SKILL' ELSE bio_label END AS bio_label FROM sk WINDOW v AS ({DOC})"))
def skills_line_cont(spark, sf_dir):
    return pj.skills_lines(all_skills(spark, sf_dir)).select(*TK, "bio_label")


@query(on_resumes(f", sk AS (SELECT * REPLACE ('I-SKILL' AS bio_label) FROM t WHERE section = 'SKILLS') SELECT doc_id, page, line_index, token_index, CASE WHEN regexp_matches(token, '^[,|]+$') THEN 'O' WHEN coalesce(regexp_matches(lag(token) OVER v, ',$') AND bio_label LIKE '%-SKILL', false) THEN 'B-SKILL' ELSE bio_label END AS bio_label FROM sk WINDOW v AS ({LINE})"))
def skills_comma_head(spark, sf_dir):
    """New heads after commas; the commas lose their labels."""
    return pj.skills_commas(resume_tokens(spark, sf_dir).filter("section = 'SKILLS'").withColumn("bio_label", F.lit("I-SKILL"))).select(*TK, "bio_label")


@query(on_resumes(" SELECT doc_id, page, line_index, token_index, CASE WHEN regexp_matches(token, '^[,|]+$') THEN 'O' ELSE 'B-SKILL' END AS bio_label FROM t WHERE section = 'SKILLS'"))
def skills_strip_comma(spark, sf_dir):
    return resume_tokens(spark, sf_dir).filter("section = 'SKILLS'").select(*TK, F.when(F.col("token").rlike("^[,|]+$"), "O").otherwise("B-SKILL").alias("bio_label"))


@query(on_resumes(f""", c AS (SELECT * REPLACE (CASE WHEN token_index = 2 THEN 'https' WHEN token_index = 3 THEN ':' ELSE token END AS token) FROM t WHERE section = 'PERSONAL'),
n AS (SELECT *, lead(token) OVER v AS nx, first_value(CASE WHEN token NOT IN ('https', 'http', ':', '//') THEN token END IGNORE NULLS) OVER ({LINE} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM c WINDOW v AS ({LINE}))
SELECT doc_id, page, line_index, token_index, token || '://' || regexp_replace(af, '^/+', '') AS url FROM n WHERE token IN ('https', 'http') AND nx = ':' AND af IS NOT NULL"""))
def stitch_urls(spark, sf_dir):
    cut = F.when(F.col("token_index") == 2, "https").when(F.col("token_index") == 3, ":").otherwise(F.col("token"))
    return pj.stitch_urls(resume_tokens(spark, sf_dir).filter("section = 'PERSONAL'").withColumn("token", cut)).select(*TK, "url")


DIGITS = "length(regexp_replace(raw, '[^0-9]', '', 'g'))"


@query(on_resumes(f""", pe AS (SELECT doc_id, page, line_index, token_index, trim(token) AS raw, lower(trim(token)) AS low, regexp_replace(bio_label, '^I-', 'B-') AS lb FROM t)
SELECT doc_id, page, line_index, token_index, CASE WHEN raw = '' OR low IN {tuple(pj.FIELD_NAMES)} THEN 'O' WHEN regexp_matches(low, '{EMAIL_RX}') THEN 'B-EMAIL' WHEN contains(low, 'linkedin.com') THEN 'B-LINKEDIN' WHEN contains(low, 'github.com') THEN 'B-GITHUB'
  WHEN (regexp_matches(raw, '{PHONE_RX}') AND {DIGITS} BETWEEN 7 AND 15) OR (starts_with(raw, '+') AND {DIGITS} > 0) THEN 'B-PHONE' WHEN low IN {tuple(pj.LINK_NAMES)} OR (lb IN ('B-LINKEDIN', 'B-GITHUB') AND regexp_matches(low, '{pj.SITE_RX}')) THEN 'B-OTHER_LINK' ELSE lb END AS label FROM pe"""))
def personal_text_rules(spark, sf_dir):
    return resume_tokens(spark, sf_dir).select(*TK, pj.personal_by_text(F.col("token"), F.col("bio_label")).alias("label"))


@query(on_resumes(""", kr AS (SELECT doc_id, page, line_index, token_index, y0, greatest(4.0, 0.4 * avg(y1 - y0) OVER (PARTITION BY doc_id, page)) AS reach, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, line_index, token_index) AS pos FROM t),
fo AS (SELECT doc_id, page, line_index, token_index, pos, y0 AS mean, 1 AS n, 0 AS row FROM kr WHERE pos = 1
  UNION ALL SELECT k.doc_id, k.page, k.line_index, k.token_index, k.pos, CASE WHEN abs(k.y0 - f.mean) < k.reach THEN (f.mean * f.n + k.y0) / (f.n + 1) ELSE k.y0 END, CASE WHEN abs(k.y0 - f.mean) < k.reach THEN f.n + 1 ELSE 1 END, CASE WHEN abs(k.y0 - f.mean) < k.reach THEN f.row ELSE f.row + 1 END
  FROM fo f JOIN kr k ON k.doc_id = f.doc_id AND k.page = f.page AND k.pos = f.pos + 1)
SELECT doc_id, page, line_index, token_index, row FROM fo"""))
def cluster_rows(spark, sf_dir):
    return pj.cluster_rows(resume_tokens(spark, sf_dir))


@query(on_resumes(L + """, ks AS (SELECT doc_id, page, line_index, CAST(is_bold AS INT) AS b, CAST(is_caps AS INT) AS c, n_tokens AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_index) AS pos FROM l),
fo AS (SELECT doc_id, page, line_index, pos, [20 * b + 15 * c - 3 * n, 2 * n, 5] AS s FROM ks WHERE pos = 1
  UNION ALL SELECT k.doc_id, k.page, k.line_index, k.pos, [20 * b + 15 * c - 3 * n + CASE WHEN list_position(f.s, list_max(f.s)) = 1 THEN 5 ELSE 0 END, 2 * n + CASE WHEN list_position(f.s, list_max(f.s)) = 2 THEN 4 ELSE 0 END, 5 + CASE WHEN list_position(f.s, list_max(f.s)) = 3 THEN 3 ELSE 0 END]
  FROM fo f JOIN ks k ON k.doc_id = f.doc_id AND k.pos = f.pos + 1)
SELECT doc_id, page, line_index, ['HEADING', 'BODY', 'OTHER'][list_position(s, list_max(s))] AS label FROM fo"""))
def score_sequential(spark, sf_dir):
    """A linear scorer of a line's look and of the label before it; any other can be handed over."""

    def score(row, last):
        again = lambda k, w: F.when(last == k, w).otherwise(0)
        return [20 * row["is_bold"].cast("int") + 15 * row["is_caps"].cast("int") - 3 * row["n_tokens"] + again(0, 5), 2 * row["n_tokens"] + again(1, 4), 5 + again(2, 3)]

    told = lines(spark, sf_dir).select(*K, "is_bold", "is_caps", "n_tokens")
    return pj.score_sequential(told, ["HEADING", "BODY", "OTHER"], score)


@query(on_resumes(" SELECT doc_id, page, line_index, token_index, token, bio_label FROM t"))
def sink_stage(spark, sf_dir):
    """A stage table written, its partition overwritten, and read again."""
    folder = f"{shared(spark)}/stages-{uuid.uuid4().hex}"
    t = resume_tokens(spark, sf_dir).select(*TK, "token", "bio_label")
    for _ in range(2):
        pj.write_stage(t, folder, "run1", "labels")
    return pj.read_stage(spark, folder, "run1", "labels")


@query(on_resumes(f" SELECT doc_id, page, line_index, token_index, CASE WHEN bio_label = 'O' THEN 'O' WHEN {OWN} = coalesce({ENT.format('lag(bio_label) OVER v')}, 'O') THEN 'I-' || {OWN} ELSE 'B-' || {OWN} END AS clean_label FROM t WINDOW v AS ({DOC})"))
def replay_stage(spark, sf_dir):
    """One stage applied again to its stored predecessor."""
    from docweave.operators.fields import bio_sanitise

    folder = f"{shared(spark)}/stages-{uuid.uuid4().hex}"
    pj.write_stage(resume_tokens(spark, sf_dir).select(*TK, "x0", "token", "bio_label"), folder, "run1", "labels")
    return bio_sanitise(pj.read_stage(spark, folder, "run1", "labels")).select(*TK, "clean_label")


@query(on_resumes(" SELECT doc_id, page, line_index, token_index, token FROM t"))
def src_tokens(spark, sf_dir):
    """Nested token artifacts, one document each, written as JSON and read with a declared schema."""
    folder = f"{shared(spark)}/artifacts-{uuid.uuid4().hex}"
    t = resume_tokens(spark, sf_dir)
    t.groupBy("doc_id").agg(F.collect_list(F.struct("page", "line_index", "token_index", "token")).alias("tokens")).write.option("compression", "gzip").json(folder)
    read = spark.read.schema("doc_id long, tokens array<struct<page:int,line_index:int,token_index:int,token:string>>").json(folder)
    return read.select("doc_id", F.explode("tokens").alias("t")).select("doc_id", "t.*")


@query(on_resumes(BLOCKS + " SELECT doc_id, block AS segment, page, line_index, string_agg(token, ' ' ORDER BY token_index) AS text FROM bl GROUP BY ALL"))
def split_by_line(spark, sf_dir):
    return pj.split_by_line(blocks(spark, sf_dir).withColumnRenamed("block", "segment"))


@query(on_resumes(" SELECT doc_id, page, line_index, token_index, token, bio_label, section FROM t WHERE section = 'SKILLS'"))
def project_artifact(spark, sf_dir):
    return resume_tokens(spark, sf_dir).filter("section = 'SKILLS'").select(*TK, "token", "bio_label", "section")


@query(on_resumes(LK + " SELECT doc_id, page, line_index, text FROM lk WHERE kind = 'heading' ORDER BY ALL"))
def sort_headings(spark, sf_dir):
    return known_lines(spark, sf_dir).filter("kind = 'heading'").select(*K, "text").orderBy(*K)


@query(on_resumes(LK + " SELECT doc_id, page, line_index, kind FROM lk WHERE is_head ORDER BY ALL"))
def sort_heads(spark, sf_dir):
    return known_lines(spark, sf_dir).filter("is_head").select(*K, "kind").orderBy(*K)
