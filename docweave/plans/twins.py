"""SQL text of the inputs that the oracles start from."""

from __future__ import annotations

from docweave.sources.tables import RESUME_LINES, RESUME_TOKENS

LINES = RESUME_LINES.format(**{t: t for t in ("customer", "orders", "lineitem", "part", "nation")})

DOC_TOKENS = """
dl AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
ds AS (SELECT doc_id, line_no, unnest(range(len(string_split(line, ' ')))) AS token_index, unnest(string_split(line, ' ')) AS token FROM dl),
dx AS (SELECT *, 6.0 * coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY token_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x0 FROM ds),
d AS (SELECT doc_id, CAST(floor(line_no / 50) AS INT) AS page, CAST(line_no % 50 AS INT) AS line_index, CAST(token_index AS INT) AS token_index, token, CAST(x0 AS DOUBLE) AS x0,
  CAST(12 * (line_no % 50) AS DOUBLE) AS y0, CAST(x0 + 6 * length(token) AS DOUBLE) AS x1, CAST(12 * (line_no % 50) + 10 AS DOUBLE) AS y1 FROM dx WHERE token <> '')
"""


def on_documents(sql: str) -> str:
    """``sql`` over d: the tokens of ``documents``; dl holds its lines."""
    return f"WITH {DOC_TOKENS.strip()} {sql}"


def on_resumes(sql: str) -> str:
    """``sql`` over t: the tokens of the rendered résumés, and rl: their lines. Starts with a query or more named ones after a comma."""
    tokens = RESUME_TOKENS.strip()
    return f"""WITH RECURSIVE rl AS MATERIALIZED ({LINES}),
split_lines AS (SELECT *, unnest(range(len(string_split(txt, ' ')))) AS token_index, unnest(string_split(txt, ' ')) AS token FROM rl),
t AS MATERIALIZED ({tokens}) {sql}"""
