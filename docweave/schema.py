"""Fixed schemas of the stage tables."""

from __future__ import annotations

TOKENS = (
    "doc_id long, page int, line_index int, token_index int, token string, x0 double, y0 double, x1 double, y1 double, "
    "font_size double, is_bold boolean, embedded_url string, section string, bio_label string"
)
#: Reading order inside a document; every ordered operator takes it unless told otherwise.
ORDER = ("page", "line_index", "token_index", "x0")
LINE_KEY = ("doc_id", "page", "line_index")
LINES_PER_PAGE = 50
CHAR_WIDTH, LINE_HEIGHT = 6, 12
