"""Table functions for SQL users."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docweave.operators.tokenise import DATE_RANGE

MARKS, LINKS = r"[()\[\]{}]", r"https?://|www\.|@"


def _long(token: str) -> list[str]:
    if len(token) >= 25 and "|" in token:
        return _bars(token)
    return re.findall("[A-Z]?[^A-Z]+|[A-Z]", token) if len(token) >= 20 and re.search("[a-z][A-Z]", token) else [token]


def _bars(token: str) -> list[str]:
    return [x for x in (p.strip(" ") for p in token.split("|")) if x] or [token] if "|" in token else [token]


def _apart(token: str, mark: str) -> list[str]:
    return re.findall(f"[^{mark}]+|{mark}", token) if mark in token and token != mark else [token]


def _colons(token: str) -> list[str]:
    return [token] if "://" in token else _apart(token, ":")


def _brackets(token: str) -> list[str]:
    if not re.search(MARKS, token) or re.search(LINKS, token) or re.fullmatch(f"{MARKS}+", token):
        return [token]
    return re.findall(rf"[^()\[\]{{}}]+|{MARKS}", token)


def _dates(token: str) -> list[str]:
    found = re.fullmatch(DATE_RANGE.strip("^$"), token)
    return [found[1], found[2], found[3]] if found else [token]


@udtf(returnType="token_index int, part int, token string", useArrow=True)
class Retokenise:
    """``retokenise(line)``: the words of a line, each split as the splitters of ``tokenise`` split it one after the other:
    long words, bars, commas, colons, brackets, date ranges. token_index counts words, part the parts of one. A null line
    has no rows; empty words between blanks are words."""

    def eval(self, line: str) -> Iterator[tuple[int, int, str]]:
        for i, word in enumerate(line.split(" ") if line is not None else []):
            parts = [word]
            for split in (_long, _bars, lambda t: _apart(t, ","), _colons, _brackets, _dates):
                parts = [piece for part in parts for piece in split(part)]
            for n, piece in enumerate(parts):
                yield i, n, piece


def register(spark: SparkSession) -> None:
    """Makes ``retokenise`` a function of the session: SELECT ... FROM lines, LATERAL retokenise(line)."""
    spark.udtf.register("retokenise", Retokenise)
