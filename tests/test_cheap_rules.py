"""Cheap questions asked first change no answer, and plans do not do the same work twice."""

import random

from pyspark.sql import functions as F

from docweave.functions.numbers import rounded
from docweave.operators import headings as hd
from docweave.operators import layout as lo
from docweave.operators import linerules as lr
from docweave.operators import rulepacks as rp
from docweave.plans import registry

SF = "/root/testdata/sf0.001"
ODD = "a b\t\n\x0b\r\x85  :*#>-•◦●.,;:()|/&0199 2 Ïßſİ"
WORDS = [
    *hd.HEADINGS, *map(str.lower, hd.HEADINGS), "EXPERIANCE", "S K I L L S", "W O R K  E X P", "B.Tech", "m.c.a", "PhD", "be", "University of X", "hs", "2019", "jan 2020", "Jan.'19", "cgpa: 8", "12th", "ssc",
    "certificate", "school year", "studied", "completed,", "api.", "live demo", "( 1 ) x", "1. x", "domain :", "Acme ltd.", "project", "| React", "code  link", "analysis ,", "Name of it :", "------", "higher secondary",
]


def texts(n=4000):
    r = random.Random(5)
    made = ["".join(r.choice(ODD) for _ in range(r.randrange(4))) + r.choice([" ", "  ", ""]).join(r.choices(WORDS, k=r.randrange(4))) + "".join(r.choice(ODD) for _ in range(r.randrange(4))) for _ in range(n)]
    return [*made, *WORDS, "", " ", "•", "::", None]


def lines(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, text string").selectExpr("CAST(i AS BIGINT) AS doc_id", "0 AS page", "i AS line_index", "text")


def test_rounded_is_round(spark):
    r = random.Random(3)
    halves = [k / 2e6 + d for k in range(-9, 10) for d in (0.0, 1e-12, -1e-12)]
    values = [*halves, *(r.uniform(-1, 1) * 10 ** r.randrange(-9, 20) for _ in range(20000)), *(round(r.uniform(-5, 5), 7) for _ in range(5000)), 0.0, -0.0, -1e-9, 1e300, float("nan"), float("inf"), -float("inf"), None, 0.0000005, 2.5e-6, 1.0000005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 3, 6):
        for a, b in df.select(F.round("x", digits), rounded(F.col("x"), digits)).collect():
            assert repr(a) == repr(b)


def test_dictionary_is_the_whole_search(spark):
    keys = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(s).alias("section")) for k, s in sorted(hd.HEADINGS.items(), key=lambda x: (-len(x[0]), x[0]))])

    def hit(e):
        key, norm = e["key"], F.col("norm")
        free = ~key.isin(hd.ALONE) & (norm.startswith(F.concat(key, F.lit(" "))) | (norm.endswith(F.concat(F.lit(" "), key)) & ~key.isin(hd.NOT_AT_END)))
        return ((norm == key) | free) & (F.char_length(norm) <= F.char_length(key) + 15)

    found = hd.match_dictionary(lines(spark)).withColumn("want", F.get(F.filter(keys, hit), F.lit(0)))
    rows = found.select("text", "key", "heading_section", "want.key", "want.section").collect()
    assert all((r[1], r[2]) == (r[3], r[4]) for r in rows) and sum(r[1] is not None for r in rows) > 500


def test_normalised_as_by_expressions(spark):
    bare = F.trim(F.regexp_replace(F.regexp_replace("text", r"^[#*>•◦●▪\-\s]+", ""), r"[:*\s]+$", ""))
    words = F.split(bare, " +", -1)
    spaced = (F.size(words) > 3) & (F.size(F.filter(words, lambda w: F.char_length(w) == 1)) == F.size(words))
    joined = F.array_join(F.transform(F.split(bare, " {2,}", -1), lambda w: F.replace(w, F.lit(" "), F.lit(""))), " ")
    out = F.upper(F.when(spaced, joined).otherwise(F.regexp_replace(bare, " +", " ")))
    for wrong, right in hd.TYPOS.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    assert all(a == b for a, b in lines(spark).select(out, hd.normalise(F.col("text"))).collect())


def test_line_rules_as_by_expressions(spark):
    text = F.trim("text")
    core = F.lower(F.regexp_replace(text, rf"^{lr.BULLET}\s*", ""))
    first = F.regexp_replace(F.regexp_extract(core, r"^(\S+)", 1), "[.,;:]+$", "")
    low, size = F.lower(text), F.size(F.split(core, r"\s+"))
    want = {
        "has_bullet": text.rlike(f"^{lr.BULLET}"),
        "is_description": text.rlike(f"^{lr.BULLET}") & first.rlike(f"^(?:{lr.DETAIL_STARTS})$"),
        "is_separator": (text == "") | text.rlike(lr.SEPARATOR_RX),
        "is_exam": core.rlike(lr.EXAM_RX),
        "is_certificate": core.rlike(lr.CERTIFICATE_RX) | (core.contains("certificate") & core.rlike("secondary|school|hsc|ssc")),
        "has_abbreviation": core.rlike(lr.ABBREVIATION_RX),
        "has_date": low.rlike(lr.DATE_RX),
        "is_section_header": low.rlike(lr.SECTION_RX),
        "is_metadata": low.rlike(lr.METADATA_RX) | (low.rlike(lr.MARKS_RX) & ~low.rlike(lr.INSTITUTIONS)),
        "is_degree_opener": first.rlike(f"^(?:{lr.DEGREE_WORDS})$") | core.rlike("^(?:bachelor|master|doctor) of") | core.rlike(lr.ABBREVIATION_RX),
        "is_continuation": (core != "") & (size <= 4) & (core.rlike(r"^[)\]},]") | (core.endswith(")") & ~core.rlike(lr.INSTITUTIONS))),
    }
    known = lines(spark).filter("text IS NOT NULL")
    told = lr.edu_line_rules(known).select("line_index", *want).collect()
    plain = known.select("line_index", *[c.alias(n) for n, c in want.items()]).collect()
    assert sorted(told) == sorted(plain)


def test_likeness_as_by_expressions(spark):
    clean = F.trim(F.regexp_replace(F.trim("text"), r"^[•*●·▪■◦✓✔ -]+", ""))
    words = F.size(F.split(clean, " +"))
    rules = [*((F.lower(clean), *r) for r in lo.TITLE_RULES), (clean, *lo.COLON_TITLE)]
    score = sum(F.when(v.rlike(rx) & (words <= most if most is not None else F.lit(True)), w).otherwise(0.0) for v, w, rx, most in rules)
    want = F.when(clean == "", 0.0).otherwise(F.round(F.least(F.lit(1.0), score), 6))
    told = lo.with_likeness(lines(spark)).select(want, "likeness", lo.title_likeness(F.col("text"))).collect()
    assert all(a == b == c for a, b, c in told) and len({a for a, _, _ in told}) > 8


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution()


def test_token_vectors_sort_their_rows_once(spark):
    for name, joins in (("token_vector20", 0), ("pooled_vector24", 0), ("token_vector10", 1)):
        text = plan(spark, name).sparkPlan().toString()
        assert text.count("lambdafunction") == 0 and text.count("Join") == joins, name
        assert plan(spark, name).executedPlan().toString().count("Sort [doc_id") <= 1 + 2 * joins, name
    assert "posexplode(v" not in plan(spark, "pooled_vector24").optimizedPlan().toString()


def test_pooled_vectors(spark):
    rows = [(d, k, [float(i + k + n) for i in range(20)], t) for d in (1, None) for k in (0, 1) for n, t in enumerate(["a@b.co", "+1 (234) 567", "GitHub", "https://x", "12345678901234567", "www.y"][: 3 + 3 * k])]
    got = {(r.doc_id, r.k): r.v for r in rp.pooled_vector24(spark.createDataFrame([*rows, (2, 0, None, "no vector")], "doc_id long, k int, v array<double>, token string"), ["doc_id", "k"]).collect()}
    assert got == {(1, 0): [i + 1.0 for i in range(20)] + [1.0, 1.0, 1.0, 0.0], (1, 1): [i + 3.5 for i in range(20)] + [1.0, 1.0, 1.0, 1.0]}
