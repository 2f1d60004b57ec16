"""Operator 10: line-first quality rules, with DataFrame functions only.

Every line with a word is judged on its own, by rules for

* punctuation: more than 3 marks of ``#*$%&|<>``, or of ``!?``, in 10 words; no letter or digit at all; no letter and
  at most 3 words (page numbers); a teaser of at most 12 words that ends in an ellipsis;
* navigation: a run of short items between separators; a bullet with at most 3 words and no full stop; a counter of
  likes, comments, shares or views; a line that is only a link to more;
* boilerplate: a line of at most 200 characters with a fixed phrase of web furniture, in four languages.

Failing lines go; a document goes if it fails the base rules (under 10 words, or more than a fifth of its words inside
five-word windows that occur twice) or if less than half of its characters that are not white space remain.

Defined results: a null, empty or blank text has 0 words and is rejected; an empty table gives an empty result;
repeated rows are judged one by one; the input's other columns are kept as they are (``clean_documents``) or
ignored (``quality_rules``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import SPACE_RX, SPACES, WORD_RX

SYMBOL_RX = r"[#*$%&|<>]"
#: Separators of navigation bars, bullets, counted things, and phrases of web furniture (lower case).
SEPARATORS = "[|>»•·/]"
SEPARATOR_RX = rf"(?<![^\x20\x09-\x0D]){SEPARATORS}(?![^\x20\x09-\x0D])"
BULLET_RX = r"^[\x20\x09-\x0D]*[-*•·–][\x20\x09-\x0D]"
COUNTER_RX = r"^[\x20\x09-\x0D]*[0-9][0-9.,]*[km]? (?:likes?|comments?|shares?|views?|replies|kommentare?|antworten|aufrufe|commentaires?|partages?|vues|comentarios?|respuestas|visitas)[\x20\x09-\x0D]*$"
MORE_RX = r"^[\x20\x09-\x0D]*(?:read more|more|next|previous|back to top|weiterlesen|mehr|weiter|zurück|nach oben|lire la suite|suite|suivant|précédent|leer más|más|siguiente|anterior|volver arriba)[\x20\x09-\x0D.…»>]*$"
BOILERPLATE = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "javascript is disabled",
    "lorem ipsum", "skip to content", "skip to main content", "sign up for our newsletter", "subscribe to our newsletter", "click here to",
    "alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren", "zum inhalt springen",
    "newsletter abonnieren", "klicken sie hier", "impressum",
    "tous droits réservés", "politique de cookies", "politique de confidentialité", "conditions d'utilisation", "activer javascript", "aller au contenu",
    "inscrivez-vous à notre newsletter", "abonnez-vous à notre", "cliquez ici", "mentions légales",
    "todos los derechos reservados", "política de cookies", "política de privacidad", "términos de uso", "condiciones de uso", "habilite javascript",
    "saltar al contenido", "suscríbete a nuestro", "haga clic aquí", "aviso legal",
]
BOILERPLATE_RX = rf"(?<!\p{{L}})(?:{'|'.join(BOILERPLATE)})"
BOILERPLATE_CHARS = 200
MIN_WORDS = 10
WINDOW = 5


def _count(text: Column, rx: str) -> Column:
    return F.regexp_count(text, F.lit(rx))


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule for punctuation, navigation or boilerplate. What is dear to tell stands
    behind a condition that few lines meet."""
    words = _count(line, WORD_RX)
    short = F.char_length(line) <= BOILERPLATE_CHARS
    marked = line.rlike(SYMBOL_RX) & (F.lit(10) * _count(line, SYMBOL_RX) > 3 * words)
    shouted = line.rlike("[!?]") & (F.lit(10) * _count(line, "[!?]") > 3 * words) & (_count(line, "[!?]") >= 3)
    wordless = ~line.rlike(r"\p{L}") & (~line.rlike(r"\p{N}") | (words <= 3))
    teaser = short & line.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$") & (words <= 12)
    bar = line.rlike(SEPARATORS) & (_count(line, SEPARATOR_RX) >= 2) & (4 * _count(line, SEPARATOR_RX) >= words)
    item = short & line.rlike(BULLET_RX) & (words <= 4) & ~line.rlike(r"[.!?][\x20\x09-\x0D]*$")
    furniture = short & F.lower(line).rlike(f"{COUNTER_RX}|{MORE_RX}|{BOILERPLATE_RX}")
    return line.rlike(WORD_RX) & (marked | shouted | wordless | teaser | bar | item | furniture)


def _solid(text: Column) -> Column:
    """Code points that are not white space."""
    return F.char_length(text) - _count(text, SPACE_RX)


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` and one struct column ``_q`` with the measures and the cleaned text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    lines = F.split(text, "\n", -1)
    worded = F.filter(lines, lambda x: x.rlike(WORD_RX))
    step = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        text.alias("_text"),
        F.when(trimmed == "", F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.split(trimmed, SPACE_RX + "+", -1), lambda w: F.xxhash64(w)))
        .alias("_h"),
        _count(text, SYMBOL_RX).alias("_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).alias("_dup"),
        F.filter(lines, lambda x: ~line_fails(x)).alias("_kept"),
    )
    # One hash for every five-word window, in order.
    step = step.select(
        "*",
        F.when(F.size("_h") < WINDOW, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])))
        .alias("_w"),
        F.array_join("_kept", "\n").alias("_clean"),
    )
    # Windows sorted by hash and position only where some hash repeats; equal neighbours are the repeats.
    step = step.select(
        "*",
        F.when(
            F.size(F.array_distinct("_w")) < F.size("_w"),
            F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_s"),
    )
    state = "struct<n:int,last:int>"
    repeated = F.sort_array(
        F.transform(
            F.filter(
                F.arrays_zip(
                    F.col("_s").alias("x"),
                    F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("_s", 1, F.greatest(F.lit(0), F.size("_s") - 1))).alias("p"),
                    F.concat(F.slice("_s", 2, F.greatest(F.lit(0), F.size("_s") - 1)), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("q"),
                ),
                lambda z: F.coalesce(z["x"]["h"] == z["p"]["h"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["q"]["h"], F.lit(False)),
            ),
            lambda z: z["x"]["i"],
        )
    )
    # Words covered by the repeated windows: each adds what lies beyond the one before it.
    covered = F.when(
        F.col("_s").isNull(), F.lit(0)
    ).otherwise(
        F.aggregate(
            repeated,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")).cast(state),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")).cast(state),
            lambda a: a["n"],
        )
    )
    n_words = F.size("_h")
    return step.select(
        "_row",
        "_text",
        "_clean",
        n_words.cast("long").alias("n_words"),
        _solid(F.col("_text")).cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_dup").cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        _solid(F.col("_clean")).cast("long").alias("kept_chars"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).withColumn(
        "kept", ~F.col("base_failed") & (2 * F.col("kept_chars") >= F.col("word_chars"))
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict for every document, with the cleaned text."""
    return _measured(docs, text_col).select(
        F.col(f"_row.{id_col}").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "kept_chars",
        "base_failed",
        "kept",
        F.col("_clean").alias("clean_text"),
    )


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their failing lines removed; the columns of ``docs``."""
    # A filter may not pass the column that is not deterministic: moved below the steps above, it would repeat them
    # inside each other.
    kept = _measured(docs, text_col).withColumn("_here", F.spark_partition_id()).filter("kept AND _here >= 0")
    return kept.select(*[(F.col("_clean") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])
