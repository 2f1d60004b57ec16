"""Entities, entries and one nested record for each document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.islands import carry_last, island, ordered, ordered_text
from docweave.operators.fields import entity

LINKS = ["LINKEDIN", "GITHUB", "OTHER_LINK", "EMAIL"]


def extract_entities(tokens: DataFrame, label: str = "bio_label", *least: str) -> DataFrame:
    """(doc_id, entity_id, label, value) of every labelled run, without spaces in links and before punctuation; and the
    least value of each column of ``least`` among its tokens."""
    w = ordered()
    own = F.when(F.col(label) != "O", entity(F.col(label)))
    starts = F.col(label).startswith("B-") | ((F.col(label) != "O") & F.coalesce(entity(F.lag(label).over(w)) != own, F.lit(True)))
    runs = island(tokens.withColumn("own", own), starts, w, "entity_id").filter("own IS NOT NULL")
    rows = runs.groupBy("doc_id", "entity_id").agg(F.min("own").alias("label"), ordered_text().alias("raw"), *[F.min(c).alias(c) for c in least])
    value = F.when(F.col("label").isin(LINKS), F.regexp_replace("raw", " ", "")).otherwise(F.regexp_replace("raw", " ([,.;:!?])", "$1"))
    return rows.select("doc_id", "entity_id", "label", F.regexp_replace(value, "(https?) ?: ?// ?", "$1://").alias("value"), *least)


def heading_list(entities: DataFrame) -> DataFrame:
    """Headings of each document, the first of those that differ in case only."""
    first = F.row_number().over(ordered(("doc_id", "folded"), ("entity_id",)))
    heads = entities.filter("label = 'HEADING'").withColumn("folded", F.upper("value")).withColumn("r", first).filter("r = 1")
    return heads.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "value"))), lambda r: r["value"]).alias("headings"))


def marks_column(tokens: DataFrame) -> DataFrame:
    """A number and the unlabelled % after it are one mark."""
    w = ordered(("doc_id", "page", "line_index"), ("x0",))
    before_it = F.lag("token").over(w)
    hit = (F.col("token") == "%") & before_it.rlike("^[0-9]+([.][0-9]+)?$")
    return tokens.withColumn("gpa", F.when(hit, F.concat(before_it, F.lit("%")))).filter("gpa IS NOT NULL")


def entries_flat(entities: DataFrame) -> DataFrame:
    """Fields of entries as rows (doc_id, entry, pos, label, value): the oracle-friendly form of nested entries."""
    return entities.withColumn("pos", (F.row_number().over(ordered(("doc_id", "entry"), ("entity_id",))) - 1).cast("int")).select("doc_id", "entry", "pos", "label", "value")


def entries_array(flat: DataFrame) -> DataFrame:
    """Nested entries: an array of arrays of label and value for each document."""
    per = flat.groupBy("doc_id", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label", "value"))), lambda r: F.struct(r["label"].alias("label"), r["value"].alias("value"))).alias("fields"))
    return per.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "fields"))), lambda r: r["fields"]).alias("entries"))


def skills_distinct(entities: DataFrame) -> DataFrame:
    rows = entities.filter("label = 'SKILL'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "value"))).alias("r"))
    return rows.select("doc_id", F.array_distinct(F.transform("r", lambda x: x["value"])).alias("skills"))


def build_record(documents: DataFrame, entities: DataFrame, labels: list[str]) -> DataFrame:
    """One row per document with an array of values for each label; null where there is none."""
    ordered_values = F.array_sort(F.collect_list(F.struct("entity_id", "value")))
    each = entities.filter(F.col("label").isin(labels)).groupBy("doc_id").pivot("label", labels).agg(F.transform(ordered_values, lambda r: r["value"]))
    columns = [F.when(F.size(c) > 0, F.array_join(c, "; ")).alias(c.lower()) for c in labels]
    return documents.select("doc_id").join(each, "doc_id", "left").select("doc_id", *columns)


def predicted_fields(tokens: DataFrame) -> DataFrame:
    """Runs of one label as field rows with the confidence of their first token."""
    w = ordered()
    own = entity(F.col("bio_label"))
    runs = island(tokens.withColumn("own", own), F.coalesce(own != F.lag(own).over(w), F.lit(True)), w, "field")
    kept = runs.filter("own <> 'O'")
    return kept.groupBy("doc_id", "field").agg(F.min("own").alias("label"), ordered_text().alias("value"), F.min_by("confidence", F.struct("page", "line_index", "token_index")).alias("confidence"))


def skill_groups(entities: DataFrame) -> DataFrame:
    """Skills under the last skill type before them."""
    w = ordered(("doc_id",), ("entity_id",))
    typed = entities.filter("label IN ('SKILL', 'SKILL_TYPE')").withColumn("type", carry_last(F.when(F.col("label") == "SKILL_TYPE", F.col("value")), w))
    return typed.filter("label = 'SKILL'").groupBy("doc_id", "type", "value").agg(F.min("entity_id").alias("first_at"))


def fold_fields(flat: DataFrame) -> DataFrame:
    """Entries as rows with one column for each field; start and end of a date joined."""
    wide = flat.groupBy("doc_id", "entry").pivot("label", ["ROLE", "DATE", "DESC"]).agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "value")))["value"], " "))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return wide.select("doc_id", "entry", blank("ROLE").alias("role"), F.regexp_replace(blank("DATE"), " ?[-–] ?", " - ").alias("dates"), blank("DESC").alias("description"))


def fallback_regroup(entities: DataFrame) -> DataFrame:
    """Entries of flat entities without heads: a new role or degree begins one."""
    w = ordered(("doc_id",), ("entity_id",))
    return island(entities, F.col("label").isin("ROLE", "DEGREE", "PROJECT_NAME"), w, "entry")


def profile_numbering(entities: DataFrame) -> DataFrame:
    """``key n`` where a document has several values of a key."""
    n, k = F.count("*").over(ordered(("doc_id", "label"), ())), F.row_number().over(ordered(("doc_id", "label"), ("entity_id",)))
    return entities.withColumn("n", n).withColumn("k", k).withColumn("key", F.when(F.col("n") > 1, F.concat_ws(" ", F.lower("label"), F.col("k").cast("string"))).otherwise(F.lower("label"))).drop("n", "k")


CLEANING = [(r"^[•◦●▪*–\-\s]+", ""), (r"[|,;\s]+$", ""), (r"\s+", " "), (r"\s+([,.;:!?])", "$1"), (r"(https?) ?: ?// ?", "$1://")]


def clean_text(text: Column) -> Column:
    """Without leading bullets and trailing separators, single spaces, URLs in one piece."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), CLEANING, text)


def clean_contact(label: Column, value: Column) -> Column:
    """Handles become URLs."""
    bare = F.regexp_replace(value, "^(https?://)?(www[.])?", "")
    return F.when(label.isin("GITHUB", "LINKEDIN"), F.concat(F.lit("https://"), bare)).when(label == "EMAIL", F.lower(F.regexp_replace(value, "[.,;]+$", ""))).otherwise(value)
