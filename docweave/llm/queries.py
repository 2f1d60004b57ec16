"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import ann, bpe, hard_negatives, language_id, line_dedup, lm_scoring, mil_quality, ngram_join, packing, prefix_trie, quality, sharding, toxicity
from docweave.llm.shared import table, train_fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = train_fold(F.col("doc_id"), 5) == 0
    model = language_id.fit(docs.filter(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "_language.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("spam"), F.col("toxic").alias("toxic"))
    chain = toxicity.fit(docs.join(labels, "doc_id"), ["spam", "toxic"])
    return toxicity.predict(docs, chain).select("doc_id", "_toxicity.*")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return bpe.decode_documents(encoded, vocabulary).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents")).drop("line_id", "class_id", "text_key", "first_text_key")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = train_fold(F.col("doc_id"), 7) == 2
    scores = lm_scoring.lm_scores(table(spark, sf_dir, "documents"), ~held_out)
    return scores.withColumn("held_out", ~F.col("learn")).drop("learn")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = train_fold(F.col("doc_id"), 5) == 0
    model = mil_quality.fit(docs.filter(~held_out).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"))
    scored = mil_quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_quality").alias("score"), (F.col("_quality") >= 0.3).cast("int").alias("predicted"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.spliced(lists, F.col("conv_id") - F.col("conv_id") % 5, train_fold(F.col("conv_id"), 9), most=8))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_bpe": op4_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_ngram_join": op7_ngram_join,
    "op8_nearest": op8_nearest,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS s FROM g), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * c >= 90 * (len(x.g) + len(y.g) - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, label) AS (SELECT doc_id, doc_id FROM g UNION SELECT e.a, r.label FROM r JOIN e ON e.b = r.node)
SELECT g.doc_id, CAST(any_value(len(g.g)) AS BIGINT) AS n_shingles, min(r.label) AS component_id FROM g JOIN r ON r.node = g.doc_id GROUP BY g.doc_id
""",
    "op5_line_dedup": r"""
WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
l AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM s),
o AS (SELECT *, CAST(length(line) AS INT) AS n_chars FROM l WHERE line <> ''),
u AS (SELECT line, n_chars, row_number() OVER (ORDER BY min((doc_id, line_no))) AS id FROM o GROUP BY ALL),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON b.n_chars BETWEEN a.n_chars - 2 AND a.n_chars + 2 AND a.id <> b.id
      WHERE a.n_chars >= 24 AND b.n_chars >= 24 AND levenshtein(a.line, b.line) <= 2),
r(node, label) AS (SELECT id, id FROM u UNION SELECT e.a, r.label FROM r JOIN e ON e.b = r.node),
c AS (SELECT node, min(label) AS label FROM r GROUP BY node),
k AS (SELECT o.doc_id, o.line_no, o.n_chars, c.label FROM o JOIN u USING (line) JOIN c ON c.node = u.id),
f AS (SELECT *, min((doc_id, line_no)) OVER (PARTITION BY label) AS f FROM k)
SELECT doc_id, line_no, n_chars, f[1] AS first_doc_id, f[2] AS first_line_no, (doc_id, line_no) = f AS keep FROM f
""",
    "op10_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS t FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM
      (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d),
lm AS (SELECT doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS nw,
       len(regexp_extract_all(x, '[#*$%&|<>]')) AS ns,
       len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y IN ('|', '>', '»', '•', '·', '/'))) AS sep,
       len(regexp_extract_all(x, '[!?]')) AS nx, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS solid FROM l),
lk AS (SELECT doc_id, sum(CASE WHEN nw > 0 AND (10 * ns > 3 * nw OR (nx >= 3 AND 10 * nx > 3 * nw)
       OR (NOT regexp_matches(x, '\p{L}') AND (nw <= 3 OR NOT regexp_matches(x, '\p{N}')))
       OR (sep >= 2 AND 4 * sep >= nw)
       OR (length(x) <= 200 AND ((nw <= 12 AND regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))
         OR (nw <= 4 AND regexp_matches(x, '__BULLET__') AND NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*$'))
         OR regexp_matches(lower(x), '__COUNTER__') OR regexp_matches(lower(x), '__MORE__') OR regexp_matches(lower(x), '(?:^|[^\p{L}])(?:__BOILERPLATE__)')))) THEN 0 ELSE solid END) AS kept_chars FROM lm GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(lk.kept_chars AS BIGINT) AS kept_chars
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN lk USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * kept_chars >= word_chars AS kept FROM b
""".replace("__BOILERPLATE__", "|".join(quality.BOILERPLATE).replace("'", "''"))
    .replace("__BULLET__", quality.BULLET_RX)
    .replace("__COUNTER__", quality.COUNTER_RX)
    .replace("__MORE__", quality.MORE_RX),
    "op12_prefix_trie": r"""
WITH o AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS t,
     list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps
     FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, t, xor(list_reduce(steps, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 9 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.t, []), 1, h.h), list_slice(h.t, h.h + 1, len(h.t))) AS t FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, d, len(t) = d AS ends, sha256(CAST(to_json(list_slice(t, 1, d)) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN strlen(t[d].t) ELSE 0 END AS size
     FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM r)),
g AS (SELECT k, d, min(conv_id) AS c, count(*) AS n, any_value(size) AS size, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS e FROM m GROUP BY k, d),
u AS (SELECT g.*, p.k AS pk FROM g LEFT JOIN m p ON p.conv_id = g.c AND p.d = g.d - 1),
n AS (SELECT u.*, coalesce(x.n, 0) AS children FROM u LEFT JOIN (SELECT pk, count(*) AS n FROM u GROUP BY pk) x ON x.pk = u.k),
s AS (SELECT m.k, count(*) FILTER (WHERE n.children = 0) AS leaves, sum((n.n - 1) * n.size) AS saved FROM n JOIN m ON m.conv_id = n.c AND m.d <= n.d GROUP BY m.k)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, p.c AS parent_conv_id, n.n AS n_convs, n.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.e) AS ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN g p ON p.k = n.pk
""",
    "op13_hard_negatives": r"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
       list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS arow, a.id AS anchor_id, a.label AS alabel, c.row, c.id, c.label,
       CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v c ON a.row <> c.row WHERE a.id % 50 = 0),
p AS (SELECT arow, anchor_id, row AS prow, id AS positive_id, score AS positive_score FROM s WHERE label = alabel
      QUALIFY row_number() OVER (PARTITION BY arow ORDER BY score DESC, id, row) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.arow, prow ORDER BY s.score DESC, s.id, s.row) AS rank
      FROM p JOIN s ON s.arow = p.arow AND s.label <> s.alabel AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""",
}
