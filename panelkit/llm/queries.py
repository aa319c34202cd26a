"""One query per operator, on the whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, conversation_repair, imatch, lang_mix, line_dedup, lm_automaton, near_dup, packing, pii, quality_gam, quality_rules, url_filter, vector_codes
from .common import id_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PII_KEY = "corpus key 1"
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(text, '[ \\t-\\r]+') IF x <> ''] AS w,
  [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^ \\t-\\r]')] AS l FROM d),
starts AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM
  (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM starts JOIN (SELECT doc_id, g FROM starts GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
m AS (SELECT doc_id, text, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
  OR word_chars < 2 * n_words OR word_chars > 20 * n_words
  OR 100 * length(regexp_replace(text, '[^!?]', '', 'g')) > 50 * n_words
  OR 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 40 * word_chars
  OR 100 * length(regexp_replace(text, '\\P{L}', '', 'g')) <= 50 * word_chars
  OR 100 * len(list_distinct(w)) <= 5 * n_words) AS kept FROM b"""


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judge(table(spark, sf, "documents")).select(*cols)


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    score = quality_gam.scorer(quality_gam.learn(docs, table(spark, sf, "labels")))
    out = docs.select("doc_id", (id_mod(F.col("doc_id"), 5) == 0).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op3_url_filters")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op4_near_duplicates")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.classes(table(spark, sf, "documents"), percent=85)


@query("op5_language_id")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    predict = lang_mix.predictor(lang_mix.learn(docs))
    out = docs.select("doc_id", (id_mod(F.col("doc_id"), 4) == 2).alias("held_out"), predict(F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return lm_automaton.score(table(spark, sf, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    out = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS edited FROM n),
t AS (SELECT doc_id, 0 AS k, text AS x FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, next_text FROM e),
w AS (SELECT DISTINCT doc_id, k, w FROM (SELECT doc_id, k, unnest(regexp_split_to_array(
  translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+')) AS w FROM t) WHERE w <> ''),
lex AS (SELECT w FROM w WHERE k = 0 GROUP BY w HAVING count(*) >= {imatch.LOW} * (SELECT count(*) FROM d)
  AND count(*) <= {imatch.HIGH} * (SELECT count(*) FROM d)),
parts AS (SELECT doc_id, k, s, substr(md5(string_agg(w, ' ' ORDER BY encode(w))), 1, 8) AS part
  FROM (SELECT doc_id, k, w, unnest(range(1, {imatch.SUBSETS} + 1)) AS s FROM w SEMI JOIN lex USING (w))
  WHERE substr(md5(w), s, 2) < '04' GROUP BY ALL),
fp AS (SELECT doc_id, k, list(coalesce(part, '-') ORDER BY s) AS f FROM (SELECT doc_id, k, unnest(range(1, {imatch.SUBSETS} + 1)) AS s FROM t)
  LEFT JOIN parts USING (doc_id, k, s) GROUP BY ALL),
whole AS (SELECT doc_id, k, string_agg(w, ' ' ORDER BY encode(w)) AS words FROM w GROUP BY ALL),
fw AS (SELECT doc_id, k, f, CASE WHEN len([p FOR p IN f IF p <> '-']) = 0 THEN '=' || md5(coalesce(words, '')) ELSE array_to_string(f, '.') END AS s
  FROM fp LEFT JOIN whole USING (doc_id, k)),
f AS (SELECT doc_id, max(f) FILTER (k = 0) AS a, max(f) FILTER (k = 1) AS b, max(f) FILTER (k = 2) AS c,
  max(s) FILTER (k = 0) AS sa, max(s) FILTER (k = 1) AS sb, max(s) FILTER (k = 2) AS sc FROM fw GROUP BY 1)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, sa AS fingerprint, sb AS edited_fingerprint,
  CASE WHEN sa = sb THEN 1.0::DOUBLE ELSE len([p FOR p IN list_zip(a, b) IF p[1] = p[2] AND p[1] <> '-']) /
    greatest(len([p FOR p IN list_zip(a, b) IF p[1] <> '-' OR p[2] <> '-']), 1) END AS near_edited,
  CASE WHEN sa = sc THEN 1.0::DOUBLE ELSE len([p FOR p IN list_zip(a, c) IF p[1] = p[2] AND p[1] <> '-']) /
    greatest(len([p FOR p IN list_zip(a, c) IF p[1] <> '-' OR p[2] <> '-']), 1) END AS near_next
FROM e JOIN f USING (doc_id)"""


@query("op8_fingerprints", OP8_SQL)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    near = lambda other: imatch.likeness(F.col("fingerprint"), F.col(other))
    return imatch.match(table(spark, sf, "documents")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"),
        near("next_fingerprint").alias("near_next"),
    )


@query("op9_pii")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf, "documents").select("doc_id", "text"), PII_KEY)


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_tree.encode(table(spark, sf, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    chats = table(spark, sf, "conversations")
    rows, present = conversation_repair.damaged(chats)
    out = conversation_repair.summaries(conversation_repair.edits(rows, present=present))
    return out.withColumn("conv_id", F.when(~F.col("no_id"), F.col("conv_id").cast(dict(chats.dtypes)["conv_id"]))).drop("no_id")


@query("op12_vector_codes")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    out = vector_codes.compress(table(spark, sf, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


OP13_SQL = f"""
WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key FROM k WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
j AS (SELECT k.*, many.key IS NOT NULL AS lost FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


@query("op13_line_dedup", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
