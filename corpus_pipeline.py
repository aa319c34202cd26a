"""A training-text pipeline over the documents table: five stages, each on all that the one before kept.

Every stage is written as Parquet and read again as the next one's documents.
Stages but the last return the columns of documents. Null and empty texts go at
the language stage; an empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import lang_mix, near_dup, packing, pii, quality_gam
from panelkit.llm.common import may_be_in
from panelkit.llm.queries import PII_KEY
from panelkit.session import Scratch, cut_lineage, drop_table

MIN_QUALITY = 0.3
MIN_SHARE = 0.4  # of the main language; below it a text is a mixture of many
NEAR_PERCENT = 80  # shingles shared by near duplicates; op4_near_duplicates has its own 85


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below ``MIN_QUALITY``."""
    score = quality_gam.scorer(quality_gam.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.filter(score(F.col("text")) >= MIN_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those of which no language has ``MIN_SHARE``."""
    predict = lang_mix.predictor(lang_mix.learn(docs))
    return docs.filter(predict(F.col("text"))["score"] >= MIN_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: with the smallest id, a null id being the largest, then with the smallest hash of its text.

    Rows are known by their id and their text, and equal texts are one document
    for the search, whatever their ids. Texts without a word are all kept.
    """
    scratch = Scratch()
    # the row is one column, so that none of its columns can clash with a key
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    ids = docs.filter(F.col("text").rlike("[^ \\t-\\r]")).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    ids = scratch.keep(ids)  # read twice, without the texts
    texts = docs.select(F.xxhash64("text").alias("hash"), "text")
    found = near_dup.classes(texts, id_col="hash", percent=NEAR_PERCENT).filter("not kept and n_shingles > 0")
    # written, so that the joins are planned by the number of rows that go
    moved = scratch.keep(found.select(F.col("doc_id").alias("hash"), F.col("component_id").alias("to")).distinct())
    ids = ids.join(moved, "hash", "left").withColumn("to", F.coalesce("to", "hash"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    best = ids.groupBy("to").agg(F.min(order).alias("best"), F.count("*").alias("n")).filter("n > 1").drop("n")
    many = scratch.keep(ids.join(scratch.keep(best), "to").withColumn("first", order == F.col("best")).groupBy("id", "hash", "first").count())
    gone = cut_lineage(many.filter("not first or count > 1").select(F.col("id").alias("gone"), F.col("hash").alias("gone_hash")))
    twice = cut_lineage(many.filter("first and count > 1").select(F.col("id").alias("gone"), F.col("hash").alias("gone_hash")))
    scratch.drop()
    same = F.col("id").eqNullSafe(F.col("gone")) & (F.col("hash") == F.col("gone_hash"))
    # a row whose key is surely not among those that go stays where it is; a null text has no row among them
    rows = may_be_in(rows, F.coalesce("hash", F.lit(0)), gone.select(F.col("gone_hash").alias("h")))
    out = rows.filter("not _may").select("row.*")
    out = out.union(rows.filter("_may").join(gone.hint("shuffle_hash"), same, "left_anti").select("row.*"))
    if twice.limit(1).count():
        again = rows.filter("_may").join(twice.hint("shuffle_hash"), same, "left_semi")
        out = out.union(again.groupBy("id", "hash").agg(F.max_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return out


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same length or format; ``n_chars`` follows the text."""
    out = pii.pseudonymised(docs, PII_KEY)
    return out.withColumn("n_chars", F.when(F.size("pii_kinds") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 for training."""
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Trained models and tokenizers decide the rows, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        drop_table(*before)
        before = [docs]
    return docs
