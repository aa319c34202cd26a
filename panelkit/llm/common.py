"""Column helpers shared by the text operators.

A word is a run of characters other than space and U+0009 to U+000D. Operators
take any table plus the names of its id and text columns, use only those, and
return their own columns next to ``doc_id``, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = "[ \\t-\\r]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; a null text is an empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all else as it is; text of one-byte characters takes the short way."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACES), "")


def id_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 where the id is null."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


FILTER_BITS = 1 << 24


def may_be_in(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``_may``: false where the key is surely not among the hashes ``wanted.h``.

    A Bloom filter of ``FILTER_BITS`` bits with one hash, built by partial ORs. It is
    a table of at most ``FILTER_BITS`` / 64 rows, however many keys there are, so
    it can be broadcast; with very many keys it lets more rows pass, never fewer.
    """
    bit = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    words = wanted.select((bit / 64).cast("int").alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(h, {FILTER_BITS}) % 64 as int))").alias("b"))
    words = words.groupBy("_word").agg(F.bit_or("b").alias("_bits"))
    at = F.pmod(key, F.lit(FILTER_BITS))
    out = rows.withColumns({"_word": (at / 64).cast("int"), "_bit": (at % 64).cast("int")}).join(F.broadcast(words), "_word", "left")
    may = F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False))
    return out.withColumn("_may", may).drop("_word", "_bit", "_bits")
