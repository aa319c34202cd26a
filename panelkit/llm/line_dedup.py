"""Lines that many documents share, found by range-partitioned hashes, in DataFrame functions only.

The key of a line is the line without the spaces at its ends, A-Z lower-cased.
``lines`` writes one slim row per line: two 64-bit hashes of its key, the document
and the position. ``dropped`` range-partitions those rows by hash, sorts them by
document and position behind the hash, and streams the first occurrences: the
number of documents of a key is the number of rows whose document differs from
the row before. What goes back to the documents are not texts but keep bitmaps,
64 lines a word; words of which every line stays are left out.

A key with a large share of all lines would make one partition of its own. Such
keys are settled first: a key that ``min_docs`` documents of a sample of lines
have is surely dropped, so its lines go straight to the bitmaps. At most
``HOT_KEYS`` are, the most frequent ones; all others take the general way, so the
sample moves work but never a result.

Defined cases: a null or empty text is one empty line; an empty key is never
dropped if ``min_chars`` is 1 or more; a document is a pair of id and text, so
rows that repeat both count once and each loses the same lines; rows with null
ids count by their texts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import ascii_lower, id_text

MIN_DOCS, MIN_CHARS = 10, 1
BLANKS = " \t\n\x0b\x0c\r"
SAMPLE_LINES, HOT_KEYS = 200_000, 1000


def with_text_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))


def lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, th, pos): every line with a key of ``min_chars`` code points or more."""
    split = F.posexplode(F.split(ascii_lower(F.col("text")), "\n")).alias("pos", "line")
    out = rows.select("doc_id", "th", split).withColumn("key", F.trim("line", F.lit(BLANKS)))
    out = out.filter(F.length("key") >= min_chars)
    return out.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "th", "pos")


def hot_keys(found: DataFrame, min_docs: int = MIN_DOCS, sample_lines: int = SAMPLE_LINES, most: int = HOT_KEYS) -> DataFrame:
    """(h1, h2): the keys with the most documents in a sample of the lines, each with ``min_docs`` or more."""
    n = found.count()
    some = found.sample(sample_lines / n, seed=1) if n > sample_lines else found
    docs = some.groupBy("h1", "h2", "doc_id", "th").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    top = docs.filter(F.col("n") >= min_docs).orderBy(F.col("n").desc(), "h1", "h2").limit(most)
    return cut_lineage(top.select("h1", "h2"))


def dropped(found: DataFrame, min_docs: int = MIN_DOCS, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """(doc_id, th, pos) of the lines whose keys ``min_docs`` documents or more have."""
    hot = F.broadcast(hot_keys(found, min_docs, sample_lines))  # at most HOT_KEYS rows
    surely = found.join(hot, ["h1", "h2"], "left_semi")
    rest = found.join(hot, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
    key = Window.partitionBy("h1", "h2")
    by_doc = key.orderBy("doc_id", "th", "pos")
    here = F.struct("doc_id", "th")
    first = ~F.lag(here).over(by_doc).eqNullSafe(here)
    rest = rest.withColumn("first", first.cast("long")).withColumn("docs", F.sum("first").over(key))
    return surely.select("doc_id", "th", "pos").union(rest.filter(F.col("docs") >= min_docs).select("doc_id", "th", "pos"))


def keep_bitmaps(gone: DataFrame) -> DataFrame:
    """(doc_id, th, keep): per document, sorted (word, bits) for each 64 lines that lose some; bit i of a word is 1 if line 64 * word + i stays."""
    words = gone.groupBy("doc_id", "th", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits")
    )
    return words.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def every_word(keep: Column) -> Column:
    """The bitmap with its left-out words filled in, up to the last one listed."""
    before = lambda i: F.coalesce(F.get(keep, i - 1)["word"], F.lit(-1))
    fill = lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), x["word"] - before(i) - 1), F.array(x["bits"]))
    return F.flatten(F.transform(keep, fill))


def dedup(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, sample_lines: int = SAMPLE_LINES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, text, keep, n_lines, n_dropped and kept_text, one row per input row; ``keep`` is null where all lines stay."""
    rows = with_text_hash(docs, id_col, text_col)
    found = cut_lineage(lines(rows, min_chars))
    maps = keep_bitmaps(dropped(found, min_docs, sample_lines)).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    out = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    lost = F.aggregate("keep", F.lit(0), lambda s, x: s + 64 - F.bit_count(x["bits"]))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    out = out.select(
        "doc_id", "text", "keep", every_word(F.col("keep")).alias("bits"), n_lines.cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"),
    )
    # two uses of "bits" keep it a column of its own: it is computed once per document, not once per line
    word = lambda i: F.get("bits", F.floor(i / 64).cast("int"))
    stays = lambda x, i: word(i).isNull() | (F.getbit(word(i), i % 64) == 1)
    kept = F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    return out.withColumn("kept_text", F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept)).drop("bits")
