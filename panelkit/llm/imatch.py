"""I-Match fingerprints over a lexicon of mid-frequency terms, in DataFrame functions only.

A term is a word with A-Z lower-cased. The lexicon holds the terms that occur in
at least ``LOW`` and at most ``HIGH`` of all documents, a band of inverse
document frequency. Every document counts. As the documents have a mean number m
of distinct terms, at most m / ``LOW`` terms can be in the band, however large
the corpus: that bounds the lexicon that is sent with the job.

``SUBSETS`` randomised lexicons keep one term in 64 of the band each, chosen by
two digits of a term's digest: so few that a part survives an edit elsewhere. A fingerprint has one part per subset: the digest of
the document's sorted distinct terms in it, or ``-`` if it has none. A document
without any part has the digest of all its distinct terms instead, behind ``=``, so
that texts of other terms never share a fingerprint. Likeness is 1
for equal fingerprints, else the share of equal parts among those that either has.

Defined cases: null and empty texts have the digest of no terms; repeated
rows count in the frequencies and are fingerprinted each; an empty table gives an
empty result; a document that is alone is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import ascii_lower, id_text, words

LOW, HIGH = 0.02, 0.2
SUBSETS = 24
RUN = 1024  # ids per run of neighbours


def terms(text: Column) -> Column:
    return F.array_distinct(words(ascii_lower(text)))


def lexicon(rows: DataFrame, low: float = LOW, high: float = HIGH) -> list[str]:
    """Terms in the band, sorted; counted over all rows, with partial sums before the shuffle."""
    n = rows.count()
    df = rows.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.filter((F.col("df") >= low * n) & (F.col("df") <= high * n))
    return sorted(r["term"] for r in band.select("term").collect())


def in_band(text: Column, lex: list[str]) -> Column:
    """The sorted distinct terms of a text that are in the lexicon, each with its digest."""
    band = F.array_intersect(words(ascii_lower(text)), F.lit(lex) if lex else F.array().cast("array<string>"))
    return F.transform(F.sort_array(band), lambda t: F.struct(t.alias("t"), F.md5(t.cast("binary")).alias("d")))


def parts(found: Column) -> Column:
    """The part of each subset, from the sorted terms with their digests."""

    def part(k: int) -> Column:
        # a term is in subset k if digits k and k + 1 of its digest are 00 to 03
        kept = F.transform(F.filter(found, lambda x: F.substring(x["d"], k + 1, 2) < "04"), lambda x: x["t"])
        return F.when(F.size(kept) > 0, F.substring(F.md5(F.array_join(kept, " ").cast("binary")), 1, 8)).otherwise("-")

    return F.concat_ws(".", *[part(k) for k in range(SUBSETS)])


def with_fingerprint(rows: DataFrame, text: str, name: str, lex: list[str]) -> DataFrame:
    """Adds the fingerprint of a text column: its parts or, if no subset has a term of it, the digest of all its terms."""
    out = rows.withColumn("found", in_band(F.col(text), lex)).withColumn("_parts", parts(F.col("found")))
    whole = F.concat(F.lit("="), F.md5(F.array_join(F.sort_array(terms(F.col(text))), " ").cast("binary")))
    none = F.lit(".".join(["-"] * SUBSETS))
    return out.withColumn(name, F.when(F.col("_parts") == none, whole).otherwise(F.col("_parts"))).drop("found", "_parts")


def likeness(a: Column, b: Column) -> Column:
    x, y = F.split(a, "\\."), F.split(b, "\\.")
    pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] != "-") | (p["y"] != "-"))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(a == b, 1.0).otherwise(same / F.greatest(F.size(pairs), F.lit(1)))


def next_runs(runs: DataFrame) -> DataFrame:
    """(run, next): the next lower run number; the lowest one's next is the highest.

    Range partitions are sorted on their own; only one row per partition is
    brought together to join their ends.
    """
    ranged = cut_lineage(runs.distinct().repartitionByRange("run").withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("lower", F.lag("run").over(Window.partitionBy("part").orderBy("run")))
    ends = ranged.groupBy("part").agg(F.max("run").alias("high"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("high").over(Window.orderBy("part")), F.max("high").over(every)).alias("below"))
    return inside.join(ends, "part").select("run", F.coalesce("lower", "below").alias("next"))


def with_next(rows: DataFrame, lex: list[str]) -> DataFrame:
    """Rows with their fingerprint, and text and fingerprint of the next row in descending order of the id.

    A run of ``RUN`` ids is put together, so each text moves once; a copy of the
    next run's first row closes each run. Null ids come last, spread by a hash
    of the text; equal ids are ordered by text.
    """
    spread = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("doc_id") / RUN).cast("long"), spread))
    tops = cut_lineage(rows.groupBy("run").agg(F.max("doc_id").alias("top")))
    first = rows.join(tops.withColumnRenamed("run", "r"), (F.col("run") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("top")))
    first = first.groupBy(F.col("run").alias("next")).agg(F.max("text").alias("text"))
    closing = next_runs(tops.select("run")).join(first, "next")
    kind = dict(rows.dtypes)["doc_id"]
    closing = closing.select(F.lit(None).cast(kind).alias("doc_id"), "text", "run", F.lit(True).alias("copy"))
    both = rows.select("doc_id", "text", "run", F.lit(False).alias("copy")).union(closing)
    both = with_fingerprint(both, "text", "fingerprint", lex)
    w = Window.partitionBy("run").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    both = both.withColumns({"next_text": F.lead("text").over(w), "next_fingerprint": F.lead("fingerprint").over(w)})
    return both.filter(~F.col("copy")).drop("run", "copy")


def match(docs: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, edited, and fingerprints of the text, the edited text and the next text.

    The edited text is the first half, then as many characters of the next text
    as the second half had.
    """
    rows = id_text(docs, id_col, text_col)
    lex = lexicon(rows, low, high)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = with_next(rows, lex).withColumn("edited", edited).drop("next_text")
    return with_fingerprint(out, "edited", "edited_fingerprint", lex)
