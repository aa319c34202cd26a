"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``measure`` counts, ``order_rules`` times every rule on a sample and puts the
rules in order of rejections per second, ``cascade`` evaluates them as one CASE:
a document that a rule rejects never reaches the rules behind it.

Defined cases: null and empty texts have zero counts and fail the base rule;
repeated rows are judged one by one; an empty table gives an empty result; the
order of rules changes the work and the name of the rule, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, words

WINDOW = 5
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``fails`` builds the test from the columns of ``measure``."""

    name: str
    fails: Callable[[], Column]


def _count(pattern: str) -> Column:
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


def _mostly(part: Column, whole: Column, percent: int) -> Column:
    return 100 * part > percent * whole


BASE = Rule("base", lambda: (F.col("n_words") < 10) | _mostly(F.col("n_repeat_words"), F.col("n_words"), 20))
#: Shares are set so that a page must be unlike prose as a whole, not in one line.
RULES = [
    Rule("symbols", lambda: _mostly(F.col("n_symbols"), F.col("word_chars"), 10)),
    Rule("repeated_lines", lambda: _mostly(F.col("n_dup_lines"), F.col("n_lines"), 30)),
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("exclamations", lambda: _mostly(_count("[!?]+"), F.col("n_words"), 50)),
    Rule("capitals", lambda: _mostly(_count("[A-Z]+"), F.col("word_chars"), 40)),
    Rule("few_letters", lambda: _mostly(_count("\\p{L}+"), F.col("word_chars"), 50) == F.lit(False)),
    Rule("few_distinct_words", lambda: _mostly(F.size(F.array_distinct("w")), F.col("n_words"), 5) == F.lit(False)),
]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, plus text and words ``w``.

    Windows of five words are compared by 64-bit hash. Only a document that
    repeats a window pays for the sort that finds the words such windows cover.
    """
    w, h, a, p = F.col("w"), F.col("h"), F.col("a"), F.col("p")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    out = id_text(docs, id_col, text_col).select("doc_id", "text", words(F.col("text")).alias("w"), lines.alias("l"))
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    out = out.select(
        "doc_id",
        "text",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("a", F.when(F.size(F.array_distinct(h)) < F.size(h), by_hash)).drop("h")
    same = lambda k: F.get(a, k)["h"].eqNullSafe(F.get(a, k - 1)["h"]) | F.get(a, k)["h"].eqNullSafe(F.get(a, k + 1)["h"])
    twice = F.filter(F.sequence(F.lit(0), F.size(a) - 1), same)
    out = out.withColumn("p", F.when(a.isNotNull(), F.sort_array(F.transform(twice, lambda k: F.get(a, k)["i"])))).drop("a")
    steps = F.sequence(F.lit(1), F.size(p) - 1)
    covered = F.aggregate(steps, F.lit(WINDOW), lambda s, k: s + F.least(F.lit(WINDOW), F.get(p, k) - F.get(p, k - 1)))
    return out.withColumn("n_repeat_words", F.coalesce(F.when(p.isNotNull(), covered), F.lit(0)).cast("long")).drop("p")


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows from all over the table, for the estimates of ``order_rules`` only."""
    n = docs.count()
    return docs.sample(rows / n, seed=1) if n > rows else docs


def order_rules(measured: DataFrame, rules: list[Rule] = RULES) -> list[Rule]:
    """Rules by rejections per second on a measured sample, each counted on what those before it keep.

    The cascade itself runs over every row. Equal ratios keep the given order.
    """
    sample = measured.persist()
    try:
        sample.count()
        cost = {}
        for r in rules:
            start = time.perf_counter()
            sample.select(r.fails().alias("x")).agg(F.count_if("x")).collect()
            cost[r.name] = max(time.perf_counter() - start, 1e-6)
        verdicts = sample.select(*[F.coalesce(r.fails(), F.lit(False)).alias(r.name) for r in rules])
        groups = [(row, row["n"]) for row in verdicts.groupBy(*[r.name for r in rules]).agg(F.count("*").alias("n")).collect()]
    finally:
        sample.unpersist()
    left, order = list(rules), []
    while left:
        best = max(left, key=lambda r: sum(n for row, n in groups if row[r.name]) / cost[r.name])
        order.append(best)
        left.remove(best)
        groups = [(row, n) for row, n in groups if not row[best.name]]
    return order


def cascade(measured: DataFrame, order: list[Rule], first: Rule = BASE) -> DataFrame:
    """base_failed, kept and the first rule that rejects (null: none)."""
    chain = F.when(F.col("base_failed"), F.lit(first.name))
    for r in order:
        chain = chain.when(r.fails(), F.lit(r.name))
    out = measured.withColumn("base_failed", first.fails()).withColumn("rejected_by", chain)
    return out.withColumn("kept", F.col("rejected_by").isNull())


def judge(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measure, order by sample, and apply the cascade to every row."""
    order = order_rules(measure(sampled(docs), id_col, text_col), rules)
    return cascade(measure(docs, id_col, text_col), order)
