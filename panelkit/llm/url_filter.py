"""URL verdicts from host rules, and from a model where no rule fits.

Hosts are segmented into words: every label of every distinct host is offered
all its substrings, those that occur as words of the page texts are looked up by
an equi-join, and a unigram Viterbi pass picks the best split. A multinomial
naive Bayes model over segmented host words and path tokens, learnt from the
urls that the rules judge, decides the rest.

Defined cases: a null url, or one without ``://``, has an empty host and path;
an empty host is judged by the model's prior and its path; without rule-judged
urls of both verdicts the model allows; ties allow; repeated rows are judged one
by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ascii_lower

#: (host, path, verdict)
Rule = tuple[str, str, str]
MAX_WORD = 20  # longest dictionary word considered inside a name
BUCKETS = 1 << 16  # the model hashes tokens, so its size does not depend on the data


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits columns host and path.

    For lists of a length that a person writes; it becomes one CASE.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits = fits & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def unigrams(html: DataFrame) -> DataFrame:
    """(word, n) over the visible text of column ``html``."""
    visible = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    tokens = html.select(F.explode(F.split(visible, "[^\\p{L}]+")).alias("word"))
    return tokens.filter((F.col("word") != "") & (F.length("word") <= MAX_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def best_split(label: str, found: dict[tuple[int, int], int], total: int) -> list[str]:
    """Unigram Viterbi: the most likely split; an unknown piece costs 1/total, and a tenth per character."""
    unknown, n = math.log(max(total, 1) + 1), len(label)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - MAX_WORD), end):
            count = found.get((start, end))
            p = math.log(count) - unknown if count else -unknown - (end - start) * math.log(10)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    out, end = [], n
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


def segmented_hosts(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words) for every distinct host; labels are split at dots, then into words."""
    total = words.agg(F.sum("n")).first()[0] or 0
    hosts = pages.select("host").filter(F.col("host") != "").distinct()
    names = hosts.select("host", F.posexplode(F.split("host", "\\.")).alias("k", "label"))
    labels = names.select("label").filter(F.col("label") != "").distinct()
    ends = lambda s: F.sequence(s + 1, F.least(s + MAX_WORD, F.length("label")))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.length("label") - 1), lambda s: F.transform(ends(s), lambda e: F.struct(s.alias("s"), e.alias("e")))))
    cut = labels.select("label", F.explode(spans).alias("x")).select(
        "label", "x.s", "x.e", F.substring("label", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("word")
    )
    hits = cut.join(words, "word").groupBy("label").agg(F.collect_list(F.struct("s", "e", "n")).alias("hits"))

    @F.pandas_udf("array<string>")
    def viterbi(label: pd.Series, hits: pd.Series) -> pd.Series:
        found = [{(h["s"], h["e"]): h["n"] for h in (() if x is None else x)} for x in hits]
        return pd.Series([best_split(a, b, total) for a, b in zip(label, found, strict=True)])

    split = labels.join(hits, "label", "left").select("label", viterbi("label", "hits").alias("parts"))
    parts = names.join(split, "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "parts"))).alias("all"))
    return parts.select("host", F.flatten(F.transform("all", lambda x: x["parts"])).alias("words"))


def path_tokens(path: str) -> list[str]:
    """Runs of letters, and numbers as their length and first digit."""
    return [f"{len(x)}#{x[0]}" if x.isdigit() else x for x in re.findall(r"[0-9]+|[^\W\d_]+", path.lower())]


def _bucket(token: str) -> int:
    h = 2166136261
    for b in token.encode("utf-8", "replace"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 16) % BUCKETS


def buckets(words, path: str) -> list[int]:
    host = () if words is None else words
    return [_bucket("h " + w) for w in host] + [_bucket("p " + t) for t in path_tokens(path)]


def learn_bayes(judged: DataFrame) -> tuple[float, np.ndarray] | None:
    """Prior and token log odds of block against allow, from rows (words, path, verdict) that a rule judged.

    Each task adds its rows up; the sums of two classes times ``BUCKETS`` reach the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, seen = np.zeros((2, BUCKETS + 1), np.int64), {}
        for pdf in batches:
            for w, p, v in zip(pdf["words"], pdf["path"], pdf["verdict"], strict=True):
                for b in buckets(w, p):
                    sums[int(v == "block"), b] += 1
                sums[int(v == "block"), BUCKETS] += 1
        k, b = sums.nonzero()
        yield pd.DataFrame({"k": k.astype(np.int32), "b": b.astype(np.int32), "n": sums[k, b]})

    rows = judged.mapInPandas(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((2, BUCKETS + 1))
    sums[rows["k"], rows["b"]] = rows["n"]
    if not sums[:, BUCKETS].all():
        return None
    smooth = sums[:, :BUCKETS] + 1
    share = np.log(smooth / smooth.sum(1, keepdims=True))
    return float(np.log(sums[1, BUCKETS] / sums[0, BUCKETS])), share[1] - share[0]


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, host words, rule and verdict for every row."""
    host, path = host_path(F.col(url_col).cast("string"))
    rule, verdict = longest_rule(rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    counts = cut_lineage(unigrams(pages.select(F.col(html_col).cast("string").alias("html"))))
    rows = rows.join(cut_lineage(segmented_hosts(rows, counts)), "host", "left")
    model = learn_bayes(rows.filter("verdict is not null").select("words", "path", "verdict"))

    @F.pandas_udf("string")
    def bayes(words: pd.Series, path: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(["allow"] * len(path))
        prior, odds = model
        known: dict[tuple, str] = {}

        def says(w, p: str) -> str:
            return "block" if prior + float(odds[buckets(w, p)].sum()) > 0 else "allow"

        return pd.Series([says(w, p) for w, p in zip(words, path, strict=True)])

    return rows.select("page_id", "host", "path", "words", "rule", F.coalesce("verdict", bayes("words", "path")).alias("verdict"))
