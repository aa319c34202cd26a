"""Language proportions of a document by a mixture over byte trigrams.

Training counts hashed trigrams per language over all training documents. For a
document, expectation-maximisation finds the proportions of all languages that
make its trigrams likely; then the sets made of the one, two, ... largest
proportions are fitted again, and the set with the best penalised likelihood
stays. The prediction is the largest proportion in it.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
ties go to the first language in alphabetical order; with nothing to learn from
every text is ``und``; texts shorter than three bytes are padded with spaces;
repeated rows count and are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_mod

BUCKETS = 1 << 14
PENALTY = 0.5  # of a language more, in units of log n per trigram share
OVERLAP = 3  # neighbouring trigrams share characters: n of them count as n / 3 observations
STEPS = 12


def trigrams(text: str) -> np.ndarray:
    """Hashed trigram counts of the whole text as (buckets, counts) in two rows."""
    raw = f" {text.lower()} ".encode("utf-8", "replace")
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    n = np.bincount((code * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)
    at = n.nonzero()[0]
    return np.stack([at, n[at]])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def profiles(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and trigram probabilities (bucket, language) from rows (text, lang).

    Tasks add up their rows; one row per language and bucket reaches the driver.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                at, n = trigrams(text)
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang][at] += n
        for lang, n in sums.items():
            at = n.nonzero()[0]
            yield pd.DataFrame({"lang": lang, "b": at.astype(np.int32), "n": n[at]})

    rows = docs.select("text", "lang").mapInPandas(count, "lang string, b int, n long")
    rows = rows.groupBy("lang", "b").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((BUCKETS, len(langs)), 0.5)
    table[rows["b"], [langs.index(x) for x in rows["lang"]]] += rows["n"]
    return langs, table / table.sum(0)


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` for counts ``n``, and the log likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    if p.shape[1] > 1:
        for _ in range(STEPS):
            joint = p * share
            share = share * ((n / joint.sum(1)) @ p) / total
    return share, float(n @ np.log(p @ share))


def infer(text: str, table: np.ndarray) -> np.ndarray:
    """Proportion of each language; languages outside the chosen set have 0."""
    at, n = trigrams(text)
    p = table[at]
    share, _ = mixture(p, n)
    order = np.argsort(-share, kind="stable")
    cost = PENALTY * np.log(max(n.sum(), 2)) * OVERLAP
    best, out = -np.inf, share
    for k in range(1, len(order) + 1):
        chosen = np.sort(order[:k])
        part, fit = mixture(p[:, chosen], n)
        if fit - cost * k <= best:
            break
        best, out = fit - cost * k, np.zeros(len(share))
        out[chosen] = part
    return out


def learn(docs: DataFrame, held_out: tuple[int, int] = (4, 2)) -> tuple[list[str], np.ndarray]:
    n, rest = held_out
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_mod(F.col("doc_id"), n) != rest))
    return profiles(train)


def predictor(model: tuple[list[str], np.ndarray]) -> Callable[[Column], Column]:
    """(lang, score, share per chosen language) of a text; the model's size does not depend on the data."""
    langs, table = model

    @F.pandas_udf("lang string, score double, shares map<string,double>")
    def predicted(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            if not langs or t is None or not has_letter(t):
                rows.append(("und", 0.0, {}))
                continue
            share = infer(t, table)
            k = int(share.argmax())
            rows.append((langs[k], min(1.0, float(share[k])), {langs[i]: float(share[i]) for i in share.nonzero()[0]}))
        return pd.DataFrame(rows, columns=["lang", "score", "shares"])

    return predicted
