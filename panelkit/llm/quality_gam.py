"""Quality score by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Shallow trees, boosted in turn over the
features, add up to one lookup table per feature; then the pairs of features
that explain most of what is left get a two-way table each. A score is the sum
of table entries through the logistic function.

The model is fitted on a bounded sample of labelled rows (``max_rows``, chosen by
a hash of the id); texts are scored whole. Defined cases: null and empty texts
have zero features and a score like any other; without labels, or with one label
value only, every text gets the smoothed share of label 1; repeated rows are
scored one by one; repeated labels of one id count once (the largest).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_mod, id_text

MAX_ROWS = 20_000
FEATURES = [
    "log_words", "word_length", "capitals", "symbols", "exclamations", "digits", "stops", "distinct_words",
    "top_word", "distinct_pairs", "repeated_lines", "line_words", "short_words", "longest_word", "ascii", "pipes",
]


def features(texts: list[str]) -> np.ndarray:
    """One row of numbers per text, each from the whole text."""
    out = np.zeros((len(texts), len(FEATURES)))
    capitals, symbols, digits = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&<>=_~^\\{}[]@", "0123456789"))
    for row, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        words = raw.split()
        n = len(words)
        if not n:
            continue
        size = sum(map(len, words))
        share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[row] = (
            np.log1p(n), size / n, share(capitals), share(symbols), share(b"!?"), share(digits), share(b".,;:"),
            len(counts) / n, max(counts.values()) / n, len(set(zip(words, words[1:], strict=False))) / n,
            1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(len(w) < 4 for w in words) / n,
            np.log1p(max(map(len, words))), len(raw.decode("utf-8", "replace")) / len(raw), share(b"|"),
        )
    return out


@dataclass
class Additive:
    """Cut points, one table per feature, and one two-way table per chosen pair."""

    start: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin of a feature to its bin in pairs
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        at = self.bins(x)
        for table, b in zip(self.tables, at, strict=True):
            total += table[b]
        for (i, j), table in self.pairs.items():
            total += table[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A depth-limited tree over ordered bins, as one value per bin."""
    value = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth and len(g) > 1:
        gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            value[:k], value[k:] = _tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)
    return value


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best split of a two-way table into four quarters, and its gain."""
    quarter = lambda x, a, b: np.array([[x[:a, :b].sum(), x[:a, b:].sum()], [x[a:, :b].sum(), x[a:, b:].sum()]])
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gain = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
    for c, d in ((cg, ch),):
        tl, hl = c[:-1, :-1], d[:-1, :-1]
        tr, hr = c[:-1, -1:] - tl, d[:-1, -1:] - hl
        bl, hb = c[-1:, :-1] - tl, d[-1:, :-1] - hl
        br, hq = c[-1, -1] - tl - tr - bl, d[-1, -1] - hl - hr - hb
        gain = sum(x**2 / (y + 1) for x, y in ((tl, hl), (tr, hr), (bl, hb), (br, hq)))
    a, b = (int(k) + 1 for k in np.unravel_index(gain.argmax(), gain.shape))
    leaves = _leaf(quarter(g, a, b), quarter(h, a, b))
    rows, cols = (np.arange(g.shape[0]) >= a).astype(int), (np.arange(g.shape[1]) >= b).astype(int)
    return leaves[np.ix_(rows, cols)], float(gain.max() - g.sum() ** 2 / (h.sum() + 1))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, n_bins: int = 32, n_pairs: int = 6) -> Additive:
    """Cyclic boosting over features, then over the strongest pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(start=float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    for j in range(x.shape[1]):
        model.cuts.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])))
        model.tables.append(np.zeros(len(model.cuts[-1]) + 1))
        model.coarse.append(np.arange(len(model.cuts[-1]) + 1) * 8 // (len(model.cuts[-1]) + 1))
    at = model.bins(x)
    total = np.full(len(y), model.start)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(at):
            g, h = residual()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[j] += step
            total += step[b]
    grid = [c[b] for c, b in zip(model.coarse, at, strict=True)]

    def two_way(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(grid[i] * 8 + grid[j], v, 64).reshape(8, 8)

    g, h = residual()
    gains = {(i, j): _cross(two_way(i, j, g), two_way(i, j, h))[1] for i in range(x.shape[1]) for j in range(i)}
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]
    model.pairs = {k: np.zeros((8, 8)) for k in chosen}
    for _ in range(rounds // 2):
        for i, j in chosen:
            g, h = residual()
            step = rate * _cross(two_way(i, j, g), two_way(i, j, h))[0]
            model.pairs[i, j] += step
            total += step[grid[i], grid[j]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int], max_rows: int, label: str) -> pd.DataFrame:
    """Features and label of at most ``max_rows`` labelled documents that are not held out."""
    n, rest = held_out
    ids = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    ids = ids.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (id_mod(F.col("id"), n) != rest))
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return pd.Series(list(features(text.tolist())))

    # at most max_rows pairs of numbers are sent to every executor
    rows = id_text(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    return rows.select("doc_id", "y", measured("text").alias("x")).toPandas().sort_values("doc_id", kind="stable")


def learn(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), max_rows: int = MAX_ROWS, label: str = "quality") -> Additive:
    rows = training_rows(docs, labels, held_out, max_rows, label)
    if rows.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(rows["x"].to_list()), rows["y"].to_numpy(float))


def scorer(model: Additive) -> Callable[[Column], Column]:
    """The model as a column function of a text; the tables, of fixed size, travel with the job."""

    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(text.tolist())))

    return lambda text: quality(F.coalesce(text, F.lit("")))
