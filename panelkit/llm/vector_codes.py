"""Codes for vectors: every part of a vector becomes the index of the nearest entry of that part's codebook.

Components are integers, floor(``SCALE`` * x), so that distances, sums and
results are exact. ``ROUNDS`` times all parts are assigned to their nearest entry
and the entries move to the floored mean of their parts. The rows stay
distributed: a round is one pass that reads rows with their state and writes
them with the new one; each task adds a single row with its partial sums, and
only sums per part, entry and component reach the driver.

Most parts need no search. A part keeps, from the round in which it was last
searched (its stamp), the distance to its own entry and to the second nearest.
The driver retains the history of all codebooks. With it, the bound of an old
stamp moves by the true net displacement of an entry between that round and
now, the norm of the sum of its moves, which is never more than the moves added
up one by one. If the own entry is surely nearer than all others, the part
keeps it; if not, the exact distance to the own entry is tried, and only then
are all entries compared, exactly, ties to the lower index. Bounds are
floats widened by ``SLACK``, far more than their rounding, so they skip no search
that could change the result.

Defined cases: rows whose vector is null or holds null or non-finite components
are left out. A vector shorter than the longest one, or than the next multiple
of the number of parts, is read as if zeros followed. Fewer rows than entries
give as many entries as rows. Ids that repeat or are null (these come last) are
told apart by their vectors where the first codebook is chosen, and each row is
returned. Components too large for exact 64-bit products are worked on as
unbounded integers; an error, or a sum of errors, beyond 64 bits is null. An
empty table, or one without a usable row, gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.slices import join_spread
from ..session import cut_lineage, drop_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SLACK = 1e-9  # relative; a bound has about ten roundings of 1e-16
PLAIN = 1 << 40  # components up to here are added up in 64 bits, batch by batch
AT_ONCE = 1 << 21  # differences that a search holds in memory
LIMB = 40  # bits; sums travel in limbs, which no number of tasks below 2^23 can overflow
STATE = "id string, label string, no_label boolean, v array<double>, entry binary, stamp binary, own array<double>, second array<double>"


def root(square: int, beyond: float) -> float:
    return math.sqrt(square) if square < 10**300 else beyond


def roots(squares: np.ndarray, beyond: float) -> np.ndarray:
    """Square roots as floats; ``beyond`` where the number passes their range."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(float))
    return np.array([root(int(n), beyond) for n in squares], dtype=float)


@dataclass
class History:
    """Codebooks of all rounds so far; ``books[r][part][entry]`` is a tuple of integers."""

    books: list[list[list[tuple[int, ...]]]]

    def moves(self) -> np.ndarray:
        """Net displacement of every entry from each round to the last one: (round, part, entry)."""
        last = self.books[-1]
        far = lambda a, b: root(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), math.inf) * (1 + SLACK)
        return np.array([[[far(a, b) for a, b in zip(p, q, strict=True)] for p, q in zip(book, last, strict=True)] for book in self.books])


def integers(v: np.ndarray, scale: int) -> np.ndarray:
    """Floor of the components times ``scale``, a power of two: 64-bit if all are small enough, else unbounded."""
    with np.errstate(over="ignore"):
        x = np.floor(v * scale)
    if np.all(np.abs(x) <= PLAIN):
        return x.astype(np.int64)
    whole = lambda c: (lambda n, d: n * scale // d)(*float(c).as_integer_ratio())
    return np.array([[whole(c) for c in row] for row in v], dtype=object).reshape(v.shape)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows, entries)."""
    d = x[:, None, :] - book[None, :, :]
    return (d * d).sum(axis=2)


def same_type(x: np.ndarray, book: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codebook as one integer type: 64-bit if squared distances are exact in it, else unbounded."""
    c = np.array(book, dtype=object)
    high = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.dtype == object or x.shape[1] * (2 * high) ** 2 >= 1 << 62:
        return x.astype(object), c
    return x, c.astype(np.int64)


def search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry, its distance and that of the second nearest (infinite without one)."""
    entry, own, second = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
    many = max(1, AT_ONCE // max(1, book.size))
    for at in range(0, len(x), many):
        d = distances(x[at : at + many], book)
        e = np.argmin(d, axis=1)  # the first of equal ones
        entry[at : at + many] = e
        own[at : at + many] = roots(d[np.arange(len(d)), e], np.inf)
        if len(book) > 1:
            rest = d[np.arange(len(book)) != e[:, None]].reshape(len(d), -1)
            second[at : at + many] = roots(rest.min(axis=1), 1e150)  # a lower bound, so never too large
    return entry, own, second


def others(moves: np.ndarray) -> np.ndarray:
    """(round, part, entry): the largest displacement among the other entries."""
    top = moves.max(axis=2, keepdims=True)
    at = moves.argmax(axis=2)
    without = moves.copy()
    np.put_along_axis(without, at[:, :, None], -np.inf, axis=2)
    runner = np.maximum(without.max(axis=2, keepdims=True), 0.0)
    return np.where(np.arange(moves.shape[2]) == at[:, :, None], runner, top)


def assign(x: np.ndarray, history: History, entry: np.ndarray, stamp: np.ndarray, own: np.ndarray, second: np.ndarray) -> int:
    """Bring the state of all parts up to the last codebook, in place; returns how many parts were searched.

    Arrays are (rows, parts); an entry of 255 was never searched.
    """
    moves = history.moves()
    beside = others(moves)
    now, parts = len(history.books) - 1, entry.shape[1]
    width = x.shape[1] // parts
    searched = 0
    for p in range(parts):
        xs, book = same_type(x[:, p * width : (p + 1) * width], history.books[-1][p])
        new = entry[:, p] == 255
        e, s = np.where(new, 0, entry[:, p]), np.where(new, now, stamp[:, p])
        # each term is widened before the difference, which may be small against both
        upper = own[:, p] * (1 + SLACK) + moves[s, p, e]
        lower = (second[:, p] * (1 - SLACK) - beside[s, p, e]) * (1 - SLACK)
        open_ = np.flatnonzero(new | ~(upper < lower))
        old = open_[~new[open_]]
        if len(old):  # the exact distance to the own entry may settle it
            d = xs[old] - book[entry[old, p].astype(int)]
            exact = roots((d * d).sum(axis=1), np.inf) * (1 + SLACK)
            open_ = np.union1d(open_[new[open_]], old[~(exact < lower[old])])
        if len(open_):
            a, o, r = search(xs[open_], book)
            entry[open_, p], own[open_, p], second[open_, p], stamp[open_, p] = a, o, r, now
            searched += len(open_)
    return searched


def _parts_of(batch: pa.RecordBatch, parts: int, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    n = len(v)
    if batch.column("entry").null_count:
        return v, [np.full((n, parts), 255, np.uint8), np.zeros((n, parts), np.uint8), np.zeros((n, parts)), np.full((n, parts), np.inf)]
    small = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, parts).copy() for c in ("entry", "stamp")]
    wide = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, parts).copy() for c in ("own", "second")]
    return v, [*small, *wide]


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), pa.float64()))


def _bytes(a: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in a], pa.binary())


def _limbs(n: int) -> list[int]:
    """n as signed limbs, lowest first."""
    sign, n, out = (-1 if n < 0 else 1), abs(n), []
    while n:
        out.append(sign * (n & ((1 << LIMB) - 1)))
        n >>= LIMB
    return out


def step(rows: DataFrame, history: History, parts: int, length: int, scale: int) -> DataFrame:
    """Rows with the state of this round; each task adds rows of sums (part, entry, component, limb, value)."""
    width = length // parts
    entries = len(history.books[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), dtype=object)  # the last component counts
        any_rows = False
        for b in batches:
            if not b.num_rows:
                continue
            any_rows = True
            v, state = _parts_of(b, parts, length)
            x = integers(v, scale)
            searched = assign(x, history, *state)
            for p in range(parts):
                for e in np.unique(state[0][:, p]):
                    mine = x[state[0][:, p] == e, p * width : (p + 1) * width]
                    total[p, e, :width] += mine.sum(axis=0)
                    total[p, e, width] += len(mine)
            cols = [b.column(c) for c in ("id", "label", "no_label", "v")]
            cols += [_bytes(state[0]), _bytes(state[1]), _lists(state[2]), _lists(state[3])]
            none = pa.nulls(b.num_rows, pa.list_(pa.int64()))
            done = pa.array([searched, *[None] * (b.num_rows - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, none, done], names)
        if any_rows:
            sums = [
                [p, e, c, k, part]
                for (p, e, c), n in np.ndenumerate(total)
                for k, part in enumerate(_limbs(int(n)))
            ]
            arrays = [pa.nulls(len(sums), t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sums, pa.list_(pa.int64())), pa.nulls(len(sums), pa.int64())], names)

    names = [f.split()[0] for f in STATE.split(", ")] + ["sums", "searched"]
    doubles = pa.list_(pa.float64())
    kinds = [pa.string(), pa.string(), pa.bool_(), doubles, pa.binary(), pa.binary(), doubles, doubles]
    return rows.mapInArrow(run, f"{STATE}, sums array<bigint>, searched bigint")


def moved(book: list[list[tuple[int, ...]]], state: DataFrame) -> list[list[tuple[int, ...]]]:
    """The next codebook: floored means, from the sums that the tasks left; an entry without parts stays."""
    s = F.col("sums")
    sums = state.filter(s.isNotNull()).groupBy(*[s[i].alias(n) for i, n in enumerate(("p", "e", "c", "k"))]).agg(F.sum(s[4]).alias("v"))
    width = len(book[0][0])
    total = np.zeros((len(book), len(book[0]), width + 1), dtype=object)
    for r in sums.collect():  # per part, entry, component and limb
        total[r["p"], r["e"], r["c"]] += r["v"] << (LIMB * r["k"])
    return [
        [tuple(int(n // t[width]) for n in t[:width]) if t[width] else old for t, old in zip(part, olds, strict=True)]
        for part, olds in zip(total, book, strict=True)
    ]


@dataclass
class Codes:
    """Rows with id, label, no_label, v and the entry of each part, and the codebooks of all rounds."""

    rows: DataFrame | None
    history: History
    searched: list[int]  # parts compared with all entries, per round
    table: DataFrame | None = None  # the written rows


def learn(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codes:
    """Codebooks after ``rounds`` rounds, and every usable row with the entries nearest to its parts."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(label_col).cast("string")
    kept = vectors.filter(fine).select(F.col(id_col).alias("_id"), label.alias("label"), label.isNull().alias("no_label"), v.alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return Codes(None, History([]), [])
    length = max(parts, -(-longest // parts) * parts)
    kept = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), length - F.size("v"))))
    start = kept.orderBy(F.col("_id").asc_nulls_last(), "v").limit(entries).collect()
    x = integers(np.array([r["v"] for r in start]), scale)
    width = length // parts
    history = History([[[tuple(map(int, row[p * width : (p + 1) * width])) for row in x] for p in range(parts)]])
    state = kept.select(
        F.col("_id").cast("string").alias("id"), "label", "no_label", "v", *[F.lit(None).cast(t).alias(n) for n, t in
        (("entry", "binary"), ("stamp", "binary"), ("own", "array<double>"), ("second", "array<double>"))]
    )
    searched, last = [], None
    for r in range(rounds + 1):
        state = cut_lineage(step(state, history, parts, length, scale))
        if last is not None:
            drop_table(last)
        last = state
        searched.append(state.agg(F.sum("searched")).first()[0])
        if r < rounds:
            history.books.append(moved(history.books[-1], state))
        state = state.filter("sums is null").select(*[f.split()[0] for f in STATE.split(", ")])
    return Codes(state, history, searched, last)


def digest(history: History) -> str:
    """SHA-256 of all entries' components of the last codebooks, in decimal."""
    return hashlib.sha256(",".join(str(c) for p in history.books[-1] for e in p for c in e).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", scale: int = SCALE, **how) -> DataFrame:
    """vec_id, label (as text), code, error, label_error and codebooks_sha256 per usable row; ``how`` as for ``learn``."""
    kind = dict(vectors.dtypes)[id_col]
    codes = learn(vectors, id_col=id_col, label_col=label_col, scale=scale, **how)
    if codes.rows is None:
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, label string, code string, error bigint, label_error bigint, codebooks_sha256 string"
        )
    books = codes.history.books[-1]
    parts, width = len(books), len(books[0][0])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts * width), scale)
            entry = np.frombuffer(b"".join(b.column("entry").to_pylist()), np.uint8).reshape(-1, parts)
            total = np.zeros(len(x), dtype=object)
            for p in range(parts):
                xs, book = same_type(x[:, p * width : (p + 1) * width], books[p])
                d = xs - book[entry[:, p]]
                total += (d * d).sum(axis=1)
            error = pa.array([int(t) if t < 1 << 63 else None for t in total], pa.int64())
            code = pa.array([row.tobytes().hex() for row in entry], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "label", "no_label")], code, error], ["id", "label", "no_label", "code", "error"])

    rows = cut_lineage(codes.rows.mapInArrow(errors, "id string, label string, no_label boolean, code string, error bigint"))
    drop_table(codes.table)
    # one text for a label or for none, so that the join needs no null-safe test
    rows = rows.withColumn("key", F.when(F.col("no_label"), "-").otherwise(F.concat(F.lit("+"), "label")))
    whole = F.when(F.count("*") == F.count("error"), F.try_sum("error"))
    totals = rows.groupBy("key").agg(whole.alias("label_error"))
    out = join_spread(rows, totals, "key")
    return out.select(F.col("id").cast(kind).alias("vec_id"), "label", "code", "error", "label_error", F.lit(digest(codes.history)).alias("codebooks_sha256"))
