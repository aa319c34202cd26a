"""Near duplicates by a chosen-path similarity join on sets of five-word shingles.

Equal sets are one class first. The classes then descend independent trees: at
the root a class goes to the node of its minwise token, and in every node that
is too large for one task it goes on to ``FAN`` children, chosen by further
minwise tokens. A node that is small enough compares all its members in memory
by their minwise tokens, but for those that share too few with all others
together. A pair that this leaves possible is assigned to one of the nodes it
was found in, and the members of such pairs meet there once more with their
whole texts: the task compares full shingle sets until every pair is compared
or lies within one component, and returns fewer links than it has members.
Nodes still too large at the last level hold the near copies of few templates:
their members meet once with their texts, a task's worth at a time beside the
same few pivots, which ties most of them into one component. Pairs inside a
component need no further test; only the members outside the largest one of a
node are compared with all of it, in blocks, so no case is dropped, no
task holds more than two blocks, and the work grows with the members.

With similarity s, a pair shares a root token with probability s and stays in
one of two children with 1 - (1 - s)^2. A lower least similarity gets more trees:
they put the chance that such a pair shares no root at about 1e-5 (six trees for
0.85, seven for 0.8). A pair that agrees in too few of its tokens, and is passed
over for it, has probability 1e-8 (fewer than 29 of 54 for 0.85).

Defined cases: texts without a word have an empty set, link with nothing and
are kept; texts shorter than a shingle are one shingle; rows that repeat a
doc_id belong to one component, whatever their texts, and each is returned; a
null doc_id has a null component, links with nothing and is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, cut_lineage, drop_table
from .common import id_text, may_be_in

WORDS = 5
PERCENT = 85
LEVELS = 5
FAN = 2
STEPS = FAN * (LEVELS - 1)  # child tokens of one tree
MISSED, PASSED = 1.3e-5, 1.3e-8  # chances that a pair of the least similarity shares no root, and agrees in too few tokens
SMALL, WEIGHT = 2048, 4_000_000  # members and shingles of a node that one task compares
PIVOTS = 4  # members that stand beside every group of a large node
FEW = 4  # possible pairs per member up to which they are listed as pairs
TOGETHER = 1 << 16  # bytes of text that are hashed at a time
PART = 4096  # words of a long text that are hashed at a time
LONG_WORD = 4096


def trees_for(percent: int) -> int:
    """Number of trees that a least similarity of ``percent`` needs."""
    return math.ceil(math.log(MISSED) / math.log1p(-percent / 100))


def tokens_of(trees: int) -> int:
    return trees * (1 + STEPS)


def agreement(percent: int) -> int:
    """The tokens in which a pair of ``percent`` agrees but for a chance of ``PASSED``."""
    n, p, k, below = tokens_of(trees_for(percent)), percent / 100, 0, 0.0
    while (below := below + math.comb(n, k) * p**k * (1 - p) ** (n - k)) <= PASSED:
        k += 1
    return k


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and place of each word, in order, without an object per word.

    A word is the sum of a number per byte and place in the word; the xxh64 of
    the bytes stands for words over ``LONG_WORD`` bytes.
    """
    b = np.frombuffer(raw, np.uint8)
    ink = INK[b]
    edge = np.flatnonzero(np.diff(ink, prepend=False, append=False))
    starts, n = edge[::2], edge[1::2] - edge[::2]
    long = np.flatnonzero(n > LONG_WORD)
    whole = [xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + n[i]]) for i in long]
    for i in long:
        ink[starts[i] + 1 : starts[i] + n[i]] = False
        n[i] = 1
    letters, first = b[ink], np.cumsum(n) - n
    if not len(n):
        return np.zeros(0, np.uint64), starts
    place = np.arange(len(letters)) - np.repeat(first, n)
    out = mixed(np.add.reduceat(BYTE[letters] * PLACE[place], first) + n.astype(np.uint64))
    out[long] = np.array(whole, np.uint64)
    return out, starts


class Shingler:
    """Distinct shingles of texts as sorted 64-bit hashes."""

    def __call__(self, texts: Iterable[str]) -> list[np.ndarray]:
        """One array per text; short texts are hashed together, some ``TOGETHER`` bytes at a time."""
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            raw = text.encode("utf-8", "replace").lower()  # bytes: lower-cases A-Z; words end at U+0020, U+0009-U+000D
            held.append(raw)
            size += len(raw)
            if size >= TOGETHER:
                out += self._sets(held)
                held, size = [], 0
        return out + self._sets(held)

    def _sets(self, raws: list[bytes]) -> list[np.ndarray]:
        if len(raws) > 1 and len(raws[-1]) > TOGETHER:  # a long text is cut for itself
            return self._sets(raws[:-1]) + self._sets(raws[-1:])
        if len(raws) == 1 and len(raws[0]) > TOGETHER:
            words = raws[0].split()
            parts = [word_hashes(b" ".join(words[k : k + PART]))[0] for k in range(0, len(words), PART)]
            h, ends = np.concatenate([np.zeros(0, np.uint64), *parts]), [0, len(words)]
        else:
            h, starts = word_hashes(b"\n".join(raws))
            ends = [0, *np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raws])).tolist()]
        runs = rolled(h, WORDS)  # those that reach into the next text are not used
        out = []
        for at, end in pairwise(ends):
            k = min(WORDS, end - at)
            s = runs[at : end - WORDS + 1] if k == WORDS else rolled(h[at:end], k)
            if len(s) > 1:
                s = np.sort(s)
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        return out


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes."""
    out = np.full(max(0, len(h) - k + 1) if k else 0, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixer: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


INK = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACE = mixed(np.arange(1, LONG_WORD + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What is added to and multiplies a shingle in each of n orders."""
    k = np.arange(1, n + 1, dtype=np.uint64)
    return mixed(k * np.uint64(0xD1B54A32D192ED03)), mixed(k * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1)


def minwise(sets: list[np.ndarray], trees: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set (none is empty), the first shingle of each order: one of 64 bits per tree and one of 32 bits per child."""
    roots, steps = np.empty((len(sets), trees), np.uint64), np.empty((len(sets), trees * STEPS), np.uint32)
    add, times = seeds(tokens_of(trees))
    ends = np.cumsum([0, *map(len, sets)])
    at = 0
    while at < len(sets):  # a part that stays in the processor's cache, but whole sets
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOGETHER // 2, "right")) - 1)
        s, first = np.concatenate(sets[at:to]), ends[at:to] - ends[at]
        for t in range(trees):
            roots[at:to, t] = np.minimum.reduceat((s ^ add[t]) * times[t], first)
        s = (s >> np.uint64(32)).astype(np.uint32)
        for t, (a, b) in enumerate(zip(add[trees:].astype(np.uint32), times[trees:].astype(np.uint32), strict=True)):
            steps[at:to, t] = np.minimum.reduceat((s ^ a) * b, first)
        at = to
    return roots.view(np.int64), steps.view(np.int32)


def signatures(rows: DataFrame, trees: int) -> DataFrame:
    """doc_id, n_shingles, two-part key of the set and its minwise tokens (null for an empty set).

    ``roots`` holds the first token of each tree, whole; ``steps`` those of the
    children, of which 32 bits are enough, as a child also carries its parent.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for pdf in batches:
            texts, out = pdf["text"].tolist(), []
            for at in range(0, len(texts), 256):  # few whole sets are held at a time
                sets = shingles(texts[at : at + 256])
                tokens = zip(*minwise([s for s in sets if len(s)], trees), strict=True)
                for s in sets:
                    a, b = (xxhash.xxh64_intdigest(s.tobytes(), k) - (1 << 63) for k in (1, 2))
                    out.append((len(s), a, b, *(next(tokens) if len(s) else (None, None))))
            cols = pd.DataFrame(out, columns=["n_shingles", "ka", "kb", "roots", "steps"])
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), cols], axis=1)

    kind = dict(rows.dtypes)["doc_id"]
    text_id = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = text_id.mapInPandas(measure, "doc_id string, n_shingles long, ka long, kb long, roots array<long>, steps array<int>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id reachable, for every id in edges (a, b).

    Each round an id takes the smallest root among its own and its neighbours',
    then the root of that root; all rows stay distributed and every round is
    checkpointed.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    last = roots = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")))
    while True:
        offers = both.join(roots, both.b == roots.id).groupBy("a").agg(F.min("root").alias("offer"))
        low = roots.join(offers, roots.id == offers.a).select("id", F.col("root").alias("old"), F.least("root", "offer").alias("low"))
        up = roots.select(F.col("id").alias("low"), F.col("root").alias("up"))
        new = cut_lineage(low.join(up, "low", "left").select("id", "old", F.least("low", "up").alias("root")))
        roots = new.select("id", "root")
        drop_table(last)
        last = new
        if not new.filter("root < old").limit(1).count():
            drop_table(both)
            return roots


def descend(sets: DataFrame, trees: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Members of the nodes to compare and of those still large at the last level: (node, doc_id, n_shingles).

    Each node has two or more members; a level holds the children of the last one's large nodes.
    """
    roots = F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.get("roots", F.lit(t))).alias("node")) for t in range(trees)])
    members = sets.select("doc_id", "n_shingles", F.explode(roots).alias("x")).select("doc_id", "n_shingles", "x.t", "x.node")
    out = None
    for level in range(LEVELS):
        sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight")).filter("n > 1")
        nodes = scratch.keep(members.join(sizes, "node"))
        large = (F.col("n") > SMALL) | ((F.col("weight") > WEIGHT) & (F.col("n") > 2))
        part = nodes.filter(~large).select("node", "doc_id", "n_shingles")
        out = part if out is None else out.union(part)
        rest = nodes.filter(large)
        if not rest.limit(1).count():
            return out, None
        if level < LEVELS - 1:
            rest = rest.join(sets.select("doc_id", "n_shingles", "steps"), ["doc_id", "n_shingles"])
            children = F.array(*[F.xxhash64("node", F.lit(f), F.get("steps", F.col("t") * STEPS + FAN * level + f)) for f in range(FAN)])
            members = rest.select("doc_id", "n_shingles", "t", F.explode(children).alias("node"))
            members = members.dropDuplicates(["node", "doc_id", "n_shingles"])
    return out, rest.select("node", "doc_id", "n_shingles")


def n_blocks() -> Column:
    """Blocks of the members that an aggregate counts, of which two are one task's worth."""
    parts = F.ceil(F.greatest(F.count("*") * 2 / SMALL, F.sum("n_shingles") * 2 / WEIGHT))
    return F.greatest(F.lit(1), parts.cast("int"))


def around_pivots(dense: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, a): each member of large nodes once, in a group of bounded size with the pivots of one of its nodes.

    Pivots are members with the smallest of some hashes, so nodes of much the same members have the same.
    """
    small = F.col("n_shingles") <= WEIGHT // (8 * PIVOTS)
    least = [F.min(F.when(small, F.struct(F.xxhash64("doc_id", F.lit(i)).alias("h"), "doc_id")))["doc_id"] for i in range(PIVOTS)]
    pivots = dense.groupBy("node").agg(F.array_sort(F.array_distinct(F.array_compact(F.array(*least)))).alias("pivots"))
    pivots = scratch.keep(pivots.withColumn("key", F.xxhash64("pivots")))
    # a row of the sets is an id and a size; an id with several sets is here with its largest
    own = dense.join(pivots.select("node", "key"), "node").groupBy("doc_id").agg(F.min("key").alias("key"), F.max("n_shingles").alias("n_shingles"))
    own = scratch.keep(own)
    parts = scratch.keep(own.groupBy("key").agg(n_blocks().alias("parts")))
    group = F.xxhash64("key", "part").alias("node")
    rows = own.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), "parts").cast("int")).select(group, F.col("doc_id").alias("a"))
    few = parts.join(pivots.select("key", "pivots").dropDuplicates(["key"]), "key")
    few = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "part", F.explode("pivots").alias("a"))
    return rows.union(few.select(group, "a")).distinct()


def loose(dense: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, doc_id, n_shingles): members outside the largest component of a large node, in blocks with all its members."""
    known = dense.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    known = scratch.keep(known)
    tied = known.groupBy("node", "root").agg(F.count("*").alias("n"))
    main = tied.groupBy("node").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    main = scratch.keep(main.drop("roots"))
    blocks = known.join(main, "node").groupBy("node").agg(n_blocks().alias("blocks"))
    odd = scratch.keep(known.join(main, "node").filter("root <> main").select("node", "doc_id", "n_shingles"))
    counts = scratch.keep(blocks.join(odd.groupBy("node").agg(n_blocks().alias("odd_blocks")), "node"))
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    deal = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    one = known.select("node", "doc_id", "n_shingles").join(counts, "node").select("*", deal("blocks").alias("b"), every("o", "odd_blocks"))
    two = odd.join(counts, "node").select("*", deal("odd_blocks").alias("o"), every("b", "blocks"))
    cols = [F.xxhash64("node", "o", "b").alias("node"), "doc_id", "n_shingles"]
    return one.select(*cols).union(two.select(*cols)).distinct()


def grouped(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[list[np.ndarray]]:
    """The node column and others of each whole node, from rows that come sorted by node."""
    held: list[np.ndarray] = []
    for pdf in batches:
        new = [pdf[c].to_numpy() for c in ("node", *columns)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        cuts = [0, *(np.flatnonzero(held[0][1:] != held[0][:-1]) + 1).tolist()]
        for at, end in pairwise(cuts):
            yield [x[at:end] for x in held]
        held = [x[cuts[-1] :] for x in held]
    if held and len(held[0]):
        yield held


def alike(n: np.ndarray, tokens: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose sizes ``n`` allow ``percent`` and whose sketches agree in ``least`` tokens."""
    at = np.arange(len(n))
    if len(n) > 64:  # who shares too few tokens with all others together is in no pair
        met = np.zeros(len(n), np.int32)
        for c in tokens.T:
            met += np.bincount(c, minlength=1)[c] > 1
        at = np.flatnonzero(met >= least)
    at = at[np.argsort(n[at], kind="stable")]
    n, columns = n[at], np.ascontiguousarray(tokens[at].T)
    upto = np.searchsorted(n * percent, n * 100, "right")  # sizes from here on are too large for a row
    found = []
    for i in range(0, len(at), 256):
        j = int(upto[min(i + 256, len(at)) - 1])
        if j - i <= 32:
            agree = (columns[:, i:j, None] == columns[:, None, i:j]).sum(0)
        else:
            agree = np.zeros((min(256, len(at) - i), j - i), np.uint8)
            for c in columns:
                agree += c[i : i + 256, None] == c[None, i:j]
        a, b = (agree >= least).nonzero()
        use = (a < b) & (100 * n[i + a] >= percent * n[i + b])
        found.append((at[i + a[use]], at[i + b[use]]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (at, at)
    return a, b


def possible(members: DataFrame, percent: int) -> DataFrame:
    """(a, b, node): pairs that sizes and sketches allow; with b null, a member of a node where such pairs are many."""
    least = agreement(percent)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[list[np.ndarray]] = []
        size = 0
        for node, ids, n, sketch in grouped(batches, "doc_id", "n_shingles", "sketch"):
            a, b = alike(n, np.stack(sketch), least, percent)
            other = ids[a] != ids[b]
            a, b = ids[a[other]], ids[b[other]]
            if len(a) > FEW * len(ids):
                a, b = np.union1d(a, b), None
            if len(a):
                pair = (np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), bool)) if b is not None else (a, a, np.ones(len(a), bool))
                out.append([*pair, np.full(len(a), node[0])])
                size += len(a)
            if size > 50_000:
                yield frame(out)
                out, size = [], 0
        if out:
            yield frame(out)

    def frame(out: list[list[np.ndarray]]) -> pd.DataFrame:
        a, b, many, node = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"a": a, "b": pd.Series(b, dtype="Int64").mask(many), "node": node})

    rows = members.repartition("node").sortWithinPartitions("node")
    return rows.mapInPandas(look, "a long, b long, node long")


def spanning(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that tie together the members of each component.

    A member is compared with all others by the members of each of its shingles.
    That goes on until those not compared yet are in one component: then every
    pair has been compared or lies within a component.
    """
    some = [k for k, s in enumerate(sets) if len(s)]  # an empty set links with nothing
    if len(some) < 2:
        return []
    ids, sets = ids[some], [sets[k] for k in some]
    size = np.array([len(s) for s in sets])
    ends = np.concatenate(([0], np.cumsum(size)))
    values = np.concatenate(sets)
    order = np.argsort(values)
    values = values[order]
    column = np.empty(len(values), np.int64)
    column[order] = np.cumsum(np.concatenate(([False], values[1:] != values[:-1])))
    having = np.repeat(np.arange(len(sets)), size)[order]  # members by shingle
    number = np.bincount(column)
    first = np.cumsum(number) - number
    shared = number[column] > 1  # a shingle of one member only is in no intersection
    able = 100 * np.add.reduceat(shared, ends[:-1], dtype=np.int64) >= percent * size
    root, links, left = np.arange(len(sets)), [], np.flatnonzero(able)
    while len(left):
        main = np.bincount(root[left]).argmax()
        odd = np.flatnonzero(root[left] != main)
        if not len(odd):
            break
        i, left = left[odd[0]], np.delete(left, odd[0])
        own = column[ends[i] : ends[i + 1]][shared[ends[i] : ends[i + 1]]]
        n = number[own]
        at = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(having[at], minlength=len(sets))
        hits = np.flatnonzero(100 * both >= percent * (size[i] + size - both))
        others, which = np.unique(root[hits], return_index=True)
        for r, j in zip(others, hits[which], strict=True):
            if r != root[i]:
                links.append((ids[i], ids[j]))
                root[root == r] = root[i]
    return links


def confirmed(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members (node, a) of each node, by the full sets of their texts."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        found: list[tuple[int, int]] = []
        for _, ids, held in grouped(batches, "a", "text"):
            found += spanning(ids, shingles(held), percent)
            if len(found) > 50_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])

    # only texts that may be wanted are moved; the join is the same at every size
    texts = may_be_in(texts.select(F.col("doc_id").alias("a"), "text"), F.xxhash64("a"), members.select(F.xxhash64("a").alias("h")))
    rows = texts.filter("_may").select("a", "text").join(members.hint("shuffle_hash"), "a")  # texts are not sorted
    return rows.select("node", "a", "text").repartition("node").sortWithinPartitions("node").mapInPandas(compare, "a long, b long")


def links(sets: DataFrame, texts: DataFrame, ties: DataFrame, percent: int) -> DataFrame:
    """(id, root) of all classes that are linked with another; ``ties`` (a, b) are links that need no test."""
    # 15 bits of each token: equal tokens stay equal, so no pair is lost, and a member is small to move
    sketch = F.transform(F.concat("roots", F.col("steps").cast("array<long>")), lambda x: F.pmod(x, F.lit(32768)).cast("short"))
    scratch = Scratch()
    nodes, dense = descend(sets, trees_for(percent), scratch)
    if dense is not None:
        meet = scratch.keep(around_pivots(dense, scratch))
        ties = cut_lineage(confirmed(meet, texts, percent).union(ties))
        tied = components(ties)
        nodes = nodes.union(loose(dense, tied, scratch))
    members = nodes.join(sets.select("doc_id", "n_shingles", sketch.alias("sketch")), ["doc_id", "n_shingles"])
    found = cut_lineage(possible(members, percent))
    scratch.drop()
    pairs = found.filter("b is not null").groupBy("a", "b").agg(F.min("node").alias("node"))
    few = pairs.select("node", F.explode(F.array("a", "b")).alias("a"))
    meet = cut_lineage(few.union(found.filter("b is null").select("node", "a")).distinct())
    drop_table(found)
    edges = cut_lineage(confirmed(meet, texts, percent).union(ties))
    drop_table(meet, *([ties] if dense is not None else []))
    roots = components(edges)
    drop_table(edges)
    return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row; pairs of similarity ``percent`` or more link."""
    rows = id_text(docs, id_col, text_col)
    scratch = Scratch()
    sets = scratch.keep(signatures(rows, trees_for(percent)))
    full = sets.filter("n_shingles > 0 and doc_id is not null")
    copies = full.groupBy("ka", "kb").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).filter("n > 1")
    # the small side of each join is written first: its size is known then, and a hot group can be split
    full = full.join(scratch.keep(copies.drop("n")), ["ka", "kb"], "left")
    same = scratch.keep(full.select(F.coalesce("rep", "doc_id").alias("a"), F.col("doc_id").alias("b")))
    # an id with several sets ties their classes together
    ties = same.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low < high")
    ties = same.join(scratch.keep(ties), "b").filter("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    alone = full.filter("rep is null").select("doc_id", "n_shingles", "roots", "steps")
    reps = full.filter("rep = doc_id").dropDuplicates(["doc_id", "ka", "kb"]).select(*alone.columns)
    roots = links(scratch.keep(alone.union(reps)), rows, ties, percent)
    joined = same.join(roots, same.a == roots.id, "left").select(F.col("b").alias("doc_id"), F.coalesce("root", "a").alias("component_id"))
    moved = joined.filter("component_id < doc_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    moved, sizes = cut_lineage(moved), cut_lineage(sets.select("doc_id", "n_shingles"))
    scratch.drop()  # tokens are no longer needed
    out = sizes.join(moved, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
