"""Language-model scores from a weighted backoff automaton over words.

States: the root, the begin of a text, and each word that makes up at least
``SHARE`` of the training tokens; as that is 0, every word of the training texts
is a state, and their number grows with the corpus. An arc is a pair (state,
word) seen in training; a state without an arc for a word fails to the root at
the cost of its backoff weight, and the root has every word. Weights: the root
gives (c + A) / (N + A (V + 1)); a state mixes its counts with ``MU`` times the
root's distribution. Both add up to one.

The corpus is dealt into blocks of bounded size by a hash of the id. A block
sends its distinct words and arcs with their training counts; the sums over all
blocks come back to those who asked, in the order of their hashes; then each text of the block is read from
left to right, the state being the word before. No task holds more of the model
than its block needs, and no hot word brings more than one count per block.

Defined cases: null and empty texts are one end token; repeated rows count and
are scored each; with no training text every probability is 1; an empty table
gives an empty result. Words and arcs are compared by 64-bit hash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import id_mod, id_text

BLOCK_CHARS = 16_000_000
SHARE = 0.0  # of the training tokens, from which on a word is a state: every word is one
MU = 100.0
A = 0.5
END = b""


def tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words and the end token."""
    return [*text.encode("utf-8", "replace").lower().split(), END]


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


BEGIN = np.int64(word_key(b" "))  # no word has a space


class Index(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def keys_array(self) -> np.ndarray:
        return np.fromiter(map(word_key, self), np.int64, len(self))


def word_counts(train: DataFrame) -> DataFrame:
    """(w, c): occurrences of every word; tasks add up what they read before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, sums = Index(), np.zeros(0, np.int64)

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"w": index.keys_array(), "c": sums[: len(index)]})

        for pdf in batches:
            ids = [index[w] for text in pdf["text"] for w in tokens(text)]
            if len(index) > len(sums):
                sums = np.pad(sums, (0, len(index) - len(sums)))
            sums += np.bincount(np.array(ids, np.int64), minlength=len(sums))
            if len(index) > 500_000:  # bounded memory: hand over and start again
                yield rows()
                index, sums = Index(), np.zeros(0, np.int64)
        yield rows()

    return train.select("text").mapInPandas(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def block_tokens(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words of a block; word numbers of all its texts, one after the other; the number of tokens of each text."""
    index = Index()
    ids = [np.fromiter((index[w] for w in tokens(t)), np.int64) for t in texts]
    return index.keys_array(), np.concatenate(ids), np.array([len(x) for x in ids])


def states_before(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each token the state it is read in: 0 at the begin of a text, else the number of the word before, plus 1."""
    before = np.concatenate([[0], ids[:-1] + 1])
    before[np.cumsum(sizes) - sizes] = 0
    return before


def arc_keys(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Hashes of arcs given as state << 32 | word number."""
    states = np.concatenate([[BEGIN], keys]).view(np.uint64)
    x = states[codes >> 32] * np.uint64(0x9E3779B97F4A7C15) + keys.view(np.uint64)[codes & 0xFFFFFFFF]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def asked(ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arcs of a block as state << 32 | word number, the arc of each token, and the hashes of words and arcs."""
    codes, where = np.unique(states_before(ids, sizes) << 32 | ids, return_inverse=True)
    return codes, where, np.concatenate([keys, arc_keys(codes, keys)]).view(np.uint64)


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte of their size, so that the bytes that are mostly 0 take no room."""
    return zlib.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def requests(blocks: DataFrame, n_ranges: int) -> DataFrame:
    """(block, part, k, c): hashes of the distinct words and arcs of each block, and their count in its training texts, by ranges of hashes."""

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, ids, sizes = block_tokens(pdf["text"])
        codes, where, k = asked(ids, sizes, keys)
        train = np.repeat(pdf["train"].to_numpy(), sizes)
        c = np.concatenate([np.bincount(ids[train], minlength=len(keys)), np.bincount(where[train], minlength=len(codes))])
        order = np.argsort(k)
        k, c = k[order], c[order]
        part = ((k >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(n_ranges + 1))
        rows = [(p, pack(np.diff(k[a:b], prepend=np.uint64(0))), pack(c[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pd.DataFrame(rows, columns=["part", "k", "c"]).assign(block=pdf["block"].iloc[0])[["block", "part", "k", "c"]]

    return blocks.groupBy("block").applyInPandas(ask, "block int, part int, k binary, c binary")


def answers(wanted: DataFrame) -> DataFrame:
    """(block, part, c): counts over all blocks, in the order of the hashes each block asked for."""

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        k = [np.cumsum(unpack(b), dtype=np.uint64) for b in pdf["k"]]
        _, where = np.unique(np.concatenate(k), return_inverse=True)
        sums = np.bincount(where, np.concatenate([unpack(b) for b in pdf["c"]]).astype(float))[where]
        ends = np.cumsum([len(x) for x in k])[:-1]
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "c": [pack(x) for x in np.split(sums, ends)]})

    return wanted.groupBy("part").applyInPandas(add_up, "block int, part int, c binary")


class Automaton:
    """The part of the automaton that a block's texts can reach."""

    def __init__(self, seen: np.ndarray, starts: int, n: int, v: int) -> None:
        self.seen = seen
        self.p = (seen + A) / (n + A * (v + 1))
        self.base = np.log10((seen + 1) / (n + v + 1))
        self.visits = np.concatenate([[starts], seen])

    def weights(self, codes: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Log probability of arcs with training counts c; an arc not seen has its state's backoff weight times the root's."""
        return np.log10((c + MU * self.p[codes & 0xFFFFFFFF]) / (self.visits[codes >> 32] + MU))


def score(docs: DataFrame, held_out: tuple[int, int] = (7, 2), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    mod, rest = held_out
    rows = id_text(docs, id_col, text_col)
    rows = rows.withColumn("train", id_mod(F.col("doc_id"), mod) != rest)
    counts = cut_lineage(word_counts(rows.filter("train")))
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"]
    end = word_key(END)
    texts = counts.filter(F.col("w") == word_key(END)).first()
    starts = texts["c"] if texts else 0
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
    blocks = blocks.withColumn("doc_id", F.col("doc_id").cast("string"))
    # a range gets 1 / n_ranges of what each block asks for: as much as two blocks, however many there are
    model = answers(requests(blocks, math.ceil(n_blocks / 2)))
    kind = dict(rows.dtypes)["doc_id"]

    def read(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        keys, ids, sizes = block_tokens(pdf["text"])
        codes, where, k = asked(ids, sizes, keys)
        c = np.empty(len(k))
        c[np.argsort(k)] = np.concatenate([unpack(b) for b in model.sort_values("part")["c"]])
        machine = Automaton(c[: len(keys)], starts, n, v)
        first = np.cumsum(sizes) - sizes
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                "held_out": ~pdf["train"],
                "n_tokens": sizes,
                "n_known": np.add.reduceat((machine.seen[ids] > 0).astype(np.int64), first),
                "train_tokens": n,
                "base_score": np.add.reduceat(machine.base[ids], first),
                "score": np.add.reduceat(machine.weights(codes, c[len(keys) :])[where], first),
            }
        )

    both = blocks.groupBy("block").cogroup(model.groupBy("block"))
    out = both.applyInPandas(
        read, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
