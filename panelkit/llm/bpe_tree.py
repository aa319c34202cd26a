"""Byte-level BPE by monoid tree reduction.

A text is encoded by halves: leaves on their own, then neighbours are joined.
What a join may change lies between the last safe cut of the left part and the
first safe cut of the right part. A safe cut is a place before a single space
with a character other than white space on both sides of it: whatever stands
further away, the pattern begins a match there. Only that window is encoded
again; it grows to a whole side that has no safe cut.

Inside one match that is long, the same is done with tokens: halves are encoded,
tokens next to the border are encoded again in a growing window, until the pairs
at both ends of the window are stable. A pair of tokens is stable if the bytes of
both, encoded together, give the pair again. A token sequence whose neighbours
are all stable is the encoding of its bytes, so tokens outside need no look.

Decoding concatenates the tokens' bytes up the same kind of tree.

Defined cases: null and empty texts have no tokens; repeated rows are encoded
each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

LEAF_CHARS = 8192
LEAF_BYTES = 64
KNOWN = 300_000  # short blocks a worker remembers


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(n) for t, n in map(bytes.split, data.splitlines())}


class Pieces:
    """Encodes one pattern match; ``direct`` encodes a short byte string."""

    def __init__(self, ranks: dict[bytes, int], direct: Callable[[bytes], list[int]], leaf: int = LEAF_BYTES) -> None:
        self.direct, self.leaf = direct, leaf
        self.bytes_of = {n: t for t, n in ranks.items()}

    def __call__(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.direct(piece)
        half = len(piece) // 2
        return self.join(self(piece[:half]), self(piece[half:]))

    def stable(self, a: int, b: int) -> bool:
        return self.direct(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        i, j = len(left) - 1, 1  # the window takes left[i:] and right[:j]
        while True:
            window = self.direct(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            grow_left = i > 0 and not self.stable(left[i - 1], window[0])
            grow_right = j < len(right) and not self.stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:i] + window + right[j:]
            i -= grow_left
            j += grow_right


class Known(dict):
    """What a block comes to: number of ids, ids as decimal text, decoded bytes.

    Keys are segments between single spaces; a block is its segment behind a space.
    """

    def __init__(self, encode: Callable[[str], list[int]], bytes_of: dict[int, bytes]) -> None:
        self.encode, self.bytes_of = encode, bytes_of
        self.text_of = {k: f"{k}," for k in bytes_of}

    def made(self, block: str) -> tuple[int, str, bytes]:
        ids = self.encode(block)
        if len(ids) > 64:
            return len(ids), "".join([self.text_of[k] for k in ids]), join_tree([self.bytes_of[k] for k in ids], b"")
        return len(ids), "".join([self.text_of[k] for k in ids]), b"".join([self.bytes_of[k] for k in ids])

    def of(self, block: str) -> tuple[int, str, bytes]:
        inner = block[1:]
        even = block[:1] == " " and inner and not inner[0].isspace() and not inner[-1].isspace()
        return self[inner] if even else self.made(block)

    def __missing__(self, segment: str) -> tuple[int, str, bytes]:
        if not segment or segment[0].isspace() or segment[-1].isspace():
            raise Uneven
        out = self.made(" " + segment)
        if len(segment) <= 64:
            if len(self) >= KNOWN:
                self.clear()
            self[segment] = out
        return out


class Uneven(Exception):
    """A segment that does not lie between two safe cuts."""


def join_tree(parts: list, empty):
    """Concatenation of neighbours up a tree."""
    while len(parts) > 1:
        parts = [a + b for a, b in zip(parts[::2], [*parts[1::2], empty], strict=False)] if len(parts) % 2 == 0 else [
            *(a + b for a, b in zip(parts[:-1:2], parts[1::2], strict=True)), parts[-1]
        ]
    return parts[0] if parts else empty


def blocks(text: str) -> list[str]:
    """The text cut at its safe cuts."""
    first, *rest = text.split(" ")
    out = [first]
    for s in rest:
        last = out[-1]
        if s and not s[0].isspace() and last and not last[-1].isspace():
            out.append(" " + s)
        else:
            out[-1] = last + " " + s
    return out


class Texts:
    """The tree over a text. An element of the monoid is the list of its blocks.

    Blocks within an element are final; the first and the last one may still
    grow, so they are looked up only when the tree is done.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> None:
        self.base = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = Pieces(ranks, self.base._encode_single_piece, leaf_bytes)
        self.pattern, self.leaf, self.leaf_bytes = regex.compile(pattern), leaf, leaf_bytes
        self.known = Known(self.block_ids, self.pieces.bytes_of)

    def block_ids(self, block: str) -> list[int]:
        if len(block) * 4 <= self.leaf_bytes:
            return self.base.encode_ordinary(block)
        return [k for m in self.pattern.findall(block) for k in self.pieces(m.encode("utf-8", "replace"))]

    def element(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return blocks(text)
        half = len(text) // 2
        return self.join(self.element(text[:half]), self.element(text[half:]))

    @staticmethod
    def join(left: list[str], right: list[str]) -> list[str]:
        """Only the window from the last cut on the left to the first on the right is cut again."""
        return left[:-1] + blocks(left[-1] + right[0]) + right[1:]

    def __call__(self, text: str) -> tuple[int, str, bytes]:
        """Number of ids, ids as decimal text, decoded bytes."""
        if not text:
            return 0, "", b""
        known = self.known
        try:
            if len(text) > self.leaf:
                raise Uneven
            first, *rest = text.split(" ")  # a leaf in which every single space is a safe cut
            found = [known[s] for s in rest]
            if first and first[-1].isspace():
                raise Uneven
            found.insert(0, known.made(first))
        except Uneven:
            found = [known.of(b) for b in self.element(text)]
        return sum(x[0] for x in found), "".join([x[1] for x in found])[:-1], b"".join([x[2] for x in found])

    def ids(self, text: str) -> list[int]:
        return [int(k) for k in self(text)[1].split(",") if k]

    def decode(self, ids: list[int]) -> bytes:
        return join_tree([self.pieces.bytes_of[k] for k in ids], b"")


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes, and the ids (unless ``with_ids`` is false)."""
    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    ranks = rows.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())  # a vocabulary file, the same for any corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Texts(read_ranks(ranks.value), pattern)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                n, ids, raw = tree(text)
                row = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
                out.append((*row, [int(k) for k in ids.split(",") if k]) if with_ids else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + with_ids]
            yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
