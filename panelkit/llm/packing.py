"""Concatenate and cut: all documents as one run of tokens, cut into fixed windows.

Pass one encodes each text where it lies and writes its ids with the number of
tokens before it in its partition. Prefix sums over the partition totals give
every partition its place in the run. Pass two cuts each document at the window
borders; a piece is a boundary record with its window and offset. Only the last
window of the run is short; it is padded to a power of two.

Defined cases: null and empty texts are the separator alone; repeated rows are
packed each; an empty table gives an empty result; the order is that of the
input's partitions and rows.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from sys import byteorder

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from ..session import cut_lineage
from .common import id_text

WINDOW = 1024
SEPARATOR = 0
KNOWN = 300_000  # segments a worker remembers
#: Pattern of byte-level pre-tokenisation, a fixed value of such vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that every regex engine puts into the same class: printable ASCII, line ends, Latin, Cyrillic, CJK, common punctuation.
PLAIN = re.compile("[\t\n\r!-~¡-ɏЀ-ҁҊ-ӿ‐-‧€一-龥]+")


def byte_names() -> dict[str, int]:
    """The character by which such vocabularies write each byte: itself if printable, else the next one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def as_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE whose merges are numbered in the order of its ids; None for any other tokenizer."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel":
        return None
    if pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab, names = model["vocab"], byte_names()
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    known = {t: k for t, k in vocab.items() if all(c in names for c in t)}
    ranks = {bytes(names[c] for c in t): k for t, k in known.items()}
    if merged != sorted(merged) or len(merged) + 256 > len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    special = {x["content"] for x in spec.get("added_tokens", [])}
    keep = set(merged) | {ranks[bytes([b])] for b in range(256)}
    return {t: k for t, k in ranks.items() if k in keep and t.decode("utf-8", "ignore") not in special}


class Uneven(Exception):
    """A segment that cannot be encoded without its neighbours."""


class Segments(dict):
    """Ids of `` segment`` for segments between single spaces; they meet no neighbour in any merge."""

    def __init__(self, encode, kind: str) -> None:
        self.encode, self.code = encode, {"<u2": "H", "<u4": "I"}[kind]

    def __missing__(self, segment: str) -> bytes:
        if not segment or segment[0].isspace() or segment[-1].isspace() or not PLAIN.fullmatch(segment):
            raise Uneven
        if len(self) >= KNOWN:
            self.clear()
        ids = array(self.code, self.encode(" " + segment))
        if byteorder == "big":
            ids.byteswap()
        out = self[segment] = ids.tobytes()
        return out


class Encoder:
    """Texts to ids as the tokenizer gives them.

    A space between two characters that are not white space always begins a
    token group, so segments between such spaces are encoded once and remembered.
    Texts that do not divide this way, or with characters that regex engines may
    class differently, go to the tokenizer whole.
    """

    def __init__(self, spec: bytes) -> None:
        self.whole = Tokenizer.from_buffer(spec)
        self.whole.encode_special_tokens = True
        ranks = as_ranks(json.loads(spec))
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.fast = ranks and tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = Segments(self.fast, self.kind)

    def __call__(self, text: str) -> bytes:
        if self.fast:
            first, *rest = text.split(" ")
            try:
                known = self.known
                parts = [known[s] for s in rest]
                if not first or not first[-1].isspace() and PLAIN.fullmatch(first):
                    return np.array(self.fast(first), self.kind).tobytes() + b"".join(parts)
            except Uneven:
                if all(PLAIN.fullmatch(s) for s in (first, *rest) if s):
                    return np.array(self.fast(text), self.kind).tobytes()
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


def encoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, part, before (tokens earlier in the partition), n, ids with the separator, as little-endian integers."""
    spec = rows.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())  # a vocabulary file, the same for any corpus

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, before, part = Encoder(spec.value), 0, TaskContext.get().partitionId()
        end, width = np.array([SEPARATOR], of.kind).tobytes(), np.dtype(of.kind).itemsize
        for pdf in batches:
            ids = [of(t) + end for t in pdf["text"]]
            n = np.array([len(x) // width for x in ids], np.int64)
            at = before + n.cumsum() - n
            before += int(n.sum())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "part": part, "before": at, "n": n, "width": width, "ids": ids})

    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(encode, "doc_id string, part int, before long, n long, width int, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset, padded.

    ``padded`` is the length to which the piece's sequence is filled up.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = cut_lineage(encoded(id_text(docs, id_col, text_col), tokenizer))
    totals = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n_part"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per partition, in the prefix sum and in the broadcast
    places = totals.select("part", F.coalesce(F.sum("n_part").over(upto), F.lit(0)).alias("base"), F.sum("n_part").over(every).alias("total"))
    rows = rows.join(F.broadcast(places), "part").withColumn("at", F.col("base") + F.col("before"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, n, width, ids, at, total in zip(*(pdf[c] for c in ("doc_id", "n", "width", "ids", "at", "total")), strict=True):
                whole = np.frombuffer(ids, f"<u{width}").astype("<u4")
                edges = [0, *range(window - at % window, n, window), n]
                for start, stop in zip(edges, edges[1:], strict=False):
                    seq, offset = divmod(at + start, window)
                    left = min(window, total - seq * window)
                    padded = window if left == window else min(window, 1 << (left - 1).bit_length())
                    out.append((doc, start, stop - start, whole[start:stop].tobytes(), n, seq, offset, padded))
                    if len(out) >= 20_000:
                        yield frame(out)
                        out = []
            yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded"])

    schema = "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded long"
    out = rows.select("doc_id", "n", "width", "ids", "at", "total").mapInPandas(cut, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
