"""Conversations are repaired by the cheapest edits that make their roles take turns.

A repaired conversation has role initials ``(s?(ua)+)?``. A row is kept (free),
gets the role user or assistant (2), or is deleted (3); blank and duplicate rows
must be deleted; rows with an empty text may be inserted anywhere (2); a row
that stays although its text is truncated costs 1 more. Of several cheapest ways
the one whose edits, written as letters D, I, K and R, come first in ASCII wins.

``edits`` streams the rows of a partition, sorted by conversation and turn, through
a Viterbi search with four states: nothing yet, after the system row, after a
user row, after an assistant row. Every state that can still win has one
survivor, a leaf in a tree of backpointers. A node counts the nodes that point to
it, so what no survivor needs is freed, and as soon as all survivors share an
ancestor the edits up to it are final and leave. A survivor whose cost is above
another's by more than any continuation can make up is dropped, which lets the
others coalesce. Where two ways to a state cost the same, the letters behind
their common ancestor are compared, all of them, as none is a prefix of the
other: both have dealt with the same rows, and an insertion costs. Memory is
the unresolved part of one conversation, in which rows that must be deleted hold
no text, and not the conversation; the output of a conversation is streamed as well.

Duplicates are found beforehand, by a window over equal rows, not by a set that
grows with the conversation.

Defined cases: a null role or text is one space; null turns come first; equal
turns are ordered by role and a hash of the text; rows that repeat are duplicates; a null
conversation id is one conversation; ``present`` can mark rows that only name
their conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the row that may be made or inserted
ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETED, REROLED, INSERTED, TRUNCATED = 3, 2, 2, 1
#: What may be lost at most by going on from the second state instead of the first.
LOSS = {
    (START, SYSTEM): 7, (START, USER): 5, (START, ASSISTANT): 3, (SYSTEM, START): 0, (SYSTEM, USER): 2, (SYSTEM, ASSISTANT): 0,
    (USER, START): 2, (USER, SYSTEM): 2, (USER, ASSISTANT): 2, (ASSISTANT, START): 0, (ASSISTANT, SYSTEM): 4, (ASSISTANT, USER): 2,
}
BLANKS = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
ROWS_OUT = 2000  # edits per batch
OUT = "conv_id string, no_id boolean, turn bigint, role string, edit string, new_role string, new_text string, fault string"


class Node:
    """An edit, the one before it, and the number of survivors and nodes that point here."""

    __slots__ = ("before", "depth", "letter", "new_role", "refs", "row")

    def __init__(self, before: Node | None, letter: str, row: tuple | None, new_role: str | None):
        self.before, self.letter, self.row, self.new_role = before, letter, row, new_role
        self.depth = before.depth + 1 if before else 0
        self.refs = 0
        if before:
            before.refs += 1


def release(node: Node | None) -> None:
    """Give up one pointer to a node; nodes without any are freed up the tree."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        above, node.before = node.before, None
        node = above


def first_of(a: Node, b: Node) -> bool:
    """Whether the letters that lead to a come before those that lead to b, from their common ancestor on."""
    x, y = [], []
    while a is not b:
        if a.depth >= b.depth:
            x.append(a.letter)
            a = a.before
        else:
            y.append(b.letter)
            b = b.before
    return x[::-1] < y[::-1]


class Viterbi:
    """Survivors of one conversation; ``take`` and ``end`` return the nodes that have become final."""

    def __init__(self) -> None:
        self.root = Node(None, "", None, None)
        self.root.refs = 1
        self.ways: dict[int, tuple[int, Node]] = {START: (0, self.root)}

    def _offer(self, ways: dict, state: int, cost: int, before: Node, letter: str, row: tuple | None, role: str | None) -> None:
        old = ways.get(state)
        if old and old[0] < cost:
            return
        new = Node(before, letter, row, role)
        if old and old[0] == cost and not first_of(new, old[1]):
            new.refs = 1
            release(new)
            return
        new.refs = 1
        ways[state] = (cost, new)
        if old:
            release(old[1])

    def _insertions(self, ways: dict) -> None:
        """At most two in a row are of use: a third brings back the state of the first."""
        for states in ((START, SYSTEM), (USER,), (ASSISTANT,)):
            for s in states:
                if s in ways:
                    cost, node = ways[s]
                    self._offer(ways, NEXT[s], cost + INSERTED, node, "I", None, ROLE[NEXT[s]])

    def _prune(self, ways: dict) -> None:
        for s in list(ways):
            cost = ways[s][0]
            if any(t != s and other[0] + LOSS[s, t] < cost for t, other in ways.items()):
                release(ways.pop(s)[1])

    def _final(self) -> Iterator[Node]:
        """Nodes from the root to the first one at which survivors part."""
        leaves = {id(n) for _, n in self.ways.values()}
        path, n = [], next(iter(self.ways.values()))[1]
        if self.root.refs > 1:
            return
        while n is not self.root:
            path.append(n)
            n = n.before
        while self.root.refs == 1 and id(self.root) not in leaves:
            self.root = path.pop()  # the only child lies on every path
            self.root.before = None
            yield self.root

    def take(self, row: tuple, initial: str, must_go: bool, cut: bool) -> Iterator[Node]:
        """One more row: deletion, keeping or another role, each after any insertions."""
        self._insertions(self.ways)
        ways: dict[int, tuple[int, Node]] = {}
        for s, (cost, node) in self.ways.items():
            self._offer(ways, s, cost + DELETED, node, "D", row, None)
            if not must_go:
                if (s, initial) in KEEP:
                    self._offer(ways, KEEP[s, initial], cost + cut, node, "K", row, None)
                self._offer(ways, NEXT[s], cost + REROLED + cut, node, "R", row, ROLE[NEXT[s]])
        for _, node in self.ways.values():
            release(node)
        self.ways = ways
        self._prune(ways)
        yield from self._final()

    def end(self) -> Iterator[Node]:
        """The cheapest whole way, ties by its letters; what is left of it."""
        self._insertions(self.ways)
        whole = [self.ways.pop(s) for s in (START, ASSISTANT) if s in self.ways]
        for _, node in self.ways.values():
            release(node)
        best = whole[0]
        for other in whole[1:]:
            if other[0] < best[0] or (other[0] == best[0] and first_of(other[1], best[1])):
                best, other = other, best
            release(other[1])
        left, n = [], best[1]
        while n is not self.root:
            left.append(n)
            n = n.before
        self.ways = {}
        yield from reversed(left)


def faulted(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    """conv_id, no_id, turn, role, text and fault of every row, the first of blank, duplicate and truncated."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("conv_id"),
        F.col(conv_col).isNull().alias("no_id"),
        F.col(turn_col).cast("long").alias("turn"),
        fill(role_col).alias("role"),
        fill(text_col).alias("text"),
        (F.lit(True) if present is None else present).alias("present"),
    )
    # rows that only name their conversation are not equal to others
    same = Window.partitionBy("conv_id", "no_id", "present", "role", "th", "text").orderBy("turn")
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("copy", F.row_number().over(same) > 1)
    end = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(end == "", BLANK).when(F.col("copy"), DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT)
    # a row that must go is not shown again, so it needs no text
    shown = F.col("present") & ~F.coalesce("fault", F.lit("")).isin(BLANK, DUPLICATE)
    return rows.withColumn("fault", fault).withColumn("text", F.when(shown, F.col("text")))


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, ROWS_OUT)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order; a conversation without a row gives one row without an edit."""

    def shown(key: tuple, node: Node) -> tuple:
        if node.letter == "I":
            return *key, None, None, "I", node.new_role, "", None
        turn, role, text, fault = node.row
        after = (None, None) if node.letter == "D" else (node.new_role or role, text)
        return *key, turn, role, node.letter, *after, fault

    def close(key: tuple, search: Viterbi, any_row: bool) -> Iterator[tuple]:
        if any_row:
            yield from (shown(key, n) for n in search.end())
        else:
            yield (*key, *[None] * 6)

    def run() -> Iterator[tuple]:
        key, search, any_row = None, None, False
        for b in batches:
            for conv, no_id, turn, role, text, present, fault in _columns(b, "conv_id", "no_id", "turn", "role", "text", "present", "fault"):
                if (conv, no_id) != key:
                    if search:
                        yield from close(key, search, any_row)
                    key, search, any_row = (conv, no_id), Viterbi(), False
                if present:
                    any_row = True
                    final = search.take((turn, role, text, fault), role[:1], fault in (BLANK, DUPLICATE), fault == CUT)
                    yield from (shown(key, n) for n in final)
        if search:
            yield from close(key, search, any_row)

    text = pa.string()
    kinds = [text, pa.bool_(), pa.int64(), text, text, text, text, text]
    yield from _batches(run(), pa.schema([(f.split()[0], t) for f, t in zip(OUT.split(", "), kinds, strict=True)]))


def edits(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """Edits (D, I, K, R) of all conversations, in order within each, whole conversations in one partition.

    conv_id (text, with no_id for null), turn and role as they were, edit,
    new_role and new_text (null where deleted) and fault. The repaired
    conversation is what has a new_role. A conversation of which no row is
    ``present`` has one row with a null edit.
    """
    rows = faulted(conversations, conv_col, turn_col, role_col, text_col, present).repartition("conv_id", "no_id")
    rows = rows.sortWithinPartitions("conv_id", "no_id", F.col("turn").asc_nulls_first(), "role", "th", "copy")
    return rows.mapInArrow(_edits, OUT)


class _Summary:
    def __init__(self) -> None:
        self.count = dict.fromkeys([BLANK, DUPLICATE, CUT, "illegal", "cost"], 0)
        self.turns, self.low, self.high = 0, None, None
        self.audit, self.sha, self.before, self.joint = bytearray(), hashlib.sha256(), None, b""

    def add(self, turn: int | None, role: str | None, edit: str, new_role: str | None, new_text: str | None, fault: str | None) -> None:
        self.audit += edit.encode()
        self.count["cost"] += {"K": 0, "R": REROLED, "D": DELETED, "I": INSERTED}[edit]
        if edit != "I":
            if fault:
                self.count[fault] += 1
                self.count["cost"] += TRUNCATED * (fault == CUT and edit != "D")
            if self.before is not None:
                self.count["illegal"] += self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if new_role is not None:
            self.sha.update(self.joint + f"{new_role}:{new_text}".encode())
            self.joint = b"\n"

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.count.values(), self.audit.decode(), self.sha.hexdigest()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from edits as ``edits`` orders them."""

    def run() -> Iterator[tuple]:
        key, of = None, None
        for b in batches:
            for conv, no_id, *edit in _columns(b, "conv_id", "no_id", "turn", "role", "edit", "new_role", "new_text", "fault"):
                if (conv, no_id) != key:
                    if of:
                        yield *key, *of.row()
                    key, of = (conv, no_id), _Summary()
                if edit[2] is not None:
                    of.add(*edit)
        if of:
            yield *key, *of.row()

    longs = [(c, pa.int64()) for c in ("gaps", BLANK, DUPLICATE, CUT, "illegal", "cost")]
    text = [(c, pa.string()) for c in ("audit", "repaired_sha256")]
    yield from _batches(run(), pa.schema([("conv_id", pa.string()), ("no_id", pa.bool_()), *longs, *text]))


def summaries(edited: DataFrame) -> DataFrame:
    """Per conversation: gaps in its turns, faults, illegal neighbours, cost, the edits' letters and a digest of what they leave."""
    longs = ", ".join(f"{c} bigint" for c in ("gaps", BLANK, DUPLICATE, CUT, "illegal", "cost"))
    return edited.mapInArrow(_summaries, f"conv_id string, no_id boolean, {longs}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """A table of conversations with faults put in by a hash of conversation and turn, and the rows of it that count.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4
    makes it the user's. A dropped row stays to name its conversation.
    """
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn")).cast("binary")) % 20
    out = conversations.select("conv_id", "turn", fill("role").alias("role"), fill("text").alias("text"), kind.alias("kind"))
    out = out.withColumn("text", F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return out.withColumn("copy", twice), F.col("kind") != 0
