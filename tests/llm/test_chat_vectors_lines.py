"""Conversation repair, vector codes and line deduplication against plain computations, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from panelkit.llm import conversation_repair, line_dedup, vector_codes
from panelkit.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- conversations -----------------------------------------------------------------------------------------------

KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def damage(rows):
    out = defaultdict(list)
    shown = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        out[conv] += {
            0: [],
            1: [(turn, role, "")],
            2: [(turn, role, re.sub("[.!?]", "", text))],
            3: [(turn, role, text)] * 2,
            4: [(turn, "user", text)],
        }.get(kind, [(turn, role, text)])
    return out


def repair(rows):
    """Costs from the end back, then the smallest letter that is on a cheapest way."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    initials, n, never = [r[1][:1] for r in rows], len(rows), 10**9
    cost = [[never] * 4 for _ in range(n)] + [[0, never, never, 0]]

    def moves(i, s):
        out = [("I", 2, i, NEXT[s])]
        if i < n:
            out.append(("D", 3, i + 1, s))
            if faults[i] not in ("b", "d"):
                cut = int(faults[i] == "t")
                out.append(("R", 2 + cut, i + 1, NEXT[s]))
                if (s, initials[i]) in KEEP:
                    out.append(("K", cut, i + 1, KEEP[s, initials[i]]))
        return out

    for i in range(n, -1, -1):
        for _ in range(4):
            for s in range(4):
                cost[i][s] = min([cost[i][s], *[c + cost[j][t] for _, c, j, t in moves(i, s)]])
    i, s, audit, text = 0, 0, "", []
    while i < n or cost[i][s]:
        letter, _, j, t = min(m for m in moves(i, s) if m[1] + cost[m[2]][m[3]] == cost[i][s])
        audit += letter
        if letter in "KR":
            text.append(f"{rows[i][1] if letter == 'K' else {2: 'user', 3: 'assistant'}[t]}:{rows[i][2]}")
        elif letter == "I":
            text.append({2: "user:", 3: "assistant:"}[t])
        i, s = j, t
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, *[faults.count(f) for f in "bdt"], illegal, cost[0][0], audit, sha("\n".join(text))


def test_conversations(spark):
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == {c: repair(x) for c, x in damage(rows).items()}


def random_rows(rng, n):
    texts = ["a.", "b", "", " \n", "c.", "d!", *[f"x{rng.random()}" for _ in range(3)], *[f"y{rng.random()}." for _ in range(3)]]
    return [(i, rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]), rng.choice(texts)) for i in range(n)]


def stream(rows):
    """Letters, and the most nodes that were alive."""
    seen, v, out, most = set(), conversation_repair.Viterbi(), [], 0
    for turn, role, text in rows:
        bare = text.strip(SPACES)
        must_go = not bare or (role, text) in seen
        seen.add((role, text))
        out += [n.letter for n in v.take((turn, role, text, None), role[:1], must_go, not must_go and bare[-1] not in ".!?")]
        alive, below = set(), [n for _, n in v.ways.values()]
        refs = Counter(id(n) for n in below)
        while below:
            n = below.pop()
            if id(n) not in alive:
                alive.add(id(n))
                if n is not v.root:
                    refs[id(n.before)] += 1
                    below.append(n.before)
                assert n.refs >= 1
        assert refs[id(v.root)] == v.root.refs
        most = max(most, len(alive))
    return "".join([*out, *[n.letter for n in v.end()]]), most


def test_survivors_and_ties():
    rng = random.Random(5)
    for _ in range(3000):
        rows = random_rows(rng, rng.randint(0, 14))
        assert stream(rows)[0] == repair(rows)[-2]


def test_survivors_coalesce():
    rng = random.Random(6)
    for _ in range(20):
        rows = random_rows(rng, 400)
        rows = [(t, r, x if not x.strip() else f"{t}{x}") for t, r, x in rows]
        letters, most = stream(rows)
        assert letters == repair(rows)[-2]
        assert most < 100
    assert stream([(i, "user", "") for i in range(3000)])[0] == "D" * 3000


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "hi."), (1, None, None, None), (1, None, "user", "hi."), (1, 7, "assistant", "well"), (1, 7, "assistant", "well"),
        (2, None, None, None), (None, 3, "system", "you."), (None, 4, "user", "é" * 50_000), (3, 1, "", "x."), (3, 2, "assistant", " 　"),
        (4, -(2**62), "user", "a."), (4, 2**62, "assistant", "b\r\n.\r\n"),
    ]
    df = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], "conv_id long, turn long, role string, text string, th int, present int, edit int")
    out = conversation_repair.summaries(conversation_repair.edits(df)).collect()
    plain = defaultdict(list)
    for conv, turn, role, text in rows:
        plain[conv].append((turn, role if role is not None else " ", text if text is not None else " "))
    assert len(out) == len(plain)
    for r in out:
        assert tuple(r)[2:] == repair(plain[None if r["no_id"] else int(r["conv_id"])])
    assert conversation_repair.edits(df.limit(0)).collect() == []
    damaged, present = conversation_repair.damaged(df)
    out = conversation_repair.summaries(conversation_repair.edits(damaged, present=present)).collect()
    want = damage(rows)
    assert {None if r["no_id"] else int(r["conv_id"]): tuple(r)[2:] for r in out} == {c: repair(x) for c, x in want.items()}


# --- vectors -----------------------------------------------------------------------------------------------------


def codes(rows, parts=8, entries=16, rounds=6):
    """Every part is compared with every entry in every round."""
    rows = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    if not rows:
        return []
    length = max(len(r[1]) for r in rows)
    width = max(1, -(-length // parts))
    x = [[math.floor(Fraction(c) * 4096) for c in r[1]] + [0] * (parts * width - len(r[1])) for r in rows]
    cut = [[v[p * width : (p + 1) * width] for v in x] for p in range(parts)]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(rows[i][1])))[:entries]
    book = [[cut[p][i] for i in first] for p in range(parts)]
    far = lambda a, b: sum((u - w) ** 2 for u, w in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [[min(range(len(book[p])), key=lambda e: far(v, book[p][e])) for v in cut[p]] for p in range(parts)]  # noqa: B023
        for p in range(parts):
            for e in set(at[p]) if r < rounds else ():
                mine = [v for v, a in zip(cut[p], at[p], strict=True) if a == e]
                book[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    error = [sum(far(cut[p][i], book[p][at[p][i]]) for p in range(parts)) for i in range(len(rows))]
    total = defaultdict(int)
    for r, e in zip(rows, error, strict=True):
        total[r[2]] += e
    digest = sha(",".join(str(c) for p in book for e in p for c in e))
    fits = lambda n: n if n < 2**63 else None
    return [
        (r[0], "".join(f"{at[p][i]:02x}" for p in range(parts)), fits(error[i]), fits(total[r[2]]), digest) for i, r in enumerate(rows)
    ]


def same_rows(got, want):
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_vector_codes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert same_rows(QUERIES["op12_vector_codes"](spark, SF).collect(), codes(rows))


def test_bounds_are_kept_over_rounds_and_skip_searches(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = vector_codes.learn(df)
    parts = df.count() * vector_codes.PARTS
    assert found.searched[0] == parts and all(n < parts for n in found.searched[1:]) and found.searched[-1] < 0.6 * parts
    assert len(found.history.books) == vector_codes.ROUNDS + 1


def test_net_displacement_is_no_more_than_all_moves():
    rng = np.random.default_rng(2)
    books = [[[tuple(map(int, e)) for e in rng.integers(-99, 99, (3, 2))] for _ in range(2)] for _ in range(4)]
    net = vector_codes.History(books).moves()
    added = sum(vector_codes.History(books[r : r + 2]).moves()[0] for r in range(3))
    assert (net[0] <= added + 1e-6).all() and (net[0] < added - 1).any() and not net[-1].any()


def odd_vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.choice([1, 2, None])) for i in range(40)]
    rows += [(3, rows[3][1], 1), (3, rows[7][1], 2), (None, rows[1][1], 1), (None, None, None), (50, [], 2), (51, [0.5] * 9, 1)]
    rows += [(52, [float("nan")] * 16, 1), (53, [1.0, None], 1), (54, [float("-inf")] * 16, 1), (55, [0.0] * 16, 2), (56, [-0.0] * 16, 2)]
    return rows


@pytest.mark.parametrize("extra", [[], [(60, [3e38] + [1.0] * 15, 1)], [(60, [1e300, -1e308] * 8, 2), (0, [1e9] * 16, None)]])
def test_odd_vectors(spark, extra):
    rows = odd_vectors() + extra
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, v int")
    got = vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    want = codes(rows)
    assert same_rows(got, want)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)], [(1, [0.5] * 8, 1)], [(2, [0.5] * 3, None), (1, [-0.25] * 3, None)]):
        got = vector_codes.compress(spark.createDataFrame(rows, schema))
        assert same_rows(got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect(), codes(rows))


# --- lines -------------------------------------------------------------------------------------------------------


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def deduped(rows, least):
    """rows: (id, text); a document is a distinct pair of them."""
    where = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            where[line_key(line)].add((i, text or ""))
    gone = {k for k, docs in where.items() if k and len(docs) >= least}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("sample", [1, line_dedup.SAMPLE_LINES])
def test_lines_of_all_documents(spark, sample):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = line_dedup.dedup(docs, sample_lines=sample).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert same_rows(got, deduped([tuple(r) for r in docs.select("doc_id", "text").collect()], 10))


@pytest.mark.parametrize("sample", [1, line_dedup.SAMPLE_LINES])
def test_odd_lines(spark, sample):
    many = "\n".join(["Same line", *[f"own {i}" for i in range(300)], " same LINE\t", "ÉTÉ", "été", ""] * 2)
    rows = [(1, many), (1, many), (1, "same line"), (2, "SAME LINE\r\nÉTÉ"), (3, None), (4, ""), (None, "été\nx"), (None, "été\ny"), (None, None)]
    rows += [(5, "\n\n\n"), (6, "　same line"), (7, "\x1csame line"), (8, "été \x0b\x0c")]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], "doc_id long, text string, th int, pos int, keep int, h1 int, _id int")
    for least in (1, 2, 3, 4):
        got = line_dedup.dedup(df, min_docs=least, sample_lines=sample).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
        assert same_rows(got, deduped(rows, least))
    assert line_dedup.dedup(df.limit(0)).collect() == []
    named = df.select(df.doc_id.cast("string").alias("name"), df.text.alias("body"))
    assert line_dedup.dedup(named, id_col="name", text_col="body").count() == len(rows)


def test_bitmaps_list_only_words_that_lose_lines(spark):
    rows = [(i, "\n".join(["same", *[f"{i} {k}" for k in range(200)], "same"])) for i in range(3)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect()
    assert all([tuple(w) for w in r["keep"]] == [(0, ~1), (3, ~(1 << 9))] for r in got)


def test_line_dedup_runs_no_python(spark):
    plan = QUERIES["op13_line_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert "rangepartitioning(h1" in plan and "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
