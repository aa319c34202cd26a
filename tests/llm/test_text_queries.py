"""Text queries: against SQL where there is some, else against a plain computation."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from conftest import TABLES
from panelkit.llm import bpe_tree, lm_automaton
from panelkit.llm.queries import ORACLES, QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def held(i, n, rest):
    return zlib.crc32(str(i).encode()) % n == rest


def auc(y, s):
    rank = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_against_sql(spark, duck, key):
    got = QUERIES[key](spark, SF).toPandas()
    want = duck.execute(ORACLES[key]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = lambda x: x[cols].sort_values(cols).reset_index(drop=True)
    assert order(got).equals(order(want).astype(got[cols].dtypes.to_dict()))


def test_quality_classifier_on_held_out_rows(spark, duck, texts):
    got = QUERIES["op2_quality_classifier"](spark, SF).toPandas().set_index("doc_id")
    assert set(got.index) == set(texts) and got["score"].between(0, 1).all()
    assert all(got["held_out"] == [held(i, 5, 0) for i in got.index])
    assert all(got["predicted"] == (got["score"] >= 0.3))
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    rest = [i for i in labels if held(i, 5, 0)]
    assert auc(np.array([labels[i] for i in rest]), got.loc[rest, "score"].to_numpy()) > 0.9


def test_url_filters(spark, duck):
    got = {r["page_id"]: r for r in QUERIES["op3_url_filters"](spark, SF).collect()}
    for page, url in duck.execute("SELECT page_id, url FROM pages").fetchall():
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        assert (got[page]["host"], got[page]["path"]) == (host, path)
        fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert got[page]["rule"] == rule
        assert got[page]["verdict"] == (verdict or got[page]["verdict"]) and got[page]["verdict"] in ("allow", "block")


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(sets):
    """Exact: every pair that shares a shingle is compared."""
    by, shared, root = defaultdict(list), Counter(), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += 1

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(sets)
    got = QUERIES["op4_near_duplicates"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_language_on_held_out_rows(spark, duck):
    got = {r["doc_id"]: r for r in QUERIES["op5_language_id"](spark, SF).collect()}
    langs = duck.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall()
    rest = [(i, x) for i, x in langs if held(i, 4, 2)]
    assert all(got[i]["held_out"] for i, _ in rest)
    assert sum(got[i]["lang_pred"] == x for i, x in rest) > 0.95 * len(rest)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_lm_scores(spark, texts):
    words = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    train = [w for i, w in words.items() if not held(i, 7, 2)]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    frequent = {w for w, k in c.items() if w is not None and k >= lm_automaton.SHARE * n}
    visits = {w: c[w] for w in frequent} | {"begin": len(train)}
    arcs = Counter((p, x) for w in train for p, x in zip(["begin", *w], w, strict=False) if p in visits)
    mu = lm_automaton.MU
    p1 = lambda x: (c[x] + lm_automaton.A) / (n + lm_automaton.A * (v + 1))
    assert math.isclose(sum(map(p1, c)) + p1(b"\0 unseen"), 1)
    for r in QUERIES["op6_lm_scoring"](spark, SF).collect():
        w = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"]) == (held(r["doc_id"], 7, 2), len(w), sum(c[x] > 0 for x in w))
        assert r["train_tokens"] == n
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        want = 0.0
        for p, x in zip(["begin", *w], w, strict=False):
            want += math.log10((arcs[p, x] + mu * p1(x)) / (visits[p] + mu) if p in visits else p1(x))
        assert math.isclose(r["score"], want, rel_tol=1e-9)


def test_packing(spark, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in texts.items()}
    rows = QUERIES["op7_packing"](spark, SF).toPandas()
    for doc, pieces in rows.sort_values("start").groupby("doc_id"):
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and 0 < p.length <= 1024 and p.doc_tokens == len(ids[doc])
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][p.start : at], "<u4").tobytes())
        assert at == len(ids[doc])
    assert set(rows["doc_id"]) == set(texts)
    total = 0
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"] == s["length"].cumsum() - s["length"]).all()
        total += s["length"].sum() < 1024
        assert s["padded"].nunique() == 1 and s["padded"].iloc[0] >= s["length"].sum()
    assert total <= 1


def test_byte_bpe(spark, texts):
    ranks = bpe_tree.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in QUERIES["op10_byte_bpe"](spark, SF).collect():
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)).encode())
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode())


def test_pipeline(spark, texts):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert set(rows["doc_id"]) <= set(texts)
    assert rows.groupby("sequence_id")["length"].sum().sort_index().iloc[:-1].eq(1024).all()
    kept = set(rows["doc_id"])
    sets = {i: shingles(texts[i]) for i in kept}
    assert all(i == j for i, j in components(sets).items())
    assert len(kept) > 0.7 * len(texts)
