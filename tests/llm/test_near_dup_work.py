"""The parts of the near-duplicate search against plain counts, and the work they lay out."""

import random

import numpy as np
import pytest

from panelkit.llm import near_dup


def plain(text):
    w = text.encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


class Counting:
    """numpy, with the elements of all arrays that its functions return added up."""

    def __init__(self):
        self.n = 0

    def __getattr__(self, name):
        f = getattr(np, name)
        if not callable(f) or isinstance(f, type | np.ufunc):
            return f

        def counted(*args, **more):
            out = f(*args, **more)
            self.n += getattr(out, "size", 0)
            return out

        return counted


@pytest.fixture
def work(monkeypatch):
    def of(f):
        monkeypatch.setattr(near_dup, "np", counting := Counting())
        out = f()
        monkeypatch.setattr(near_dup, "np", np)
        return counting.n, out

    return of


def test_sets_of_texts_hashed_together():
    rng = random.Random(1)
    words = ["a", "b", "Ä", "ab", "ba", "x" * 5000, "x" * 4999 + "y", "été", "\x1c", "中文", "-", "\x00"]
    texts = ["", " ", "\n\t\x0b\x0c\r", "one", "One two", "a b c d", "a b c d e", "A  b\nc\td\x0be", "a\xa0b c", "x" * 200_000, "ab " * 60_000, "last"]
    texts += [rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randrange(12))) for _ in range(300)]
    texts.append(" ".join(f"w{k}" for k in range(30_000)))
    got, want = near_dup.Shingler()(texts), [plain(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    assert all((s[1:] > s[:-1]).all() for s in got)
    hashes = {x for s in got for x in s.tolist()}
    assert len(hashes) == len({x for w in want for x in w})
    for i in range(0, len(texts), 29):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])
    for t, s in zip(texts, got, strict=True):
        assert np.array_equal(near_dup.Shingler()([t])[0], s)


def test_tokens_are_those_of_each_set():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (1, 2, 5, 300, 100_000, 3, 40_000, 1)]
    roots, steps = near_dup.minwise(sets, 7)
    assert (roots.shape, steps.shape) == ((8, 7), (8, 7 * near_dup.STEPS))
    for k, s in enumerate(sets):
        one = near_dup.minwise([s], 7)
        assert np.array_equal(one[0][0], roots[k]) and np.array_equal(one[1][0], steps[k])
    half = near_dup.minwise([sets[3], sets[3][:150]], 7)
    assert 0.2 < np.mean(np.concatenate([half[0][0] == half[0][1], half[1][0] == half[1][1]])) < 0.8


def members(n, groups, seed=3):
    """Sizes and sketches: every ``groups``-th member belongs to one group and differs from it in 20 of 63 tokens."""
    rng = np.random.default_rng(seed)
    base, sketch = rng.integers(0, 32768, (groups, 63)), rng.integers(0, 32768, (n, 63))
    for i in range(0, n, 3):
        at = rng.choice(63, 43, replace=False)
        sketch[i, at] = base[i % groups, at]
    sketch[:, 0] = 7
    return rng.integers(80, 130, n), sketch.astype(np.int16)


@pytest.mark.parametrize("n", [2, 20, 64, 65, 700])
def test_pairs_that_sketches_allow(n):
    size, sketch = members(n, 4)
    agree = (sketch[:, None] == sketch[None]).sum(2)
    fits = (agree >= 29) & (100 * np.minimum.outer(size, size) >= 80 * np.maximum.outer(size, size))
    a, b = near_dup.alike(size, sketch, 29, 80)
    got = sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
    assert got == [(i, j) for i in range(n) for j in range(i + 1, n) if fits[i, j]]


def test_members_with_one_common_line_form_no_pairs(work):
    """All share the token of the node and nothing else."""
    laid = []
    for n in (500, 2000):
        size, sketch = np.full(n, 100), np.random.default_rng(4).integers(0, 32768, (n, 63)).astype(np.int16)
        sketch[:, 0] = 7
        cells, (a, _) = work(lambda: near_dup.alike(size, sketch, 31, 80))  # noqa: B023
        assert not len(a)
        laid.append(cells)
    assert laid[1] < 6 * laid[0]


def components(ids, links):
    root = {i: i for i in ids}
    for a, b in links:
        x, y = root[a], root[b]
        root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return root


def test_links_tie_components_of_any_form():
    rng = np.random.default_rng(5)
    for _ in range(60):
        base = rng.integers(0, 1 << 60, (int(rng.integers(1, 5)), 60), dtype=np.uint64)
        sets = []
        for _ in range(int(rng.integers(1, 40))):
            s = base[rng.integers(len(base))].copy()
            s[rng.choice(60, int(rng.integers(0, 12)), replace=False)] += np.uint64(1 + rng.integers(2))
            sets.append(np.unique(s[: int(rng.integers(0, 61))] if rng.random() < 0.3 else s))
        ids = np.arange(len(sets)) * 3
        shared = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
        want = [
            (ids[i], ids[j]) for i in range(len(sets)) for j in range(i)
            if shared[i][j] and 100 * shared[i][j] >= 80 * (len(sets[i]) + len(sets[j]) - shared[i][j])
        ]
        assert components(ids, near_dup.spanning(ids, sets, 80)) == components(ids, want)


def test_work_grows_with_the_near_copies_of_a_group(work):
    rng, laid = np.random.default_rng(6), []
    for n in (300, 1200):
        base = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
        sets = [base.copy() for _ in range(n)]
        for s in sets:
            s[rng.choice(200, 3, replace=False)] = rng.integers(0, 1 << 60, 3, dtype=np.uint64)
        sets = [np.sort(s) for s in sets]
        cells, links = work(lambda: near_dup.spanning(np.arange(n), sets, 80))  # noqa: B023
        assert len(links) == n - 1
        laid.append(cells)
    assert laid[1] < 6 * laid[0]
