"""Local lines at every row from prefix moments against direct fits."""

import numpy as np
import pytest

from panelkit.operators import local_lines, smooth


def direct(y, k, step, passes):
    """Each line from its own window, row by row."""
    n = len(y)
    w, pos = np.ones(n), np.arange(1, n + 1)
    anchors = local_lines.anchors_for(1, n, n, step)
    for it in range(passes + 1):
        v = []
        for c in anchors:
            left = max(1, min(n - k + 1, c - k // 2))
            p = np.arange(left, left + k)
            h, d = max(c - left, left + k - 1 - c), np.abs(p - c)
            tri = np.where(d <= 0.001 * h, 1.0, (1 - (d / max(h, 1)) ** 3) ** 3)
            weight = np.where(d <= 0.999 * h, tri, 0.0) * w[p - 1] if h else w[p - 1]
            if not weight.sum():
                v.append(np.nan)
                continue
            level, mean = np.average(y[p - 1], weights=weight), np.average(p - c, weights=weight)
            var = np.average((p - c - mean) ** 2, weights=weight)
            flat = np.sqrt(var) <= 0.001 * (n - 1)
            v.append(level if flat else level - mean * np.average((p - c - mean) * y[p - 1], weights=weight) / var)
        fit = np.interp(pos, anchors, v)
        if it < passes:
            w = local_lines.robust(y, fit, w)
    return fit


def series(n, seed=1):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.normal(size=n)) + rng.standard_t(2, size=n)


@pytest.mark.parametrize(("n", "span", "step"), [(1, 0.7, 1), (2, 0.7, 1), (3, 0.7, 1), (40, 2 / 3, 1), (700, 0.05, 1), (5000, 2 / 3, 1), (2000, 0.3, 20)])
def test_one_task(n, span, step):
    y = series(n)
    k = min(n, max(2, int(span * n + 1e-7)))
    assert np.allclose(local_lines.whole_entity(y, k, step, 3), direct(y, k, step, 3), atol=1e-9)


@pytest.mark.parametrize(("span", "share"), [(2 / 3, 0.0), (0.1, 0.0), (2 / 3, 0.01)])
def test_tiles_give_the_same(spark, span, share):
    """5,000 rows in tiles of 900, an entity that fits one task beside it, and a null."""
    y = {"a": series(5000), "b": series(300, 2), "c": series(1)}
    rows = [(e, i * 3, float(v)) for e, vs in y.items() for i, v in enumerate(vs)] + [("b", 1, None)]
    df = spark.createDataFrame(rows, "e string, t int, y double")
    got = smooth.lowess(df, "e", "t", "y", span=span, delta_share=share, whole_rows=1000, tile_rows=900, size=512).toPandas()
    assert len(got) == 5301
    for e, vs in y.items():
        n = len(vs)
        k = min(n, max(2, int(span * n + 1e-7)))
        fit = got[got["e"] == e].sort_values("pos")["trend"].to_numpy()
        assert np.allclose(fit, direct(vs, k, max(1, int(share * (n - 1))), 3), atol=1e-8)


def entities(spark, n_of, seed=3):
    """Rows of entity i with n_of[i] values, some series in many entities, and a frame of them."""
    known = {}
    for i, n in enumerate(n_of):
        known.setdefault((i % 4, n), series(n, seed + i))
    rows = [(i, t * 2, float(v)) for i, n in enumerate(n_of) for t, v in enumerate(known[i % 4, n])]
    return known, spark.createDataFrame(rows, "e long, t int, y double").repartition(3)


def test_short_entities_are_fitted_together(spark, monkeypatch):
    """No call per entity, and batches that end anywhere within an entity."""

    def alone(*_):
        raise AssertionError("an entity of few rows was fitted alone")

    monkeypatch.setattr(local_lines, "whole_entity", alone)
    monkeypatch.setattr(smooth, "BATCH_ROWS", 300)
    n_of = [(27, 31, 82, 150)[i % 5 % 4] for i in range(120)] + [1, 2, 700]
    known, df = entities(spark, n_of)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = smooth.lowess(df, "e", "t", "y").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(n_of)
    want = {(g, n): direct(y, min(n, max(2, int(2 / 3 * n + 1e-7))), max(1, int(0.01 * (n - 1))), 3) for (g, n), y in known.items()}
    for e, rows in got.groupby("e"):
        rows = rows.sort_values("pos")
        assert list(rows["pos"]) == list(range(1, n_of[e] + 1))
        assert np.array_equal(rows["y"], known[e % 4, n_of[e]])
        assert np.allclose(rows["trend"], want[e % 4, n_of[e]], atol=1e-9)


def test_five_rows_are_their_own_trend(spark):
    """Windows of three rows give weight to one or two of them, whatever rounding leaves of the residuals."""
    y = np.random.default_rng(5).standard_t(2, size=(200, 5))
    rows = [(e, t, float(v)) for e, vs in enumerate(y) for t, v in enumerate(vs)]
    got = smooth.lowess(spark.createDataFrame(rows, "e long, t int, y double"), "e", "t", "y").toPandas()
    assert len(got) == 1000 and np.allclose(got["trend"], got["y"], atol=1e-9)


def test_nan_becomes_null(spark):
    rows = [(e, t, float("nan") if (e, t) == (1, 4) else float(t)) for e in (1, 2) for t in range(5)]
    got = smooth.lowess(spark.createDataFrame(rows, "e long, t int, y double"), "e", "t", "y").collect()
    assert [(r.e, r.t) for r in got if r.y is None] == [(1, 4)] and all(r.trend is not None for r in got if r.e == 2)


def test_a_value_that_is_not_finite_stays_with_its_entity():
    y = np.array([series(60, s) for s in range(3)])
    y[1, 50] = np.nan
    got = local_lines.alike_entities(y, 20, 1, 3)
    for one, fit in zip(y[[0, 2]], got[[0, 2]]):
        assert np.allclose(fit, direct(one, 20, 1, 3), atol=1e-9)
    assert np.array_equal(got[1], local_lines.whole_entity(y[1], 20, 1, 3), equal_nan=True)


@pytest.mark.parametrize(("n", "step"), [(82, 1), (300, 2), (1200, 11)])
def test_table_and_moments_agree(monkeypatch, n, step):
    """Residuals of months or longer: one table for all entities, and moments where it would be too large."""
    y = np.array([series(n, s) for s in range(5)])
    k = int(2 / 3 * n)
    table = local_lines.alike_entities(y, k, step, 3)
    monkeypatch.setattr(local_lines, "TABLE_CELLS", 0)
    assert np.allclose(table, local_lines.alike_entities(y, k, step, 3), atol=1e-9)
    assert np.allclose(table[0], direct(y[0], k, step, 3), atol=1e-9)


def test_the_input_is_computed_once(spark):
    """Counts, positions and lengths read the rows as written, so a fit behind them does not run for each; rows without a key go."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [(e, i, float(i * i % 7)) for e in ("a", "b") for i in range(30)] + [(None, 1, 1.0), ("a", None, 1.0), ("b", 31, None)]
    df = spark.createDataFrame(rows, "e string, t int, y double").mapInPandas(counted, "e string, t int, y double")
    got = smooth.lowess(df, "e", "t", "y").collect()
    assert sorted((r.e, r.t, r.pos) for r in got) == [(e, i, i + 1) for e in ("a", "b") for i in range(30)]
    assert seen.value == len(rows)
