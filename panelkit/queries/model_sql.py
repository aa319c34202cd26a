"""SQL for fits with two regressors: sums, Cramer's rule, fixed iteration counts."""

from __future__ import annotations

from .base import cte

ITERATIONS = 8


def linear_ctes(p: str, src: str, y: str, x1: str, x2: str, entity: str | None) -> None:
    """``<p>d`` rows with deviations and residual u, ``<p>f`` the fit.

    With an entity the deviations are from its means (within), else overall.
    """
    over = f"(PARTITION BY {entity})" if entity else "()"
    groups = f"count(DISTINCT {entity})" if entity else "1"
    cte(
        f"{p}d0",
        f"SELECT *, {y} AS yy, {x1} - avg({x1}) OVER {over} AS d1, {x2} - avg({x2}) OVER {over} AS d2, {y} - avg({y}) OVER {over} AS dy FROM {src}",
        (src,),
    )
    cte(
        f"{p}f",
        f"""SELECT *, rss / df AS s2, c / det AS i11, -b / det AS i12, a / det AS i22, my - b1 * m1 - b2 * m2 AS b0 FROM (
              SELECT *, tss - b1 * p - b2 * q AS rss, n - g - 2 AS df FROM (
                SELECT *, (c * p - b * q) / det AS b1, (a * q - b * p) / det AS b2 FROM (
                  SELECT *, a * c - b * b AS det FROM (
                    SELECT sum(d1 * d1) AS a, sum(d1 * d2) AS b, sum(d2 * d2) AS c, sum(d1 * dy) AS p, sum(d2 * dy) AS q, sum(dy * dy) AS tss,
                      count(*) AS n, {groups} AS g, avg({x1}) AS m1, avg({x2}) AS m2, avg(yy) AS my FROM {p}d0))))""",
        (f"{p}d0",),
    )
    cte(f"{p}d", f"SELECT r.*, r.dy - f.b1 * r.d1 - f.b2 * r.d2 AS u FROM {p}d0 r, {p}f f", (f"{p}d0", f"{p}f"))
    if entity:
        cte(
            f"{p}fe",
            f"SELECT {entity}, count(*) AS n_i, avg(yy) - max(f.b1) * avg({x1}) - max(f.b2) * avg({x2}) AS fe FROM {p}d0, {p}f f GROUP BY 1",
            (f"{p}d0", f"{p}f"),
        )
        cte(
            f"{p}v",
            f"""SELECT {entity}, n_i, b1, b2, my - b1 * m1 - b2 * m2 AS b0, tss - b1 * p - b2 * q AS rss, n_i - 3 AS df FROM (
                  SELECT *, (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2 FROM (
                    SELECT {entity}, sum(d1 * d1) AS a, sum(d1 * d2) AS b, sum(d2 * d2) AS c, sum(d1 * dy) AS p, sum(d2 * dy) AS q,
                      sum(dy * dy) AS tss, count(*) AS n_i, avg({x1}) AS m1, avg({x2}) AS m2, avg(yy) AS my FROM {p}d0 GROUP BY 1))""",
            (f"{p}d0",),
        )


def poisson_ctes(p: str, src: str, y: str, x1: str, x2: str, entity: str) -> None:
    """``<p>f`` slopes and Hessian, ``<p>e`` entity sums at the last iterate."""
    cte(f"{p}s", f"SELECT *, CAST({y} AS DOUBLE) AS yy, CAST({x1} AS DOUBLE) AS z1, CAST({x2} AS DOUBLE) AS z2 FROM {src}", (src,))
    cte(f"{p}b0", "SELECT CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2")
    for i in range(ITERATIONS + 1):
        cte(
            f"{p}e{i}",
            f"""SELECT {entity}, count(*) AS n_i, sum(yy) AS yt, sum(w) AS s, sum(w * z1) AS s1, sum(w * z2) AS s2, sum(w * z1 * z1) AS s11,
                  sum(w * z1 * z2) AS s12, sum(w * z2 * z2) AS s22, sum(yy * z1) AS q1, sum(yy * z2) AS q2
                FROM (SELECT r.*, exp(b1 * z1 + b2 * z2) AS w FROM {p}s r, {p}b{i}) GROUP BY 1""",
            (f"{p}s", f"{p}b{i}"),
        )
        cte(
            f"{p}h{i}",
            f"""SELECT sum(q1) - sum(yt / s * s1) AS g1, sum(q2) - sum(yt / s * s2) AS g2, sum(yt / s * (s11 - s1 * s1 / s)) AS h11,
                  sum(yt / s * (s12 - s1 * s2 / s)) AS h12, sum(yt / s * (s22 - s2 * s2 / s)) AS h22 FROM {p}e{i}""",
            (f"{p}e{i}",),
        )
        if i < ITERATIONS:
            cte(
                f"{p}b{i + 1}",
                f"""SELECT b1 + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS b1, b2 + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b2
                    FROM {p}b{i}, {p}h{i}""",
                (f"{p}b{i}", f"{p}h{i}"),
            )
    n = ITERATIONS
    cte(
        f"{p}f",
        f"""SELECT b1, b2, h22 / (h11 * h22 - h12 * h12) AS v11, -h12 / (h11 * h22 - h12 * h12) AS v12, h11 / (h11 * h22 - h12 * h12) AS v22
            FROM {p}b{n}, {p}h{n}""",
        (f"{p}b{n}", f"{p}h{n}"),
    )
    cte(
        f"{p}e",
        f"SELECT {entity}, n_i, yt, ln(yt / s) AS fe, s1 / s AS xb1, s2 / s AS xb2 FROM {p}e{n} WHERE yt > 0",
        (f"{p}e{n}",),
    )
    cte(
        f"{p}r",
        f"""SELECT r.*, lam, yy - lam AS u, (z1 - xb1) * (yy - lam) AS sc1, (z2 - xb2) * (yy - lam) AS sc2 FROM (
              SELECT r.*, xb1, xb2, exp(b1 * z1 + b2 * z2 + fe) AS lam FROM {p}s r JOIN {p}e USING ({entity}), {p}f) r""",
        (f"{p}s", f"{p}e", f"{p}f"),
    )


def inverse_cte(name: str, cells: str, k: int, needs: tuple[str, ...]) -> None:
    """``name`` (i, j, v): the inverse of the k x k matrix that ``cells`` gives as (i, j, v), counted from 1.

    Rows are lists, with the unit matrix behind; column by column is eliminated.
    """
    body = f"""SELECT list(r ORDER BY i) AS m FROM (
                 SELECT i, list_concat(list(v ORDER BY j), list_transform(range(1, {k + 1}), lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS r
                 FROM ({cells}) GROUP BY i)"""
    for c in range(1, k + 1):
        body = f"""SELECT list_transform(m, lambda r, i: CASE WHEN i = {c} THEN list_transform(r, lambda v: v / r[{c}])
                     ELSE list_transform(r, lambda v, j: v - r[{c}] * m[{c}][j] / m[{c}][{c}]) END) AS m FROM ({body})"""
    cte(
        name,
        f"""SELECT i, unnest(range(1, {k + 1})) AS j, unnest(m[i][{k + 1}:{2 * k}]) AS v
            FROM (SELECT m, unnest(range(1, {k + 1})) AS i FROM ({body}))""",
        needs,
    )
