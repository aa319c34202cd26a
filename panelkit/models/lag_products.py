"""Cross products of many lags of a column, without a column per lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.slices import SLICE_ROWS, with_halo

CHUNK_VALUES = 4_000_000  # values of rows x columns laid out at once


def _whole(batches: Iterator, keys: list[str]) -> Iterator:
    """Groups of equal keys from rows that come sorted by them."""
    import pandas as pd

    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        cuts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
        for a, b in zip(cuts, cuts[1:]):
            yield pdf.iloc[a:b]
        held = pdf.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield held


def lag_products(
    df: DataFrame, entity: str, t: str, u: str, xs: list[str], order: int, size: int = SLICE_ROWS
) -> np.ndarray:
    """Z'Z of z = (xs, u at t-1 to t-order, u) over all rows; a lag without a row counts as zero.

    Entities are cut into slices of the time index, with ``order`` times before each
    copied in. A task lays the times of a slice out as one array, of which the lags of
    a row are a window, and adds up the products of all its slices; the sums of
    the tasks are added row by row of the matrix. Only Z'Z reaches the driver.
    Rows have a non-null entity, time and u, and no time twice.
    """
    k = len(xs) + order + 1
    keys = [entity, "_slice"]
    rows = df.select(F.col(entity), F.col(t).cast("long").alias("_t"), F.col(u).cast("double").alias("_u"), *[F.col(x).cast("double") for x in xs])
    rows = with_halo(rows, "_t", order, 0, size)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    chunk = max(1, CHUNK_VALUES // k)

    def partial(batches: Iterator) -> Iterator:
        import pandas as pd

        total = None
        for g in _whole(batches, keys):
            times, core = g["_t"].to_numpy(), g["_core"].to_numpy()
            first = times.min() - order
            line = np.zeros(times.max() - first + 1)
            line[times - first] = g["_u"].to_numpy()
            windows = np.lib.stride_tricks.sliding_window_view(line, order + 1)
            own, x = times[core] - first - order, g.loc[core, xs].to_numpy(float)
            for a in range(0, len(own), chunk):
                z = np.hstack([x[a : a + chunk], windows[own[a : a + chunk]][:, order - 1 :: -1], windows[own[a : a + chunk]][:, order:]])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"i": np.arange(k), "v": list(total)})

    def add_up(pdf):
        return pdf.iloc[:1].assign(v=[np.sum(np.stack(pdf["v"].to_list()), axis=0)])

    sums = rows.mapInPandas(partial, "i int, v array<double>").groupBy("i").applyInPandas(add_up, "i int, v array<double>")
    out = np.zeros((k, k))
    for r in sums.collect():
        out[r["i"]] = r["v"]
    return out
