"""Codependence of pairs against counting date by date."""

import datetime
import math

import numpy as np

from quantloom.operators.risk import codependence


def test_counts(spark):
    rng = np.random.default_rng(9)
    r = 0.01 * (rng.standard_normal((70, 1)) + rng.standard_normal((70, 3))) * [1, 3, -1]
    r[5, 1] = np.nan
    day = [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(70)]
    rows = [(f"a{j}", day[i], None if np.isnan(r[i, j]) else float(r[i, j])) for i in range(70) for j in range(3)] + [("flat", day[0], 0.0)]
    got = {(x["a"], x["b"]): x for x in codependence(spark.createDataFrame(rows, "asset string, dt date, r double"), percent=10).collect()}
    for a in range(3):
        for b in range(a, 3):
            x, y = r[:, a], r[:, b]
            move = [np.where(np.isnan(v), 0, np.sign(v) * (np.abs(v) >= 0.5 * np.nanstd(v, ddof=1))) for v in (x, y)]
            k = [math.ceil((~np.isnan(v)).sum() / 10) for v in (x, y)]
            low = [v <= np.sort(v[~np.isnan(v)])[n - 1] for v, n in zip((x, y), k, strict=True)]
            both = ~np.isnan(x) & ~np.isnan(y)
            product = (move[0] * move[1])[both]
            mine = got[f"a{a}", f"a{b}"]
            assert abs(mine["gerber"] - product.sum() / np.abs(product).sum()) < 1e-12
            assert abs(mine["gerber_any"] - product.sum() / ((move[0] != 0) | (move[1] != 0))[both].sum()) < 1e-12
            assert abs(mine["tail"] - (low[0] & low[1]).sum() / min(k)) < 1e-12
    assert got["a0", "a0"]["gerber"] == got["a0", "a0"]["tail"] == 1
    lone = got["flat", "flat"]
    assert lone["gerber"] is None and lone["gerber_any"] is None and lone["tail"] == 1
    assert codependence(spark.createDataFrame([], "asset string, dt date, r double")).count() == 0
