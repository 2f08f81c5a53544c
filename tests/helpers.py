import datetime as dt

import numpy as np
import pandas as pd

T0 = dt.datetime(2024, 1, 1)


def minutes(*offsets):
    return [T0 + dt.timedelta(minutes=float(m)) for m in offsets]


def gridded(spark, values, keys=("k",), key=("a",), start=0):
    """One series on a dense 1-minute grid from a list of (possibly None) values."""
    rows = [(*key, i + start, T0 + dt.timedelta(minutes=i + start), None if v is None else float(v)) for i, v in enumerate(values)]
    cols = ", ".join(f"{k} string" for k in keys)
    return spark.createDataFrame(rows, f"{cols}, slot long, ts timestamp_ntz, x double")


def series(df, order, col):
    return [r[col] for r in df.orderBy(*order).collect()]


def with_gaps(rng, n, p=0.4, run=12):
    """Random values with null runs of varying length."""
    x = [float(v) for v in rng.normal(size=n).round(3)]
    i = 0
    while i < n:
        if rng.random() < p:
            for j in range(i, min(n, i + int(rng.integers(1, run)))):
                x[j] = None
        i += int(rng.integers(1, 9))
    return x


def pandas_interpolate(x):
    return [None if pd.isna(v) else float(v) for v in pd.Series(x, dtype=float).interpolate("linear")]


def close(a, b, tol=1e-9):
    assert len(a) == len(b), (len(a), len(b))
    for i, (u, v) in enumerate(zip(a, b)):
        if u is None or v is None:
            assert u is None and v is None, (i, u, v)
        else:
            assert np.isclose(u, v, rtol=tol, atol=tol), (i, u, v)
