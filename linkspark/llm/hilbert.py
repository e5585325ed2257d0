"""Hilbert curve index of a point, for Spark columns and for numpy arrays.

Both use transposed axes: undo the excess rotation from the top bit down, Gray-encode, interleave the bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_hilbert(df: DataFrame, dims: list[str], bits: int, name: str) -> DataFrame:
    """df with the curve index of columns dims, each below 2 ** bits. The folds are interpreted: use it on distinct cells."""
    n = len(dims)
    turns = ", ".join(f"named_struct('q', {1 << b}, 'i', {i})" for b in range(bits - 1, 0, -1) for i in range(n))
    tops = ", ".join(str(1 << b) for b in range(bits - 1, 0, -1))
    turned = f"""aggregate(array({turns}), _x, (x, s) -> transform(x, (v, j) -> CASE
        WHEN (x[s.i] & s.q) <> 0 THEN IF(j = 0, v ^ (s.q - 1), v)
        WHEN s.i <> 0 AND (j = 0 OR j = s.i) THEN v ^ ((x[0] ^ x[s.i]) & (s.q - 1))
        ELSE v END))"""
    woven = " + ".join(f"shiftleft(cast(shiftright(_x[{i}], {b}) & 1 AS bigint), {b * n + n - 1 - i})" for b in range(bits) for i in range(n))
    out = df.withColumn("_x", F.array(*[F.col(d).cast("int") for d in dims]))
    if bits > 1:
        out = out.withColumn("_x", F.expr(turned))
    out = out.withColumn("_x", F.expr("transform(_x, (v, j) -> aggregate(slice(_x, 1, j + 1), 0, (a, y) -> a ^ y))"))
    if bits > 1:
        out = out.withColumn("_f", F.expr(f"aggregate(array({tops}), 0, (a, q) -> IF((_x[{n - 1}] & q) <> 0, a ^ (q - 1), a))"))
        out = out.withColumn("_x", F.expr("transform(_x, v -> v ^ _f)")).drop("_f")
    return out.withColumn(name, F.expr(woven)).drop("_x")


def hilbert_numpy(points: np.ndarray, bits: int) -> np.ndarray:
    """Curve indices of integer points (rows), each coordinate below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] >> b) & 1, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out
