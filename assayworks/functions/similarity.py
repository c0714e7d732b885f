"""Jaro similarity, which Spark has no function for, as an Arrow-batched function over pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def jaro(a: str, b: str) -> float:
    """Matches within half the longer length, less half of those out of order."""
    if a == b:
        return 1.0 if a else 0.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    window = max(la, lb) // 2 - 1
    used = bytearray(lb)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - window), min(lb, i + window + 1)):
            if not used[j] and b[j] == x:
                used[j] = 1
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(lb) if used[j]]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / la + m / lb + (m - moved) / m) / 3


def _over_pairs(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        seen: dict[tuple, float] = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            if (x, y) not in seen:
                seen[x, y] = jaro(x, y)
            out.append(seen[x, y])
        yield pd.Series(out, dtype="float64")


def jaro_similarity(a: Column | str, b: Column | str) -> Column:
    return pandas_udf(_over_pairs, "double")(a, b)
