"""Fixed right-closed bins of percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = (-1, 25, 50, 75, 100)


def quartile(value: Column, prefix: str = "Q") -> Column:
    """Q1..Q4 by the cut points 25, 50, 75, 100; null outside."""
    out = None
    for n, (low, high) in enumerate(zip(EDGES, EDGES[1:]), start=1):
        test = (value > low) & (value <= high)
        out = F.when(test, f"{prefix}{n}") if out is None else out.when(test, f"{prefix}{n}")
    return out
