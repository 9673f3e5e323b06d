"""Exact quantiles of a whole column, by counting ever narrower ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a pass counts, and different values that reach the driver at the end.
RANGES, VALUES = 1024, 10_000


def _ranked(values: DataFrame, ranks: list[int], low: float, high: float, before: int) -> dict[int, float]:
    """The values at the ranks, all within low and high, of which before smaller ones are left out."""
    while True:
        own = values.where(F.col("v").between(low, high))
        n = own.select("v").distinct().limit(VALUES + 1).count()
        if n <= VALUES or low == high:
            out, seen = {}, before
            for row in own.groupBy("v").count().sort("v").collect():
                out |= {k: row["v"] for k in ranks if seen <= k < seen + row["count"]}
                seen += row["count"]
            return out
        # Divided before they are subtracted, as the whole width may be beyond a double; of over VALUES values it isn't 0.
        width = high / RANGES - low / RANGES
        part = F.least(F.floor(F.col("v") / width - low / width), F.lit(RANGES - 1)).alias("part")
        counted = own.groupBy(part).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).sort("part").collect()
        seen, held = before, []
        for row in counted:
            mine = [k for k in ranks if seen <= k < seen + row["n"]]
            if mine:
                held.append((mine, row["lo"], row["hi"], seen))
            seen += row["n"]
        if len(held) > 1:
            return {k: v for part in held for k, v in _ranked(values, *part).items()}
        ranks, low, high, before = held[0]


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The interpolated quantiles of the finite values of a column; nulls where it has none.

    Each pass counts RANGES ranges of what is left, so neither a task nor the driver ever holds the values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.abs("v") < F.lit(float("inf")))
    row = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not row["n"]:
        return [None] * len(shares)
    at = [q * (row["n"] - 1) for q in shares]
    ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    found = _ranked(values, ranks, row["lo"], row["hi"], 0)
    return [found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x)) for x in at]
