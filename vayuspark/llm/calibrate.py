"""Isotonic calibration from counts in bins, and the split by document number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def isotonic(scored: DataFrame, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising fit of y on raw: rows are summed into BINS equal bins from low to high, then neighbours that fall are pooled."""
    place = F.least(F.greatest(F.floor((F.col("raw") - low) / ((high - low) / BINS)), F.lit(0)), F.lit(BINS - 1))
    bins = scored.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("double")).alias("y"), F.sum("raw").alias("x")).collect()
    pools: list[list[float]] = []
    for r in sorted(bins, key=lambda r: r.bin):
        pools.append([r.n, r.y, r.x])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            n, y, x = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + y, pools[-1][2] + x]
    if not pools:
        return np.array([low]), np.array([0.5])
    x, y = np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])
    # Ends that hold one label alone still differ by their raw score, so no two scores are equal without need.
    return np.concatenate([[low], x, [high]]), np.concatenate([[y[0] * 0.9], y, [y[-1] + (1 - y[-1]) * 0.1]])
