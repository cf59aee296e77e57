"""Model fits side by side: each is a row of Spark jobs of its own, and many are too small to fill the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

X = TypeVar("X")
AT_ONCE = 6
#: Bytes of cached rows that the fits of one moment may hold between them.
CACHED_AT_ONCE = 10 * 10**9


def fits_at_once(rows: int, features: int, trees: int = 1) -> int:
    """How many tree fits over so many rows run at a time.

    Each holds its rows as objects in the executors' memory (4 bytes a feature, a count and a node for each tree, some 250 more). Large fits
    fill the cluster alone; side by side they would push one another's rows to disk in every pass.
    """
    return max(1, min(AT_ONCE, CACHED_AT_ONCE // max(1, rows * (250 + 4 * features + 8 * trees))))


def side_by_side(spark: SparkSession, fits: Iterable[Callable[[], X]], at_once: int = AT_ONCE) -> list[X]:
    """The results in order; at most `at_once` run at a time. They share the stored input, and the first error is raised."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda fit: inheritable_thread_target(spark)(fit)(), fits))
