"""Every operator as a query over the given tables, with its SQL twin where SQL can say it."""

from vayuspark.catalog import learning, models, reads, relations, scalars, series  # noqa: F401
from vayuspark.catalog.base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
