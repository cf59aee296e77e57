"""The hourly index: trailing means -> sub-indices -> AQI, prominent pollutant, category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vayuspark.functions.cpcb import with_aqi
from vayuspark.operators.windows import NODE, TIME, trailing_means
from vayuspark.vocab import AVERAGES, POLLUTANTS, SUB_INDICES, WINDOW_HOURS

AQI_COLUMNS = (
    [TIME, NODE] + list(AVERAGES.values()) + list(SUB_INDICES.values())
    + ["aqi", "prominent_pollutant", "aqi_category"]
)


def refresh_aqi(obs: DataFrame, since=None) -> DataFrame:
    """AQI rows of every node-hour from `since` on; hours without any average have no row."""
    narrow = obs.select(NODE, TIME, *POLLUTANTS)
    return with_aqi(trailing_means(narrow, since)).select(*AQI_COLUMNS)


def aqi_along_path(history: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """AQI of forecast hours from the last observed hours followed by the forecast.

    `history` has `step` -22..0 and `forecast` `step` 1..n, both with the six concentrations. A mean
    counts only when every hour of its window is there. A path is 23 + n rows, whatever the table size.
    """
    path = history.select(*keys, "step", *POLLUTANTS).unionByName(forecast.select(*keys, "step", *POLLUTANTS))
    w = Window.partitionBy(*keys).orderBy("step")
    means = []
    for p in POLLUTANTS:
        frame = w.rowsBetween(-(WINDOW_HOURS[p] - 1), 0)
        full = F.count(p).over(frame) == WINDOW_HOURS[p]
        means.append(F.when(full, F.avg(p).over(frame)).alias(AVERAGES[p]))
    return with_aqi(path.select(*keys, "step", *POLLUTANTS, *means).where(F.col("step") >= 1))
