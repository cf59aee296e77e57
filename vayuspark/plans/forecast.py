"""Forecast rows of every node that can be forecast at one issue hour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from vayuspark.functions.calendar import as_ts, floor_hour, hours
from vayuspark.functions.cpcb import category, half_even
from vayuspark.operators.evaluate import blend, path_index, to_concentrations, with_interval
from vayuspark.operators.features import all_horizons, sample_index
from vayuspark.operators.windows import NODE, TIME
from vayuspark.vocab import HISTORY, HORIZON, POLLUTANTS


def issue_samples(frame: DataFrame, as_of) -> DataFrame:
    """Nodes with a whole window at the issue hour; none at all is an error when the rows are used."""
    now = floor_hour(as_ts(as_of))
    rows = sample_index(frame, valid="valid_issue").where(F.col(TIME) == now)
    any_node = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    problem = F.raise_error(F.lit("no node has a complete window at the issue hour")).cast("boolean")
    guard = frame.select(NODE).limit(1).where(F.when(any_node == 0, problem).otherwise(F.lit(False)))
    return rows.unionByName(guard.select(NODE, now.alias(TIME), F.lit(0).cast("long").alias("t")))


def forecast_all(
    frame: DataFrame, as_of, predict: Callable[[DataFrame, DataFrame], DataFrame], members: list[str],
    weights: DataFrame, quantiles: DataFrame | None = None, version: str = "untrained",
) -> DataFrame:
    """Rows of the forecast table at one issue hour.

    `predict(leads, frame)` returns `horizon_rows` with a `<member>_<pollutant>` log change per member.
    """
    now = floor_hour(as_ts(as_of))
    frame = frame.where(F.col(TIME).between(now - hours(HISTORY - 1), now + hours(HORIZON)))
    samples = issue_samples(frame, as_of)
    rows = blend(predict(all_horizons(samples), frame), weights, members)
    variants = ["ensemble", *members]
    if quantiles is not None:
        rows, variants = with_interval(rows, quantiles), [*variants, "lower", "upper"]
    paths = path_index(to_concentrations(rows, variants), variants)
    whole = lambda v: half_even(F.col(f"{v}_raw")) if v in variants else F.lit(None).cast("int")
    return paths.select(
        F.col(TIME).alias("forecast_generated_at"), (F.col(TIME) + hours(F.col("step"))).alias("forecast_target_time"),
        NODE, F.col("step").alias("hours_ahead"), *[F.col(f"ensemble_{p}").alias(p) for p in POLLUTANTS],
        whole("ensemble").alias("aqi"), whole("lower").alias("aqi_lower"), whole("upper").alias("aqi_upper"),
        category(half_even(F.col("ensemble_raw"))).alias("aqi_category"),
        F.col("ensemble_prominent").alias("prominent_pollutant"),
        *[whole(m).alias(f"aqi_{m}") for m in members], F.lit(version).alias("model_version"),
    )
