"""Grouped reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def aqi_daily(aqi: DataFrame) -> DataFrame:
    """Mean and top index and mean PM2.5 average per UTC day and node."""
    return aqi.groupBy(F.date_trunc("day", "timestamp").alias("day"), "location_hash").agg(
        F.avg("aqi").alias("aqi_mean"), F.max("aqi").alias("aqi_max"), F.avg("pm25_24h_avg").alias("pm25_mean")
    )


def health(nodes: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Number of nodes and the newest run, as one row from two scalar subqueries."""
    newest = forecasts.agg(F.max("forecast_generated_at").alias("t")).scalar()
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("latest_forecast_run", newest)


def category_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("aqi_category").agg(F.count(F.lit(1)).alias("n"))


def watched(df: DataFrame, name: str, value: str) -> tuple[DataFrame, Observation]:
    """Least, greatest and mean value and the share of known ones, gathered while the job runs anyway."""
    seen = Observation(name)
    return df.observe(
        seen, F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"),
        F.avg(F.col(value).isNotNull().cast("int")).alias("coverage"),
    ), seen


def holdout_metrics(df: DataFrame, label: str, prediction: str, groups: list[str] | None = None) -> DataFrame:
    """RMSE, MAE and R2 in one pass."""
    err = F.col(label) - F.col(prediction)
    return (
        df.groupBy(*(groups or []))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
            F.avg(err * err).alias("_mse"), F.var_pop(label).alias("_var"),
        )
        .withColumn("r2", 1 - F.col("_mse") / F.when(F.col("_var") != 0, F.col("_var")))
        .drop("_mse", "_var")
    )
