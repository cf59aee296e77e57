"""Scoring of issued forecasts against what was then observed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vayuspark.functions.calendar import as_ts, days, hours

RUN = "forecast_generated_at"
SKILL_COLUMNS = [
    RUN, "hours_ahead", "n_nodes", "aqi_mae", "aqi_rmse", "aqi_bias", "category_accuracy",
    "persistence_aqi_mae", "pm25_mae", "model_version",
]


def pending_runs(forecasts: DataFrame, scored: DataFrame, as_of, rescore: bool = False) -> DataFrame:
    """Runs whose whole day has passed and that have no skill row yet."""
    done = forecasts.where(F.col(RUN) <= as_ts(as_of) - hours(25)).select(RUN).distinct()
    return done if rescore else done.join(scored, RUN, "left_anti")


def forecast_vs_actual(forecasts: DataFrame, aqi: DataFrame, obs: DataFrame) -> DataFrame:
    """Forecast hours with the index and PM2.5 that came, and the index at issue time."""
    actual = aqi.select(
        "location_hash", F.col("timestamp").alias("forecast_target_time"), F.col("aqi").alias("actual"),
        F.col("aqi_category").alias("actual_cat"),
    )
    raw = obs.select(
        "location_hash", F.col("timestamp").alias("forecast_target_time"), F.col("pm25").alias("actual_pm25")
    )
    at_issue = aqi.select("location_hash", F.col("timestamp").alias(RUN), F.col("aqi").alias("issue_aqi"))
    target = ["location_hash", "forecast_target_time"]
    return (
        forecasts.select(
            RUN, "hours_ahead", *target, "model_version", F.col("aqi").alias("pred"),
            F.col("aqi_category").alias("pred_cat"), F.col("pm25").alias("pred_pm25"),
        )
        .join(actual, target, "inner")
        .join(raw, target, "left")
        .join(at_issue, ["location_hash", RUN], "left")
    )


def skill(joined: DataFrame) -> DataFrame:
    """Per run and lead time. The wide pass adds numbers only (text maxima would sort all rows)."""
    err = (F.col("pred") - F.col("actual")).cast("double")
    measures = {
        "aqi_mae": F.abs(err), "aqi_rmse": err * err, "aqi_bias": err,
        "category_accuracy": (F.col("pred_cat") == F.col("actual_cat")).cast("double"),
        "persistence_aqi_mae": F.abs(F.col("issue_aqi") - F.col("actual")).cast("double"),
        "pm25_mae": F.abs(F.col("pred_pm25") - F.col("actual_pm25")),
    }
    sums = joined.groupBy(RUN, "hours_ahead", "model_version").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(x).alias(f"_s_{c}") for c, x in measures.items()],
        *[F.count(x).alias(f"_n_{c}") for c, x in measures.items()],
    )
    known = lambda c: F.when(F.sum(f"_n_{c}") > 0, F.sum(f"_n_{c}"))
    mean = {c: F.sum(f"_s_{c}") / known(c) for c in measures}
    mean["aqi_rmse"] = F.sqrt(mean["aqi_rmse"])
    return sums.groupBy(RUN, "hours_ahead").agg(
        F.sum("n").alias("n_nodes"), *[x.alias(c) for c, x in mean.items()], F.max("model_version").alias("model_version")
    ).select(*SKILL_COLUMNS)


def evaluate_forecast_skill(
    forecasts: DataFrame, aqi: DataFrame, obs: DataFrame, scored: DataFrame, as_of, rescore: bool = False
) -> DataFrame:
    """New skill rows of the pending runs; append them with `insert_if_absent`."""
    runs = pending_runs(forecasts, scored, as_of, rescore)
    return skill(forecast_vs_actual(forecasts.join(runs, RUN, "left_semi"), aqi, obs))


def _weighted(column: str):
    n = F.sum("n_nodes")
    return F.sum(F.col(column) * F.col("n_nodes")) / F.when(n != 0, n)


def skill_summary(scored: DataFrame, as_of, last_days: int = 7) -> DataFrame:
    """Per horizon, weighted by the number of nodes, over the runs of the last days."""
    recent = scored.where(F.col(RUN) >= as_ts(as_of) - days(last_days))
    return recent.groupBy("hours_ahead").agg(
        F.sum("n_nodes").alias("n"),
        *[_weighted(c).alias(c) for c in ("aqi_mae", "persistence_aqi_mae", "category_accuracy")],
    )


def live_mae(summary: DataFrame) -> DataFrame:
    """One row over all horizons."""
    n = F.sum("n")
    share = lambda c: (F.sum(F.col(c) * F.col("n")) / F.when(n != 0, n)).alias(c)
    return summary.agg(n.alias("n"), share("aqi_mae"), share("persistence_aqi_mae"))
