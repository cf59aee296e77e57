"""Streaming twins of the batch jobs. Each equals its batch twin once its windows are closed.

Event time is a timestamp with zone; cast local ones first. Checkpoint folders belong on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vayuspark.functions.calendar import hours
from vayuspark.operators.quality import standardise_units
from vayuspark.operators.skill import RUN
from vayuspark.operators.windows import NODE, TIME, keep_last
from vayuspark.plans.aqi import refresh_aqi
from vayuspark.session import cut_lineage
from vayuspark.sources.readers import explode_hourly, hourly_schema
from vayuspark.sources.tables import only, read_table, upsert
from vayuspark.vocab import HORIZON, POLLUTANTS, WINDOW_HOURS


def daily_rollup(aqi: DataFrame, late: str = "3 days") -> DataFrame:
    """Mean and top index per node and UTC day, given once a day can get no more late rows."""
    return (
        aqi.withWatermark(TIME, late)
        .groupBy(F.window(TIME, "1 day"), NODE)
        .agg(F.avg("aqi").alias("aqi_mean"), F.max("aqi").alias("aqi_max"), F.avg("pm25_24h_avg").alias("pm25_mean"))
        .select(F.col("window.start").alias("day"), NODE, "aqi_mean", "aqi_max", "pm25_mean")
    )


REACH = max(WINDOW_HOURS.values()) - 1


def refresh_touched(spark: SparkSession, hours_path: str, index_path: str, changed: DataFrame, number: int) -> None:
    """Work out again the index rows that some changed hours reach: their own and those of the 23 hours after each.

    Only the days around the changed hours, and in them only the nodes that changed, are read of the table of hours. `number`
    rises with every call (or stays, for the same rows), so that the rows of the last one count.
    """
    reached = changed.select(NODE, F.explode(F.sequence(F.col(TIME), F.col(TIME) + hours(REACH), F.expr("interval 1 hour"))).alias(TIME)).distinct()
    days = [r[0] for r in changed.select(F.explode(F.sequence(F.date_sub(F.to_date(TIME), 1), F.date_add(F.to_date(TIME), 1))).alias("d")).distinct().collect()]
    near = only(read_table(spark, hours_path, changed.schema), days, "obs_date").join(changed.select(NODE).distinct(), NODE, "left_semi")
    rows = refresh_aqi(near.select(NODE, TIME, *POLLUTANTS)).join(reached, [NODE, TIME], "left_semi")
    numbered = rows.withColumns({"batch_number": F.lit(number).cast("long"), "obs_date": F.to_date(TIME)})
    upsert(spark, index_path, numbered, [TIME, NODE], ["batch_number"], "obs_date")


def index_stream(obs: DataFrame, hours_path: str, index_path: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """The index kept up with hours as they come, late and revised ones too.

    Each micro-batch goes into the keyed table of hours (the latest by `order` stays), then the index rows that it reaches are
    worked out from that table and replaced. The state is the two tables, nothing is kept per hour in the stream, no window
    has to close, and a batch that is run again changes nothing.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(keep_last(batch.withColumn("obs_date", F.to_date(TIME)), [NODE, TIME], order), "batch")
        upsert(spark, hours_path, rows, [NODE, TIME], order, "obs_date")
        refresh_touched(spark, hours_path, index_path, rows, number)

    return obs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_per_hour(obs: DataFrame, late: str = "3 hours") -> DataFrame:
    """Drops repeated hours, keeping the first to arrive; for the last to arrive use `upsert_stream`."""
    return obs.withWatermark(TIME, late).dropDuplicatesWithinWatermark([NODE, TIME])


def upsert_stream(obs: DataFrame, path: str, checkpoint: str, order: list[str], partition: str = "obs_date") -> StreamingQuery:
    """Revised hours replace earlier ones in a keyed table. Running a batch again changes nothing."""
    def write(batch: DataFrame, _: int) -> None:
        rows = keep_last(batch, [NODE, TIME], order)
        upsert(batch.sparkSession, path, rows.select(*batch.columns), [NODE, TIME], order, partition)

    return obs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_pairs(forecasts: DataFrame, at_issue: DataFrame, actuals: DataFrame, late: str = "3 hours", lead: int = HORIZON) -> DataFrame:
    """Forecast hours with the index of their issue hour, where that is known, and the index of their target hour as it arrives.

    Two joins in one stream: the index at issue is an outer one, a forecast without it is given on once the watermark has
    passed its issue hour. The target hour lies within `lead` hours of the issue hour, so state of both joins is bounded by the
    watermark of the issue hours. `at_issue` and `actuals` are two readings of the same stream.
    """
    ahead = forecasts.select(
        RUN, "hours_ahead", NODE, "forecast_target_time", "model_version", F.col("aqi").alias("pred"),
        F.col("aqi_category").alias("pred_cat"), F.col("pm25").alias("pred_pm25"),
    ).withWatermark(RUN, late)
    issued = at_issue.select(F.col(NODE).alias("_at"), F.col(TIME).alias("_issue"), F.col("aqi").alias("issue_aqi")).withWatermark("_issue", late)
    came = actuals.select(
        F.col(NODE).alias("_node"), F.col(TIME).alias("_hour"), F.col("aqi").alias("actual"),
        F.col("aqi_category").alias("actual_cat"), F.col("pm25").alias("actual_pm25"),
    ).withWatermark("_hour", late)
    known = ahead.join(issued, (F.col(NODE) == F.col("_at")) & (F.col(RUN) == F.col("_issue")), "left_outer").drop("_at", "_issue")
    same = (F.col(NODE) == F.col("_node")) & (F.col("forecast_target_time") == F.col("_hour"))
    within = (F.col("_hour") > F.col(RUN)) & (F.col("_hour") <= F.col(RUN) + hours(lead))
    return known.join(came, same & within, "inner").drop("_node", "_hour")


def landing(spark: SparkSession, path: str, names: dict[str, str], multi_line: bool = False) -> DataFrame:
    """New payload files -> hourly rows in our units."""
    raw = spark.readStream.schema(hourly_schema(names)).option("multiLine", str(multi_line).lower()).json(path)
    return standardise_units(explode_hourly(raw, names))


def read_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """The files of a folder as they come; `files`: at most so many in a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def drain(df: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Run a stream over what is there into an append-only Parquet folder and wait for the end."""
    out = change(df) if change else df
    out.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
