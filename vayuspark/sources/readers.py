"""Files in: grids, histories, training rows, hourly payloads, satellite regions, JSON artefacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vayuspark.functions.calendar import as_ts, days
from vayuspark.functions.values import nan_to_null
from vayuspark.vocab import DEFAULT_WEIGHTS, MEMBERS, POLLUTANTS

WEIGHT_MAP = "map<string,map<string,double>>"


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("lat double, lon double").csv(path, header=True)


def read_history(spark: SparkSession, path: str, schema=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, hours) of a history folder; a node's coordinates are those of its first hour."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    hours = nan_to_null(reader.parquet(path))
    return nodes_of(hours), hours


def nodes_of(hours: DataFrame) -> DataFrame:
    place = F.min_by(F.struct("lat", "lon"), F.struct("timestamp", "lat", "lon"))
    return hours.groupBy("location_hash").agg(place.alias("p")).select("location_hash", "p.lat", "p.lon")


def read_training_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a timestamp column, read as UTC; a header with other columns is an error."""
    schema = T.StructType([T.StructField("timestamp", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in columns])
    df = spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True)
    return nan_to_null(df.withColumn("timestamp", F.to_timestamp("timestamp")))


def hourly_schema(names: dict[str, str]) -> T.StructType:
    """Payload of one place: parallel arrays under `hourly`."""
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))] + [
        T.StructField(n, T.ArrayType(T.DoubleType())) for n in names
    ]
    return T.StructType([
        T.StructField("location_hash", T.StringType()), T.StructField("hourly", T.StructType(arrays)),
    ])


def read_payloads(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """JSON files that hold one payload object or a list of them each; one row per object."""
    return spark.read.schema(hourly_schema(names)).json(path, multiLine=True)


def explode_hourly(payloads: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per hour with our column names; a payload without a time axis is an error."""
    axis = F.coalesce(
        F.col("hourly.time"), F.raise_error(F.lit("payload without an hourly time axis")).cast("array<string>")
    )
    none = F.array().cast("array<double>")      # a variable the payload lacks is null in every hour
    hours = F.arrays_zip(axis.alias("time"), *[F.coalesce(F.col(f"hourly.{n}"), none).alias(n) for n in names])
    others = [c for c in payloads.columns if c != "hourly"]
    rows = payloads.select(*others, F.explode(hours).alias("h"))
    return rows.select(
        *others, F.to_timestamp("h.time").alias("timestamp"), *[F.col(f"h.{n}").alias(c) for n, c in names.items()]
    )


def parse_region(regions: DataFrame, band: str, column: str = "region", out: str = "value") -> DataFrame:
    """Array-of-arrays answer, header first, epoch milliseconds: (other columns, timestamp, value)."""
    header = F.element_at(column, 1)
    rows = F.when(F.size(column) > 1, F.slice(F.col(column), F.lit(2), F.size(column) - 1))
    others = [c for c in regions.columns if c != column]
    cut = regions.select(
        *others, F.array_position(header, "time").cast("int").alias("_t"),
        F.array_position(header, band).cast("int").alias("_v"), F.explode(rows).alias("_row"),
    )
    return cut.select(
        *others, F.timestamp_millis(F.element_at("_row", F.col("_t")).cast("double").cast("long")).alias("timestamp"),
        F.element_at("_row", F.col("_v")).try_cast("double").alias(out),
    )


def load_observations(obs: DataFrame, as_of, last_days: int, hashes=None) -> DataFrame:
    """Hours of the last days, of all nodes, of a list of hashes or of a table of them.

    With an `obs_date` partition column whole folders outside the range are skipped.
    """
    since = as_ts(as_of) - days(last_days)
    if "obs_date" in obs.columns:
        obs = obs.where(F.col("obs_date") >= F.to_date(since))
    obs = obs.where(F.col("timestamp") >= since)
    if hashes is None:
        return obs
    if isinstance(hashes, DataFrame):
        return obs.join(hashes.select("location_hash"), "location_hash", "left_semi")
    return obs.where(F.col("location_hash").isin(list(hashes)))


def read_parts(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.parquet(glob)


def read_weights(spark: SparkSession, path: str | None) -> DataFrame:
    """(pollutant, member, weight). Pollutants that the file lacks, and an absent or broken file, take defaults."""
    grid = spark.createDataFrame(
        [(p, m, i, DEFAULT_WEIGHTS[m]) for p in POLLUTANTS for i, m in enumerate(MEMBERS)],
        "pollutant string, member string, position int, fallback double",
    )
    try:
        text = spark.read.text(path, wholetext=True) if path else None
    except AnalysisException:
        text = None
    if text is None:
        return grid.select("pollutant", "member", F.col("fallback").alias("weight"))
    learnt = text.select(F.explode(F.from_json("value", WEIGHT_MAP)).alias("pollutant", "by_member"))
    return grid.join(learnt, "pollutant", "left").select(
        "pollutant", "member",
        F.when(F.col("by_member").isNull(), F.col("fallback"))
        .otherwise(F.coalesce(F.col("by_member")[F.col("member")], F.lit(0.0))).alias("weight"),
    )


def read_card(spark: SparkSession, path: str) -> DataFrame:
    """Model card JSON as one row (model_version, card); none when the file is absent or empty."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "model_version string, card string")
    card = text.select(F.trim("value").alias("card")).where(~F.col("card").isin("", "{}"))
    return card.select(F.coalesce(F.get_json_object("card", "$.model_version"), F.lit("unknown")).alias("model_version"), "card")
