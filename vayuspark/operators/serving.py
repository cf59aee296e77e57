"""Reads that a map, a node page and a skill page need, as batch functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vayuspark.functions.calendar import as_ts, days, hours
from vayuspark.functions.cpcb import settle
from vayuspark.vocab import AVERAGES, POLLUTANTS, SUB_INDICES, VIEW_DAYS

RUN, TARGET = "forecast_generated_at", "forecast_target_time"
DETAIL = [
    RUN, TARGET, "hours_ahead", "aqi", "aqi_lower", "aqi_upper", "aqi_category", "prominent_pollutant",
    *POLLUTANTS, "aqi_huber", "aqi_gbt", "aqi_rf", "model_version",
]


def latest_aqi(aqi: DataFrame, nodes: DataFrame, as_of) -> DataFrame:
    """Newest row per node of the last two days, with the node's columns."""
    as_of = as_ts(as_of)
    recent = aqi.where((F.col("timestamp") >= as_of - days(VIEW_DAYS)) & (F.col("timestamp") <= as_of))
    rest = [
        "timestamp", "aqi", "aqi_category", "prominent_pollutant", *AVERAGES.values(), *SUB_INDICES.values()
    ]
    newest = recent.groupBy("location_hash").agg(F.max_by(F.struct(*rest), F.col("timestamp")).alias("a"))
    return newest.select("location_hash", "a.*").join(
        nodes.select("location_hash", "location_name", "state", "lat", "lon", "kind"), "location_hash"
    )


def latest_forecast(forecasts: DataFrame, as_of) -> DataFrame:
    """Rows of each node's newest run of the last two days (at most a few dozen runs per node)."""
    as_of = as_ts(as_of)
    recent = forecasts.where((F.col(RUN) >= as_of - days(VIEW_DAYS)) & (F.col(RUN) <= as_of))
    newest = F.max(RUN).over(Window.partitionBy("location_hash"))
    return recent.withColumn("_run", newest).where(F.col("_run") == F.col(RUN)).drop("_run")


def history(aqi: DataFrame, as_of, last_hours: int = 72, hashes: list[str] | DataFrame | None = None) -> DataFrame:
    """Hours of all nodes (None), of a list of hashes (an empty one has none) or of a table of them."""
    as_of = as_ts(as_of)
    rows = aqi.where((F.col("timestamp") >= as_of - hours(last_hours)) & (F.col("timestamp") <= as_of))
    if isinstance(hashes, DataFrame):
        rows = rows.join(hashes.select("location_hash"), "location_hash", "left_semi")
    elif hashes is not None:
        rows = rows.where(F.col("location_hash").isin(list(hashes)))
    return rows.select(
        "location_hash", "timestamp", "aqi", "aqi_category", AVERAGES["pm25"], AVERAGES["pm10"]
    )


def map_rows(latest: DataFrame) -> DataFrame:
    return latest.select(
        F.col("location_hash").alias("h"), F.col("location_name").alias("name"), "state", "lat", "lon", "kind",
        F.col("timestamp").alias("t"), "aqi", F.col("aqi_category").alias("cat"),
        F.col("prominent_pollutant").alias("pol"),
    )


def forecast_summary(latest: DataFrame) -> DataFrame:
    """Range, most common category (a tie goes to the earliest hour), issue time and version per node."""
    by_category = latest.groupBy("location_hash", "aqi_category").agg(
        F.count(F.lit(1)).alias("n"), F.min("hours_ahead").alias("first"),
        F.min("aqi").alias("low"), F.max("aqi").alias("high"),
        F.min_by(F.struct(RUN, "model_version"), "hours_ahead").alias("issue"),
    )
    return by_category.groupBy("location_hash").agg(
        F.min("low").alias("aqi_min"), F.max("high").alias("aqi_max"),
        F.max_by("aqi_category", F.struct("n", -F.col("first"))).alias("dominant_category"),
        F.min_by("issue", "first").alias("issue"),
    ).select("location_hash", "aqi_min", "aqi_max", "dominant_category", f"issue.{RUN}", "issue.model_version")


def forecast_peak(latest: DataFrame) -> DataFrame:
    """First hour that holds the highest index."""
    top = F.max_by(F.struct(TARGET, "hours_ahead", "aqi", "aqi_category"), F.struct("aqi", -F.col("hours_ahead")))
    return latest.groupBy("location_hash").agg(top.alias("p")).select("location_hash", "p.*")


def outlook(latest: DataFrame, ahead: list[int] | None = None) -> DataFrame:
    """Pollutant rows with one column per lead time; CO to 2 digits, the rest whole."""
    ahead = ahead or [6, 12, 24]
    long = latest.where(F.col("hours_ahead").isin(ahead)).unpivot(
        ["location_hash", "hours_ahead"], POLLUTANTS, "pollutant", "value"
    )
    wide = long.groupBy("location_hash", "pollutant").pivot("hours_ahead", ahead).agg(F.max("value"))
    digits = lambda c: F.when(F.col("pollutant") == "co", settle(c, 2)).otherwise(settle(c, 0))
    return wide.select("location_hash", "pollutant", *[digits(F.col(str(h))).alias(f"h{h}") for h in ahead])


def newest_card(registry: DataFrame) -> DataFrame:
    return registry.agg(
        F.max_by(F.struct("model_version", "card"), F.struct("last_used_at", "model_version")).alias("m")
    ).select("m.*")


def _quoted(text) -> Column:
    """A text as JSON, null as null."""
    return F.coalesce(F.get(F.split(F.to_json(F.array(text)), "^\\[|\\]$"), F.lit(1)), F.lit("null"))


def snapshot_head(card: DataFrame, as_of, by_horizon: DataFrame | None = None) -> DataFrame:
    """The head line: when it was made, and the skill block of the newest card with the live scores by lead time."""
    live = F.lit("[]")
    if by_horizon is not None:
        rows = by_horizon.agg(F.to_json(F.array_sort(F.collect_list(F.struct("hours_ahead", *[c for c in by_horizon.columns if c != "hours_ahead"])))).alias("x"))
        live = F.coalesce(rows.scalar(), F.lit("[]"))
    part = lambda name: F.coalesce(F.get_json_object("card", f"$.{name}"), F.lit("null"))
    made = F.date_format(as_ts(as_of), "yyyy-MM-dd'T'HH:mm:ss")
    value = F.concat(
        F.lit('{"generated_at":'), _quoted(made), F.lit(',"skill":{"model_version":'), _quoted(F.col("model_version")),
        F.lit(',"trained_at":'), _quoted(F.get_json_object("card", "$.trained_at")), F.lit(',"data":'), part("data"), F.lit(',"test":'), part("test"),
        F.lit(',"live_by_horizon":'), live, F.lit("}}"),
    )
    return newest_card(card).select(F.lit("skill").alias("kind"), F.col("model_version").alias("id"), value.alias("value"))


def as_json(lines: DataFrame) -> DataFrame:
    """(kind, id, value) as one JSON object per line; `value` is JSON already and goes in as an object."""
    return lines.select(F.concat(F.lit('{"kind":'), _quoted(F.col("kind")), F.lit(',"id":'), _quoted(F.col("id")), F.lit(',"value":'), F.col("value"), F.lit("}")).alias("value"))


def snapshot_lines(
    aqi: DataFrame, forecasts: DataFrame, nodes: DataFrame, as_of, card: DataFrame | None = None, by_horizon: DataFrame | None = None,
) -> DataFrame:
    """JSON lines that serve the dashboard without a table store: one per node, one head line.

    A node's line holds its newest row, its 24 forecast hours and three days of history, all bounded,
    so the export stays spread over the tasks.
    """
    latest = latest_aqi(aqi, nodes, as_of)
    newest = latest.agg(F.max("timestamp").alias("t")).scalar()
    detail = latest_forecast(forecasts, as_of).withColumns({p: settle(F.col(p), 2) for p in POLLUTANTS})
    runs = detail.groupBy("location_hash").agg(
        F.array_sort(F.collect_list(F.struct(TARGET, *[c for c in DETAIL if c != TARGET]))).alias("forecast")
    )
    past = aqi.where(F.col("timestamp") >= newest - hours(72)).groupBy("location_hash").agg(
        F.array_sort(F.collect_list(F.struct("timestamp", "aqi"))).alias("history")
    )
    compact = map_rows(latest).select(F.col("h").alias("location_hash"), F.struct("*").alias("map"))
    empty = lambda c: F.coalesce(F.col(c), F.array())
    lines = (
        latest.select("location_hash", F.struct("*").alias("node"))
        .join(compact, "location_hash")
        .join(runs, "location_hash", "left")
        .join(past, "location_hash", "left")
        .select(
            F.lit("node").alias("kind"), F.col("location_hash").alias("id"),
            F.to_json(F.struct("map", "node", empty("forecast").alias("forecast"), empty("history").alias("history"))).alias("value"),
        )
    )
    if card is None:
        return lines
    return lines.unionByName(snapshot_head(card, as_of, by_horizon))
