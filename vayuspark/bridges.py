"""Air-quality shaped tables derived from the given star-schema tables.

One SQL text per table serves Spark and the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vayuspark.functions.calendar import hours
from vayuspark.plans.aqi import refresh_aqi
from vayuspark.vocab import POLLUTANTS

_OBS = """
select {NODE} as location_hash, date_trunc('hour', cast(ts as timestamp)) as timestamp,
  avg(value)*cast(1.2 as double) as pm25, max(value)*cast(2 as double) as pm10,
  avg(k)*cast(1.5 as double) as no2, min(value)*cast(3 as double) as so2,
  sum(value)/cast(40 as double) as co, {O3} as o3,
  max(value)/cast(3 as double) as dust, max(k)/cast(110 as double) as aod,
  cast(10 as double)+avg(k)/cast(4 as double) as temp_c,
  cast(20 as double)+min(k)*cast(0.8 as double) as humidity_pct,
  cast(0.5 as double)+max(k)/cast(15 as double) as wind_speed_ms,
  cast(cast(sum(k) as bigint)*37 % 360 as double) as wind_dir_deg,
  cast(sum(case when event_type='error' then 1 else 0 end) as double)*cast(0.5 as double) as precip_mm,
  cast(980 as double)+avg(k)/cast(3 as double) as pressure_hpa,
  cast(200 as double)+max(value)*cast(4 as double) as boundary_layer_m,
  avg(value)*cast(2 as double) as radiation_wm2
from (select *, cast(cast(regexp_extract(props,'([0-9]+)',1) as int) as double) as k from events)
group by 1, 2
"""
_NODE = {
    "user": "concat('u',cast(user_id as string))",
    "node8": "concat('n',cast(user_id % 8 as string))",
}
_O3 = {
    "user": "avg(case when event_type in ('view','click') then value*cast(1.5 as double) end)",
    "node8": "cast(5 as double)+avg(value)*cast(0.8 as double)",
}


def _place(key: str, lat_step: int, lon_step: int) -> str:
    return (
        f"cast(6.5 as double)+cast(({key}*{lat_step}) % 3100 as double)/cast(100 as double) as lat, "
        f"cast(68 as double)+cast(({key}*{lon_step}) % 2950 as double)/cast(100 as double) as lon"
    )


NODES_SQL = f"""
select concat('u',cast(c_custkey as string)) as location_hash, c_name as location_name, n_name as state,
  {_place('c_custkey', 7919, 104729)}, case when c_custkey % 13 = 0 then 'city' else 'grid' end as kind
from customer join nation on c_nationkey = n_nationkey
"""
CITIES_SQL = f"""
select s_name as location_name, n_name as state, s_suppkey as city_order, {_place('s_suppkey', 6151, 92821)}
from supplier join nation on s_nationkey = n_nationkey
"""
POINTS_SQL = f"select o_orderkey as point_id, {_place('o_orderkey', 7919, 104729)} from orders"
NODES8_SQL = """
select distinct concat('n',cast(user_id % 8 as string)) as location_hash,
  cast(8 + 3 * (user_id % 8) as double) as lat, cast(70 + 3 * (user_id % 8) as double) as lon from events
"""


def obs_sql(kind: str) -> str:
    return _OBS.format(NODE=_NODE[kind], O3=_O3[kind])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    for n in names:
        text = text.replace(f"from {n}", f"from {{{n}}}").replace(f"join {n}", f"join {{{n}}}")
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def observations(spark: SparkSession, sf_dir: str, kind: str = "user") -> DataFrame:
    """Hourly rows: `user` gives many sparse nodes, `node8` eight dense ones."""
    return _run(spark, sf_dir, obs_sql(kind), "events")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, NODES_SQL, "customer", "nation")


def supplier_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, CITIES_SQL, "supplier", "nation")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, POINTS_SQL, "orders")


def nodes8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, NODES8_SQL, "events")


def last_hour(spark: SparkSession, sf_dir: str) -> Column:
    """The newest event hour, as a scalar subquery: the data's own clock."""
    events = table(spark, sf_dir, "events")
    return events.select(F.max(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("t")).scalar()


def forecasts(obs: DataFrame, aqi: DataFrame | None = None) -> DataFrame:
    """Forecast rows: one run per midnight, each hour repeating the same hour of the day before."""
    aqi = refresh_aqi(obs) if aqi is None else aqi
    issues = obs.where(F.hour("timestamp") == 0).select(
        "location_hash", F.col("timestamp").alias("forecast_generated_at"),
        F.explode(F.sequence(F.lit(1), F.lit(24))).alias("hours_ahead"),
    )
    issues = issues.withColumn("timestamp", F.col("forecast_generated_at") + hours(F.col("hours_ahead") - 24))
    index = aqi.select("location_hash", "timestamp", "aqi", "aqi_category", "prominent_pollutant")
    issue_aqi = index.select(
        "location_hash", F.col("timestamp").alias("forecast_generated_at"), F.col("aqi").alias("aqi_huber")
    )
    return (
        issues.join(obs.select("location_hash", "timestamp", *POLLUTANTS), ["location_hash", "timestamp"])
        .join(index, ["location_hash", "timestamp"])
        .join(issue_aqi, ["location_hash", "forecast_generated_at"], "left")
        .select(
            "forecast_generated_at",
            (F.col("forecast_generated_at") + hours(F.col("hours_ahead"))).alias("forecast_target_time"),
            "location_hash", "hours_ahead", *POLLUTANTS, "aqi",
            F.greatest(F.col("aqi") - 10, F.lit(0)).alias("aqi_lower"), (F.col("aqi") + 10).alias("aqi_upper"),
            "aqi_category", "prominent_pollutant", "aqi_huber", F.col("aqi").alias("aqi_gbt"),
            F.lit(None).cast("int").alias("aqi_rf"), F.lit("seasonal").alias("model_version"),
        )
    )
