"""Learnt members, gap filling, ingestion and streams (checked by properties, where SQL cannot say them)."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from vayuspark import bridges as b
from vayuspark.catalog.base import query, r, rounded
from vayuspark.catalog.learning import TEST_DAYS, VAL_DAYS
from vayuspark.catalog.relations import payloads
from vayuspark.functions import calendar as cal
from vayuspark.operators import skill as sk
from vayuspark.plans import ingest as ing, proxy as px, training as tr
from vayuspark.plans.aqi import refresh_aqi
from vayuspark.plans.artefacts import trained_anew, trained_once
from vayuspark.plans.forecast import forecast_all
from vayuspark.session import run_dir
from vayuspark.sources.tables import read_table
from vayuspark.streaming import jobs
from vayuspark.vocab import AIR_NAMES, AVERAGES, POLLUTANTS, PROXY_LIMITS, RAW, SUB_INDICES, WEATHER_NAMES

K = ["location_hash", "timestamp"]
KEYS = "location_hash, timestamp"
SETTINGS = tr.Settings(val_days=VAL_DAYS, test_days=TEST_DAYS)


def trained(spark, sf) -> tr.Run:
    """A training run with the settings of `tr.Settings`, stored under its settings and data and read from there.

    The split into days follows the span of the given tables.
    """
    return trained_once(b.observations(spark, sf, "node8"), b.nodes8(spark, sf), SETTINGS, "ensemble")


@query("m6_train_members")
def m6(spark, sf):
    """Scores of the trained members, the blend and both baselines on the test hours. Always trains; the others read the run."""
    return trained_anew(b.observations(spark, sf, "node8"), b.nodes8(spark, sf), SETTINGS, "ensemble").scores


@query("m7_predict_members")
def m7(spark, sf):
    run = trained(spark, sf)
    fr = tr.ft.hour_frame(b.observations(spark, sf, "node8"), b.nodes8(spark, sf))
    leads = tr.ft.all_horizons(run.test)
    rows = tr.predict_members(tr.matrix(leads, fr, run.spec), run.models, run.stds)
    return rounded(rows.select(*K, "horizon", *[f"{m}_{p}" for m in tr.MEMBERS for p in POLLUTANTS]))


@query("m8_learnt_weights")
def m8l(spark, sf):
    return trained(spark, sf).weights


@query("m12_forecast_members")
def m12m(spark, sf):
    run = trained(spark, sf)
    fr = tr.cut_lineage(tr.ft.hour_frame(b.observations(spark, sf, "node8"), b.nodes8(spark, sf)), "frame")
    as_of = b.last_hour(spark, sf) - cal.hours(30)
    return rounded(forecast_all(fr, as_of, tr.predictor(run.models, run.spec, run.stds), tr.MEMBERS, run.weights, run.quantiles, "ensemble"))


@query("m14_model_card")
def m14(spark, sf):
    return trained(spark, sf).card


def holed(df):
    """PM unknown where AOD is high, as a feed with dropouts would give it."""
    return df.withColumns({c: F.when(F.col("aod") <= 0.8, F.col(c)) for c in ("pm25", "pm10")})


@query("m16_train_proxy")
def m16(spark, sf):
    return rounded(px.train_proxy(b.observations(spark, sf))[1])


@query("m17_cross_validate")
def m17(spark, sf):
    return px.cross_validate(b.observations(spark, sf), "pm25")


@query("m18_fill_pm_gaps")
def m18(spark, sf):
    obs = holed(b.observations(spark, sf)).select(*K, "aod", *px.WEATHER, "pm25", "pm10")
    models, _ = px.train_proxy(obs)
    return rounded(px.fill_pm_gaps(obs, models).select(*K, "pm25", "pm10", "pm_gap_filled"))


GIVEN_MODEL = {"pm25": "300 * aod + temp_c - 20", "pm10": "humidity_pct * 9 - pressure_hpa / 10"}


def given_models():
    """Stand-ins for the learnt pipelines, whose estimates SQL can work out too."""
    return {t: SQLTransformer(statement=f"select *, {formula} as prediction from __THIS__") for t, formula in GIVEN_MODEL.items()}


_HOLED = "(select location_hash, timestamp, aod, temp_c, humidity_pct, wind_speed_ms, coalesce(pressure_hpa, 1013.25) as pressure_hpa, coalesce(boundary_layer_m, 1000.0) as boundary_layer_m, case when aod <= 0.8 then pm25 end as pm25, case when aod <= 0.8 then pm10 end as pm10 from t_obs)"
_ESTIMATE = {t: f"least(greatest({formula}, 0.0), {PROXY_LIMITS[t]})" for t, formula in GIVEN_MODEL.items()}


@query(
    "m18_fill_given_model",
    f"select {KEYS}, {r('coalesce(pm25, ' + _ESTIMATE['pm25'] + ') as pm25', 'coalesce(pm10, ' + _ESTIMATE['pm10'] + ') as pm10')}, pm25 is null or pm10 is null as pm_gap_filled from {_HOLED}",
)
def m18g(spark, sf):
    """Which rows are filled, limits and flags, with models that are given."""
    obs = holed(b.observations(spark, sf)).select(*K, "aod", *px.WEATHER, "pm25", "pm10")
    return rounded(px.fill_pm_gaps(obs, given_models()).select(*K, "pm25", "pm10", "pm_gap_filled"))


@query("m19_estimates_given_model", f"select {KEYS}, {r('pm25', _ESTIMATE['pm25'] + ' as pm25_proxy', _ESTIMATE['pm10'] + ' as pm10_proxy')} from {_HOLED}")
def m19g(spark, sf):
    """Estimates next to the values, within their limits, with models that are given."""
    obs = holed(b.observations(spark, sf)).select(*K, "aod", *px.WEATHER, "pm25", "pm10")
    return rounded(px.proxy_estimates(obs, given_models()).select(*K, "pm25", "pm25_proxy", "pm10_proxy"))


@query("m18_no_model", f"select {KEYS}, {r('case when aod <= 0.8 then pm25 end as pm25', 'case when aod <= 0.8 then pm10 end as pm10')}, false as pm_gap_filled from t_obs")
def m18n(spark, sf):
    obs = holed(b.observations(spark, sf)).select(*K, "pm25", "pm10")
    return rounded(px.fill_pm_gaps(obs, None))


@query("m19_proxy_estimates")
def m19(spark, sf):
    obs = b.observations(spark, sf).select(*K, "aod", *px.WEATHER, "pm25", "pm10")
    models, _ = px.train_proxy(obs)
    return rounded(px.proxy_estimates(obs, models).select(*K, "pm25", "pm25_proxy", "pm10_proxy"))


_W = "partition by location_hash order by timestamp"
_AODF = "last_value(case when hour(timestamp) % 6 = 0 then aod end ignore nulls) over (" + _W + " rows between 3 preceding and current row)"
_TWO = "last_value({c} ignore nulls) over (" + _W + " rows between 2 preceding and current row)"
_BACK = "first_value({c} ignore nulls) over (" + _W + " rows between current row and 2 following)"


@query(
    "f25_fill_features",
    f"""with a as (select {KEYS}, {_AODF} as aod, case when hour(timestamp) < 3 then null else temp_c end as temp_c, coalesce(case when hour(timestamp) < 6 then null else pressure_hpa end, 1013.25) as pressure_hpa, boundary_layer_m from t_obs),
    m as (select location_hash, median(aod) as md from a group by 1), c as (select {KEYS}, coalesce(aod, md) as aod, temp_c, pressure_hpa, boundary_layer_m from a join m using (location_hash)),
    f as (select {KEYS}, pressure_hpa, boundary_layer_m, {_TWO.format(c='aod')} as aod, {_TWO.format(c='temp_c')} as temp_c from c)
    select {KEYS}, {r('pressure_hpa', 'boundary_layer_m', _BACK.format(c='aod') + ' as aod', _BACK.format(c='temp_c') + ' as temp_c')} from f""",
)
def f25(spark, sf):
    o = b.observations(spark, sf)
    at = F.hour("timestamp")
    cut = o.select(
        *K, F.when(at % 6 == 0, F.col("aod")).alias("aod"), F.when(at >= 3, F.col("temp_c")).alias("temp_c"), "humidity_pct", "wind_speed_ms",
        F.when(at >= 6, F.col("pressure_hpa")).alias("pressure_hpa"), "boundary_layer_m",
    )
    return rounded(px.fill_features(cut).select(*K, "pressure_hpa", "boundary_layer_m", "aod", "temp_c"))


_FB = ", ".join(
    f"first_value({c} ignore nulls) over ({_W} rows between current row and 3 following) as {c}" for c in RAW
)
_FF = ", ".join(
    f"last_value({'wind_speed_ms/3.6' if c == 'wind_speed_ms' else 'co/1000' if c == 'co' else c} ignore nulls) over ({_W} rows between 3 preceding and current row) as {c}" for c in RAW
)


@query("ingest_hours", f"select {KEYS}, {r(*RAW)} from (select {KEYS}, {_FB} from (select {KEYS}, {_FF} from t_obs))")
def ingest_hours(spark, sf):
    """Payload objects of both feeds, joined, converted and filled: the front half of an ingestion pass."""
    wx, aq = payloads(spark, sf, WEATHER_NAMES), payloads(spark, sf, AIR_NAMES)
    return rounded(ing.hours_from_payloads(wx, aq))


# ---- streams -----------------------------------------------------------------------------------

def _source(spark, df, name):
    """A table as files that a stream can pick up, in the order of the hours."""
    path = run_dir(spark, name)
    df.repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp").write.parquet(path)
    return jobs.read_stream(spark, path, df.schema)


def _drained(spark, df, name):
    out = run_dir(spark, name)
    jobs.drain(df, out, run_dir(spark, f"{name}-checkpoint"))
    return spark.read.schema(df.schema).parquet(out)


@query(
    "t1_daily_rollup",
    f"select date_trunc('day', timestamp)::timestamp as day, location_hash, {r('avg(aqi) as aqi_mean')}, max(aqi) as aqi_max, {r('avg(pm25_24h_avg) as pm25_mean')} from t_aqi8 group by 1, 2 having day + interval 1 day <= (select max(timestamp) - interval 3 days from t_aqi8)",
)
def t1(spark, sf):
    aqi = refresh_aqi(b.observations(spark, sf, "node8"))
    stream = _source(spark, aqi, "aqi")
    return rounded(_drained(spark, jobs.daily_rollup(stream), "rollup"))


@query(
    "t2_streaming_aqi",
    f"select {KEYS}, {r(*AVERAGES.values())}, {r(*SUB_INDICES.values())}, aqi, prominent_pollutant, aqi_category from t_aqi8",
)
def t2(spark, sf):
    """Three files in three batches: most hours, some with wrong values; then every third hour, late; then the wrong ones revised."""
    obs = b.observations(spark, sf, "node8").select(*K, *POLLUTANTS)
    part = F.when(F.hour("timestamp") % 3 == 0, 1).when(F.hour("timestamp") % 5 == 1, 2).otherwise(0)
    right = obs.withColumn("version", part)
    wrong = right.where("version = 2").withColumns({"version": F.lit(0), **{p: F.col(p) * 3 + 1 for p in POLLUTANTS}})
    path = run_dir(spark, "hours")
    for v in range(3):
        right.unionByName(wrong).where(F.col("version") == v).coalesce(1).write.mode("append").parquet(path)
    index, stream = run_dir(spark, "index"), jobs.read_stream(spark, path, right.schema, 1)
    jobs.index_stream(stream, run_dir(spark, "hours-table"), index, run_dir(spark, "index-checkpoint"), ["version"]).awaitTermination()
    return rounded(read_table(spark, index, refresh_aqi(obs).schema))


@query("t3_upsert_stream", f"select {KEYS}, {r('pm25 + 5 as pm25')}, cast(2 as int) as version from t_obs where hour(timestamp) % 3 = 0 union all select {KEYS}, {r('pm25')}, cast(1 as int) from t_obs where hour(timestamp) % 3 != 0")
def t3(spark, sf):
    first = b.observations(spark, sf).select(*K, "pm25", F.lit(1).alias("version")).withColumn("obs_date", F.to_date("timestamp"))
    late = first.where(F.hour("timestamp") % 3 == 0).withColumns({"pm25": F.col("pm25") + 5, "version": F.lit(2)})
    stream = _source(spark, late.unionByName(first), "revisions")
    path = run_dir(spark, "stream-upsert")
    jobs.upsert_stream(stream, path, run_dir(spark, "stream-upsert-checkpoint"), ["version"]).awaitTermination()
    return rounded(read_table(spark, path, first.schema).select(*K, "pm25", "version"))


@query("t4_first_per_hour", f"select {KEYS} from t_obs")
def t4(spark, sf):
    obs = b.observations(spark, sf).select(*K)
    stream = _source(spark, obs.unionByName(obs), "repeats")
    return _drained(spark, jobs.first_per_hour(stream, "31 days"), "firsts")


@query(
    "t5_live_skill",
    f"""select forecast_generated_at, hours_ahead, count(*) as n_nodes, {r('avg(abs(f.aqi-a.aqi)) as aqi_mae', 'sqrt(avg(pow(f.aqi-a.aqi,2))) as aqi_rmse', 'avg(f.aqi-a.aqi) as aqi_bias', 'avg(case when f.aqi_category = a.aqi_category then 1 else 0 end) as category_accuracy', 'avg(abs(i.aqi-a.aqi)) as persistence_aqi_mae', 'avg(abs(f.pm25-o.pm25)) as pm25_mae')}, max(f.model_version) as model_version
    from t_forecasts f join t_aqi8 a on a.location_hash = f.location_hash and a.timestamp = f.forecast_target_time join t_obs8 o on o.location_hash = f.location_hash and o.timestamp = f.forecast_target_time
    left join t_aqi8 i on i.location_hash = f.location_hash and i.timestamp = f.forecast_generated_at group by 1, 2""",
)
def t5(spark, sf):
    obs = b.observations(spark, sf, "node8")
    aqi = refresh_aqi(obs)
    fc = b.forecasts(obs, aqi).withColumn("timestamp", F.col("forecast_target_time"))
    came = aqi.join(obs.select(*K, "pm25"), K).select(*K, "aqi", "aqi_category", "pm25")
    folder = run_dir(spark, "came")
    came.repartitionByRange(4, "timestamp").write.parquet(folder)
    twice = [jobs.read_stream(spark, folder, came.schema) for _ in range(2)]
    pairs = jobs.live_pairs(_source(spark, fc, "issued").drop("timestamp"), *twice, "2 days", 24)
    return rounded(sk.skill(_drained(spark, pairs, "pairs")))


@query("t6_landing", f"select {KEYS}, {r(*['co/1000 as co' if c == 'co' else c for c in AIR_NAMES.values()])} from t_obs")
def t6(spark, sf):
    path = run_dir(spark, "landing")
    payloads(spark, sf, AIR_NAMES).write.option("ignoreNullFields", "false").json(path)
    return rounded(_drained(spark, jobs.landing(spark, path, AIR_NAMES), "landed"))
