"""Skill scoring and serving reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from vayuspark import bridges as b
from vayuspark.catalog.base import query, r, rounded
from vayuspark.operators import aggregates as ag, serving as sv, skill as sk
from vayuspark.plans.aqi import refresh_aqi
from vayuspark.vocab import AVERAGES, POLLUTANTS, SUB_INDICES

RUN = "forecast_generated_at"
AVG, SUB = list(AVERAGES.values()), list(SUB_INDICES.values())


def tables(spark, sf):
    """(hours, index, forecasts) of the dense nodes."""
    obs = b.observations(spark, sf, "node8")
    aqi = refresh_aqi(obs)
    return obs, aqi, b.forecasts(obs, aqi)


def scored(fc):
    """Runs of odd days count as scored already."""
    return fc.where(F.dayofmonth(RUN) % 2 == 1).select(RUN).distinct()


PENDING = f"(select distinct {RUN} from t_forecasts where {RUN} <= (select t - interval 25 hours from t_as_of) and day({RUN}) % 2 = 0)"
JOINED = f"""(select f.{RUN}, f.hours_ahead, f.location_hash, f.forecast_target_time, f.model_version, f.aqi as pred, a.aqi as actual, f.aqi_category as pred_cat,
  a.aqi_category as actual_cat, f.pm25 as pred_pm25, o.pm25 as actual_pm25, a0.aqi as issue_aqi
  from t_forecasts f join t_aqi8 a on a.location_hash = f.location_hash and a.timestamp = f.forecast_target_time
  left join t_obs8 o on o.location_hash = f.location_hash and o.timestamp = f.forecast_target_time
  left join t_aqi8 a0 on a0.location_hash = f.location_hash and a0.timestamp = f.{RUN})"""
SKILL = f"""(select {RUN}, hours_ahead, count(*) as n_nodes, avg(abs(pred-actual)) as aqi_mae, sqrt(avg(pow(pred-actual,2))) as aqi_rmse, avg(pred-actual) as aqi_bias,
  avg(case when pred_cat = actual_cat then 1 else 0 end) as category_accuracy, avg(abs(issue_aqi-actual)) as persistence_aqi_mae,
  avg(abs(pred_pm25-actual_pm25)) as pm25_mae, max(model_version) as model_version from {{j}} group by 1, 2)"""
METRICS = ["aqi_mae", "aqi_rmse", "aqi_bias", "category_accuracy", "persistence_aqi_mae", "pm25_mae"]


@query("b3_forecasts", f"select {RUN}, forecast_target_time, location_hash, hours_ahead, {r(*POLLUTANTS)}, aqi, aqi_lower, aqi_upper, aqi_category, prominent_pollutant, aqi_huber, model_version from t_forecasts")
def b3(spark, sf):
    return rounded(tables(spark, sf)[2].drop("aqi_gbt", "aqi_rf"))


@query("j7_pending_runs", f"select * from {PENDING}")
def j7(spark, sf):
    fc = tables(spark, sf)[2]
    return sk.pending_runs(fc, scored(fc), b.last_hour(spark, sf))


@query("j8_forecast_vs_actual", f"select {RUN}, hours_ahead, location_hash, forecast_target_time, model_version, pred, actual, pred_cat, actual_cat, {r('pred_pm25', 'actual_pm25')}, issue_aqi from {JOINED}")
def j8(spark, sf):
    obs, aqi, fc = tables(spark, sf)
    return rounded(sk.forecast_vs_actual(fc, aqi, obs))


@query("g3_skill", f"select {RUN}, hours_ahead, n_nodes, {r(*METRICS)}, model_version from {SKILL.format(j=JOINED)}")
def g3(spark, sf):
    obs, aqi, fc = tables(spark, sf)
    return rounded(sk.skill(sk.forecast_vs_actual(fc, aqi, obs)))


@query("m21_evaluate_forecast_skill", f"select {RUN}, hours_ahead, n_nodes, {r(*METRICS)}, model_version from {SKILL.format(j=f'(select * from {JOINED} where {RUN} in {PENDING})')}")
def m21(spark, sf):
    obs, aqi, fc = tables(spark, sf)
    return rounded(sk.evaluate_forecast_skill(fc, aqi, obs, scored(fc), b.last_hour(spark, sf)))


SUMMARY = f"""(select hours_ahead, sum(n_nodes)::bigint as n, sum(aqi_mae*n_nodes)/nullif(sum(n_nodes),0) as aqi_mae, sum(persistence_aqi_mae*n_nodes)/nullif(sum(n_nodes),0) as persistence_aqi_mae,
  sum(category_accuracy*n_nodes)/nullif(sum(n_nodes),0) as category_accuracy from {SKILL.format(j=JOINED)} where {RUN} >= (select t - interval 7 days from t_as_of) group by 1)"""


@query("g4_skill_summary", f"select hours_ahead, n, {r('aqi_mae', 'persistence_aqi_mae', 'category_accuracy')} from {SUMMARY}")
def g4(spark, sf):
    obs, aqi, fc = tables(spark, sf)
    return rounded(sk.skill_summary(sk.skill(sk.forecast_vs_actual(fc, aqi, obs)), b.last_hour(spark, sf)))


@query("g5_live_mae", f"select sum(n)::bigint as n, {r('sum(aqi_mae*n)/sum(n) as aqi_mae', 'sum(persistence_aqi_mae*n)/sum(n) as persistence_aqi_mae')} from {SUMMARY}")
def g5(spark, sf):
    obs, aqi, fc = tables(spark, sf)
    return rounded(sk.live_mae(sk.skill_summary(sk.skill(sk.forecast_vs_actual(fc, aqi, obs)), b.last_hour(spark, sf))))


LATEST = "(select a.*, n.location_name, n.state, n.lat, n.lon, n.kind from (select *, row_number() over (partition by location_hash order by timestamp desc) as rn from t_aqi where timestamp >= (select t - interval 2 days from t_as_of)) a join t_nodes n using (location_hash) where rn = 1)"


def latest(spark, sf):
    return sv.latest_aqi(refresh_aqi(b.observations(spark, sf)), b.nodes(spark, sf), b.last_hour(spark, sf))


@query("w12_latest_aqi", f"select location_hash, timestamp, aqi, aqi_category, prominent_pollutant, {r(*AVG)}, {r(*SUB)}, location_name, state, {r('lat', 'lon')}, kind from {LATEST}")
def w12(spark, sf):
    return rounded(latest(spark, sf))


@query("p12_map_rows", f"select location_hash as h, location_name as name, state, {r('lat', 'lon')}, kind, timestamp as t, aqi, aqi_category as cat, prominent_pollutant as pol from {LATEST}")
def p12(spark, sf):
    return rounded(sv.map_rows(latest(spark, sf)))


@query("g15_category_counts", f"select aqi_category, count(*) as n from {LATEST} group by 1")
def g15c(spark, sf):
    return ag.category_counts(latest(spark, sf))


@query("g15_health", f"select (select count(*) from t_nodes) as nodes, max({RUN}) as latest_forecast_run from t_forecasts")
def g15(spark, sf):
    return ag.health(b.nodes(spark, sf), tables(spark, sf)[2])


NEWEST = f"(select * from (select *, max({RUN}) over (partition by location_hash) as m from t_forecasts where {RUN} >= (select t - interval 2 days from t_as_of) and {RUN} <= (select t from t_as_of)) where m = {RUN})"


def newest(spark, sf):
    return sv.latest_forecast(tables(spark, sf)[2], b.last_hour(spark, sf))


@query("j10_latest_forecast", f"select {RUN}, forecast_target_time, location_hash, hours_ahead, {r(*POLLUTANTS)}, aqi, aqi_category, model_version from {NEWEST}")
def j10(spark, sf):
    cols = [RUN, "forecast_target_time", "location_hash", "hours_ahead", *POLLUTANTS, "aqi", "aqi_category", "model_version"]
    return rounded(newest(spark, sf).select(*cols))


@query(
    "g6_forecast_summary",
    f"""with c as (select location_hash, aqi_category, count(*) as n, min(hours_ahead) as f from {NEWEST} group by 1, 2),
    d as (select *, row_number() over (partition by location_hash order by n desc, f) as rk from c)
    select location_hash, aqi_min, aqi_max, d.aqi_category as dominant_category, x.{RUN}, x.model_version from d join
      (select location_hash, min(aqi) as aqi_min, max(aqi) as aqi_max, max({RUN}) as {RUN}, max(model_version) as model_version from {NEWEST} group by 1) x using (location_hash) where rk = 1""",
)
def g6(spark, sf):
    return sv.forecast_summary(newest(spark, sf))


@query("g7_forecast_peak", f"select location_hash, forecast_target_time, hours_ahead, aqi, aqi_category from (select *, row_number() over (partition by location_hash order by aqi desc, hours_ahead) as rk from {NEWEST}) where rk = 1")
def g7(spark, sf):
    return sv.forecast_peak(newest(spark, sf))


@query("p11_history", f"select location_hash, timestamp, aqi, aqi_category, {r('pm25_24h_avg', 'pm10_24h_avg')} from t_aqi where timestamp >= (select t - interval 72 hours from t_as_of)")
def p11(spark, sf):
    return rounded(sv.history(refresh_aqi(b.observations(spark, sf)), b.last_hour(spark, sf)))


_CELL = "max(case when hours_ahead = {h} then round({p} + 1e-9, {d}) end) as h{h}"


@query(
    "f23_outlook",
    " union all ".join(
        f"select location_hash, '{p}' as pollutant, " + ", ".join(_CELL.format(h=h, p=p, d=2 if p == "co" else 0) for h in (6, 12, 24)) + f" from {NEWEST} group by 1"
        for p in POLLUTANTS
    ),
)
def f23(spark, sf):
    return sv.outlook(newest(spark, sf))


@query("s1_ordered_history", "select location_hash, timestamp, aqi from t_aqi")
def s1(spark, sf):
    return refresh_aqi(b.observations(spark, sf)).select("location_hash", "timestamp", "aqi").orderBy("location_hash", "timestamp")


@query("s4_newest_card", "select arg_max(model_version, used) as model_version, arg_max(card, used) as card from (select c_mktsegment as model_version, '{\"n\":' || count(*)::varchar || '}' as card, max(c_custkey) as used from customer group by 1)")
def s4(spark, sf):
    per = b.table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("u"))
    return sv.newest_card(per.select(
        F.col("c_mktsegment").alias("model_version"), F.format_string('{"n":%d}', "n").alias("card"), F.timestamp_seconds("u").alias("last_used_at")
    ))


@query(
    "snk7_export_snapshot",
    f"""with l as (select * from t_aqi8 qualify row_number() over (partition by location_hash order by timestamp desc) = 1),
    f as (select location_hash, string_agg(strftime(forecast_target_time, '%Y-%m-%dT%H') || ' ' || hours_ahead || ' ' || aqi || ' ' || aqi_category, ';' order by forecast_target_time) as x from {NEWEST} group by 1),
    h as (select location_hash, string_agg(strftime(timestamp, '%Y-%m-%dT%H') || ' ' || coalesce(cast(aqi as varchar), 'null'), ';' order by timestamp) as x from t_aqi8 where timestamp >= (select max(timestamp) - interval 72 hours from l) group by 1)
    select 'node' as kind, location_hash as id, upper(location_hash) as name, cast(null as varchar) as generated_at, coalesce(f.x, '') as forecast, coalesce(h.x, '') as history, l.aqi as aqi, l.aqi_category as category
    from l left join f using (location_hash) left join h using (location_hash)
    union all select 'skill', 'seasonal', 'seasonal', strftime((select t from t_as_of), '%Y-%m-%dT%H:%M:%S'), '', '', null, null""",
)
def snk7(spark, sf):
    """One JSON line per node with its forecast and history hours, and the head line, written as text and read back."""
    from vayuspark.session import run_dir

    obs8, aqi8, fc = tables(spark, sf)
    n8 = b.nodes8(spark, sf).withColumns({"location_name": F.upper("location_hash"), "state": F.lit("x"), "kind": F.lit("city")})
    registry = fc.groupBy("model_version").agg(F.max(RUN).alias("last_used_at"), F.count(F.lit(1)).alias("n")).select(
        "model_version", F.to_json(F.struct("model_version", "n")).alias("card"), "last_used_at"
    )
    path = run_dir(spark, "snapshot")
    sv.as_json(sv.snapshot_lines(aqi8, fc, n8, b.last_hour(spark, sf), registry)).write.text(path)
    detail = (
        "kind string, id string, value struct<generated_at string, skill struct<model_version string>, map struct<name string>, node struct<aqi int, aqi_category string>, "
        "forecast array<struct<forecast_target_time string, hours_ahead int, aqi int, aqi_category string>>, history array<struct<timestamp string, aqi int>>>"
    )
    v = spark.read.text(path).select(F.from_json("value", detail).alias("l")).select("l.kind", "l.id", "l.value.*")
    hour = lambda c: F.substring(c, 1, 13)
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ";"), F.lit(""))
    return v.select(
        "kind", "id", F.coalesce("map.name", "skill.model_version").alias("name"), "generated_at",
        text("forecast", lambda x: F.concat_ws(" ", hour(x["forecast_target_time"]), x["hours_ahead"].cast("string"), x["aqi"].cast("string"), x["aqi_category"])).alias("forecast"),
        text("history", lambda x: F.concat_ws(" ", hour(x["timestamp"]), F.coalesce(x["aqi"].cast("string"), F.lit("null")))).alias("history"),
        F.col("node.aqi").alias("aqi"), F.col("node.aqi_category").alias("category"),
    )
