"""Scalar functions, projections and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vayuspark import bridges as b
from vayuspark.catalog.base import query, r, rounded
from vayuspark.catalog.ctes import category_index_sql, category_sql, half_even_sql, sub_index_sql
from vayuspark.functions import calendar as cal, cpcb, geo, values
from vayuspark.operators import quality as q
from vayuspark.operators.nodes import breakpoints
from vayuspark.vocab import (
    BREAKPOINTS, INDEX_LEVELS, LABELS, MOLAR_MASS, POLLUTANTS, RAW, SUB_INDICES, WINDOW_HOURS,
)

KEYS = "location_hash, timestamp"
K = ["location_hash", "timestamp"]
SUB = list(SUB_INDICES.values())
TWO_PI = "(2*pi())"


def obs(spark, sf):
    return b.observations(spark, sf)


@query(
    "f1_cpcb_sub_index",
    f"select {KEYS}, " + ", ".join(r(f"{sub_index_sql(p, p)} as {SUB_INDICES[p]}") for p in POLLUTANTS) + " from t_obs",
)
def f1(spark, sf):
    cols = [cpcb.sub_index(p, p).alias(SUB_INDICES[p]) for p in POLLUTANTS]
    return rounded(obs(spark, sf).select(*K, *cols))


@query(
    "x1_sql_functions",
    f"select {KEYS}, {r(sub_index_sql('pm25', 'pm25') + ' as index_pm25')}, {category_sql('round(pm25,6)')} as category from t_obs",
)
def x1(spark, sf):
    cpcb.register_sql_functions(spark)
    points = ", ".join(f"{c}D" for c in BREAKPOINTS["pm25"])
    text = f"select {KEYS}, cpcb_sub_index(pm25, array({points})) as index_pm25, cpcb_category(round(pm25, 6)) as category from {{o}}"
    return rounded(spark.sql(text, o=obs(spark, sf)))


@query("f2_cpcb_category", f"select {KEYS}, aqi, {category_sql('aqi')} as aqi_category from (select *, {half_even_sql('pm10')} as aqi from t_obs)")
def f2(spark, sf):
    df = obs(spark, sf).select(*K, cpcb.half_even(F.col("pm10")).alias("aqi"))
    return df.withColumn("aqi_category", cpcb.category(F.col("aqi")))


@query("f3_category_index", f"select {KEYS}, cast({category_index_sql(half_even_sql('pm10'))} as int) as idx from t_obs")
def f3(spark, sf):
    return obs(spark, sf).select(*K, cpcb.category_index(cpcb.half_even(F.col("pm10"))).alias("idx"))


_COMPOSITE = ", ".join(f"round({sub_index_sql(p, p)} + 1e-9, 2) as {SUB_INDICES[p]}" for p in POLLUTANTS)


@query(
    "f4_composite_aqi",
    f"""with s as (select {KEYS}, {_COMPOSITE} from t_obs), t as (select *, greatest({', '.join(SUB)}) as top_ from s)
    select {KEYS}, {r(*SUB)}, {half_even_sql('top_')} as aqi,
      case {' '.join(f"when {SUB_INDICES[p]} = top_ then '{LABELS[p]}'" for p in POLLUTANTS)} end as prominent_pollutant,
      coalesce({category_sql(half_even_sql('top_'))}, 'Insufficient Data') as aqi_category from t""",
)
def f4(spark, sf):
    df = cpcb.composite(obs(spark, sf).select(*K, *POLLUTANTS), {p: p for p in POLLUTANTS})
    return rounded(df.drop(*POLLUTANTS))


@query(
    "f5_rounded_top",
    f"""with s as (select {KEYS}, {', '.join(f"round({sub_index_sql(p, p)} + 1e-9, 6) as {SUB_INDICES[p]}" for p in POLLUTANTS)} from t_obs)
    select {KEYS}, {half_even_sql(f"greatest({', '.join(SUB)})")} as aqi from s where greatest({', '.join(SUB)}) is not null""",
)
def f5(spark, sf):
    return cpcb.with_aqi(obs(spark, sf).select(*K, *POLLUTANTS), {p: p for p in POLLUTANTS}).select(*K, "aqi")


@query(
    "f6_prominent_pollutant",
    f"""with s as (select {KEYS}, {', '.join(f"round({sub_index_sql(p, p)} + 1e-9, 6) as {SUB_INDICES[p]}" for p in POLLUTANTS)} from t_obs),
    t as (select *, greatest({', '.join(SUB)}) as top_ from s)
    select prominent_pollutant, count(*) as n from (select case {' '.join(f"when {SUB_INDICES[p]} = top_ then '{LABELS[p]}'" for p in POLLUTANTS)} end
      as prominent_pollutant from t where top_ is not null) group by 1""",
)
def f6(spark, sf):
    df = cpcb.with_aqi(obs(spark, sf).select(*K, *POLLUTANTS), {p: p for p in POLLUTANTS})
    return df.groupBy("prominent_pollutant").agg(F.count(F.lit(1)).alias("n"))


_HAV = "2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(28.6139-lat)/2),2) + cos(radians(lat))*cos(radians(28.6139))*pow(sin(radians(77.209-lon)/2),2))))"


@query("f7_haversine_km", f"select location_hash, {r(_HAV + ' as km', digits=5)} from t_nodes")
def f7(spark, sf):
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(28.6139), F.lit(77.2090))
    return rounded(b.nodes(spark, sf).select("location_hash", km.alias("km")), 5)


@query("f8_equirect_km", f"""select location_hash, {r('111.32*sqrt(pow(lat-28.6139,2)+pow((lon-77.209)*cos(radians(28.6139)),2)) as km', digits=5)} from t_nodes""")
def f8(spark, sf):
    km = geo.equirect_km(F.lit(28.6139), F.lit(77.2090), F.col("lat"), F.col("lon"))
    return rounded(b.nodes(spark, sf).select("location_hash", km.alias("km")), 5)


@query("f9_location_hash", "select location_hash as node, substring(md5(concat(cast(round(lat,3) as varchar), ',', cast(round(lon,3) as varchar))),1,8) as hash from t_nodes")
def f9(spark, sf):
    return b.nodes(spark, sf).select(F.col("location_hash").alias("node"), geo.location_hash(F.col("lat"), F.col("lon")).alias("hash"))


@query("f10_wind_vector", f"select {KEYS}, {r('-wind_speed_ms*sin(radians(wind_dir_deg)) as wind_u', '-wind_speed_ms*cos(radians(wind_dir_deg)) as wind_v')} from t_obs")
def f10(spark, sf):
    u, v = values.wind_vector(F.col("wind_speed_ms"), F.col("wind_dir_deg"))
    return rounded(obs(spark, sf).select(*K, u.alias("wind_u"), v.alias("wind_v")))


@query("f11_log_positive", f"select {KEYS}, {r(*[f'case when {c} is not null then ln(1+greatest({c}-4,0)) end as log_{c}' for c in ('pm25', 'o3', 'dust')])} from t_obs")
def f11(spark, sf):
    return rounded(obs(spark, sf).select(*K, *[values.log_positive(F.col(c) - 4).alias(f"log_{c}") for c in ("pm25", "o3", "dust")]))


@query("f12_delta_to_conc", f"select {KEYS}, {r('exp(greatest(ln(1+pm25)+ln(1+o3)-3,0))-1 as conc', digits=5)} from t_obs where o3 is not null union all select {KEYS}, null as conc from t_obs where o3 is null")
def f12(spark, sf):
    conc = values.delta_to_conc(F.log1p("pm25"), F.log1p("o3") - 3)
    return rounded(obs(spark, sf).select(*K, conc.alias("conc")), 5)


_CAL = [
    f"sin({TWO_PI}*hour(lt)/24) as hour_sin", f"cos({TWO_PI}*hour(lt)/24) as hour_cos",
    f"sin({TWO_PI}*(isodow(lt)-1)/7) as dow_sin", f"cos({TWO_PI}*(isodow(lt)-1)/7) as dow_cos",
    f"sin({TWO_PI}*dayofyear(lt)/365.25) as doy_sin", f"cos({TWO_PI}*dayofyear(lt)/365.25) as doy_cos",
    "case when isodow(lt)>=6 then 1 else 0 end as is_weekend",
]


@query("f13_local_calendar", f"select {KEYS}, {r(*_CAL)} from (select *, timestamp + interval 330 minutes as lt from t_obs)")
def f13(spark, sf):
    return rounded(obs(spark, sf).select(*K, *[c.alias(n) for n, c in cal.local_calendar(F.col("timestamp")).items()]))


@query(
    "f14_utc_calendar",
    f"select {KEYS}, " + r(
        f"sin({TWO_PI}*hour(timestamp)/24) as hour_sin", f"cos({TWO_PI}*hour(timestamp)/24) as hour_cos",
        f"sin({TWO_PI}*month(timestamp)/12) as month_sin", f"cos({TWO_PI}*month(timestamp)/12) as month_cos",
    ) + " from t_obs",
)
def f14(spark, sf):
    return rounded(obs(spark, sf).select(*K, *[c.alias(n) for n, c in cal.utc_calendar(F.col("timestamp")).items()]))


@query("f15_unit_coordinates", f"select location_hash, {r('(lat-6.5)/31 as lat_norm', '(lon-68)/29.5 as lon_norm')} from t_nodes")
def f15(spark, sf):
    lat, lon = geo.unit_coordinates(F.col("lat"), F.col("lon"))
    return rounded(b.nodes(spark, sf).select("location_hash", lat.alias("lat_norm"), lon.alias("lon_norm")))


@query("f17_column_density", f"select {KEYS}, " + r(*[f"{p}*{m}/boundary_layer_m*1e6 as {p}" for p, m in MOLAR_MASS.items()], digits=4) + " from t_obs")
def f17(spark, sf):
    return rounded(obs(spark, sf).select(*K, *[
        values.column_density_to_ug(F.col(p), m, F.col("boundary_layer_m")).alias(p) for p, m in MOLAR_MASS.items()
    ]), 4)


_LONG = " union all ".join(f"select {KEYS}, '{v}' as variable, {v} as value from t_obs" for v in ("no2", "so2", "co", "o3", "aod"))


_SCALED = "value * case when variable in ('no2','so2') then 1e6 when variable in ('co','o3') then 1e3 else 1 end as value"


@query("f18_satellite_scale", f"select {KEYS}, variable, {r(_SCALED, digits=3)} from ({_LONG})")
def f18(spark, sf):
    long = obs(spark, sf).unpivot(K, ["no2", "so2", "co", "o3", "aod"], "variable", "value")
    return rounded(long.withColumn("value", F.col("value") * values.satellite_scale(F.col("variable"))), 3)


@query("f19_floor_hour", "select date_trunc('hour', cast(ts as timestamp)) as hour, count(*) as n from events where cast(ts as timestamp) >= (select t - interval 3 days from t_as_of) group by 1")
def f19(spark, sf):
    events = b.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    recent = events.where(F.col("ts") >= b.last_hour(spark, sf) - cal.days(3))
    return recent.groupBy(cal.floor_hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("f20_divide_clamp", f"select {KEYS}, {r('case when precip_mm = 0 then -1 else pm25/precip_mm end as ratio', 'greatest(10, least(60, pm10)) as clamped')} from t_obs")
def f20(spark, sf):
    return rounded(obs(spark, sf).select(
        *K, values.safe_divide(F.col("pm25"), F.col("precip_mm"), -1.0).alias("ratio"), values.clamp(F.col("pm10"), 10.0, 60.0).alias("clamped")
    ))


@query("f21_grid_label", "select location_hash, printf('Grid %.2fN %.2fE (near %s)', lat, lon, state) as label from t_nodes")
def f21(spark, sf):
    return b.nodes(spark, sf).select("location_hash", geo.grid_label(F.col("lat"), F.col("lon"), F.col("state")).alias("label"))


@query("f22_display_time", f"select {KEYS}, lower(strftime(timestamp + interval 330 minutes, '%d %b, %I:%M %p')) as shown from t_obs")
def f22(spark, sf):
    return obs(spark, sf).select(*K, cal.display_time(F.col("timestamp")).alias("shown"))


@query(
    "f24_redact",
    """select event_id, event_type, '***REDACTED***' as token, '***REDACTED***' as secret, user_id::varchar as user_id from events""",
)
def f24(spark, sf):
    events = b.table(spark, sf, "events")
    entries = F.create_map(
        F.lit("Token"), F.col("props"), F.lit("secret"), F.col("value").cast("string"), F.lit("user"), F.col("user_id").cast("string")
    )
    masked = events.select("event_id", "event_type", values.redact(entries).alias("m"))
    return masked.select("event_id", "event_type", F.col("m")["Token"].alias("token"), F.col("m")["secret"].alias("secret"), F.col("m")["user"].alias("user_id"))


@query("p1_standardise_units", f"select {KEYS}, {r('wind_speed_ms/3.6 as wind_speed_ms', 'co/1000 as co', 'pm25')} from t_obs")
def p1(spark, sf):
    return rounded(q.standardise_units(obs(spark, sf).select(*K, "wind_speed_ms", "co", "pm25")))


@query("p2_complete_schema", f"select {KEYS}, {r('pm25')}, " + ", ".join(f"cast(null as double) as {c}" for c in RAW if c != "pm25") + ", false as pm_gap_filled from t_obs")
def p2(spark, sf):
    return rounded(q.complete_schema(obs(spark, sf).select(*K, "pm25")))


@query(
    "p3_split_observed_future",
    """select 'observed' as part, location_hash, count(*) as n, max(timestamp) as last from t_obs where timestamp <= (select t - interval 60 hours from t_as_of) group by 2
    union all select 'future', location_hash, count(*), max(timestamp) from t_obs where timestamp > (select t - interval 60 hours from t_as_of)
      and timestamp <= (select t - interval 12 hours from t_as_of) group by 2""",
)
def p3(spark, sf):
    clock = b.last_hour(spark, sf) - cal.hours(60) + F.make_dt_interval(mins=F.lit(30))
    seen, ahead = q.split_observed_future(obs(spark, sf), clock)
    count = lambda d, n: d.groupBy(F.lit(n).alias("part"), "location_hash").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"))
    return count(seen, "observed").unionByName(count(ahead, "future"))


@query(
    "p4_training_nodes",
    """select location_hash, kind from t_nodes where kind = 'city' union all
    select location_hash, kind from (select *, row_number() over (order by lat, lon, location_hash) - 1 as i from t_nodes where kind = 'grid') where i % 10 = 0""",
)
def p4(spark, sf):
    return q.training_nodes(b.nodes(spark, sf)).select("location_hash", "kind")


@query("p5_within_box", "select point_id from (select o_orderkey as point_id, lat*1.1 as lat, lon*0.98 as lon from t_points join orders on o_orderkey = point_id) where lat between 6.0 and 37.5 and lon between 68.0 and 98.0")
def p5(spark, sf):
    moved = b.points(spark, sf).withColumns({"lat": F.col("lat") * 1.1, "lon": F.col("lon") * 0.98})
    return q.within_box(moved).select("point_id")


@query("p6_mask_gap_filled_targets", f"select {KEYS}, {r('case when coalesce(aod > 0.8, false) then null else pm25 end as pm25', 'case when coalesce(aod > 0.8, false) then null else pm10 end as pm10', 'no2')} from t_obs")
def p6(spark, sf):
    df = obs(spark, sf).withColumn("pm_gap_filled", F.col("aod") > 0.8)
    return rounded(q.mask_gap_filled_targets(df).select(*K, "pm25", "pm10", "no2"))


@query(
    "p7_validate_ingestion",
    " union all ".join(f"select count(*) as n_rows, '{c}' as variable, {r(f'avg(case when {c} is not null then 1 else 0 end) as coverage')}, avg(case when {c} is not null then 1 else 0 end) < 0.3 as sparse from t_obs" for c in ("no2", "so2", "co", "o3", "aod")),
)
def p7(spark, sf):
    return rounded(q.validate_ingestion(obs(spark, sf)))


_HOLES = f"(select {KEYS}, case when hour(timestamp) < 12 then null else aod end as aod, case when hour(timestamp) < 8 then null else temp_c end as temp_c, case when hour(timestamp) < 4 then null else humidity_pct end as humidity_pct, pm25, pm10 from t_obs)"


def holes(df):
    cut = lambda c, h: F.when(F.hour("timestamp") >= h, F.col(c)).alias(c)
    return df.select(*K, cut("aod", 12), cut("temp_c", 8), cut("humidity_pct", 4), "pm25", "pm10")


@query("p8_validate_proxy_input", f"select {KEYS}, {r('aod', 'temp_c', 'humidity_pct')} from {_HOLES} where coalesce(aod, temp_c, humidity_pct) is not null")
def p8(spark, sf):
    return rounded(q.validate_proxy_input(holes(obs(spark, sf))).drop("pm25", "pm10"))


@query("p8_proxy_input_counts", f"select count(*) as n_rows, count(*) filter (coalesce(aod, temp_c, humidity_pct) is null) as n_dropped from {_HOLES}")
def p8n(spark, sf):
    return q.proxy_input_counts(holes(obs(spark, sf)))


@query("p9_training_rows", f"select {KEYS}, {r('aod', 'pm25', 'pm10')} from {_HOLES} where aod is not null and pm25 is not null and pm10 is not null")
def p9(spark, sf):
    return rounded(q.training_rows(holes(obs(spark, sf))).select(*K, "aod", "pm25", "pm10"))


@query("p10_nan_to_null", f"select {KEYS}, {r('case when hour(timestamp) = 5 then null else pm25 end as pm25', 'o3')} from t_obs")
def p10(spark, sf):
    nan = F.when(F.hour("timestamp") == 5, F.lit(float("nan"))).otherwise(F.col("pm25")).alias("pm25")
    return rounded(values.nan_to_null(obs(spark, sf).select(*K, nan, "o3")))


@query(
    "src9_breakpoints",
    "select pollutant, label, hours, segment, count(*) as n from ("
    + " union all ".join(
        f"select '{p}' as pollutant, '{LABELS[p]}' as label, {WINDOW_HOURS[p]} as hours, cast({i} as int) as segment from t_obs where {p} >= {BREAKPOINTS[p][i]} and {p} < {BREAKPOINTS[p][i + 1]}"
        for p in POLLUTANTS for i in range(len(INDEX_LEVELS) - 1)
    ) + ") group by 1, 2, 3, 4",
)
def src9(spark, sf):
    """Hours per breakpoint segment: the constant dimension joined to the hourly values."""
    long = obs(spark, sf).unpivot(K, POLLUTANTS, "pollutant", "value")
    dim = breakpoints(spark)
    hit = long.join(F.broadcast(dim), (long["pollutant"] == dim["pollutant"]) & (F.col("value") >= F.col("c_from")) & (F.col("value") < F.col("c_to")))
    return hit.groupBy(dim["pollutant"], "label", "hours", "segment").agg(F.count(F.lit(1)).alias("n"))
