"""Sources, sinks, joins, nodes, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vayuspark import bridges as b
from vayuspark.catalog.base import query, r, rounded
from vayuspark.functions import calendar as cal
from vayuspark.operators import aggregates as ag, joins as j, nodes as nd, spatial as sp, windows as w
from vayuspark.operators.blocks import exact_quantiles
from vayuspark.session import run_dir
from vayuspark.sources import readers as rd, tables as tb
from vayuspark.vocab import AIR_NAMES, POLLUTANTS, SATELLITE, WEATHER_NAMES

KEYS = "location_hash, timestamp"
K = ["location_hash", "timestamp"]


def obs(spark, sf):
    return b.observations(spark, sf)


def dated(df, ts="timestamp", name="obs_date"):
    return df.withColumn(name, F.to_date(ts))


# ---- sources -----------------------------------------------------------------------------------

@query("src1_read_grid", f"select {r('lat', 'lon')} from t_nodes where kind = 'grid'")
def src1(spark, sf):
    path = run_dir(spark, "grid")
    b.nodes(spark, sf).where("kind = 'grid'").select("lat", "lon").write.csv(path, header=True)
    return rounded(rd.read_grid(spark, path))


def write_history(spark, sf):
    path = run_dir(spark, "history")
    n = b.nodes(spark, sf).select("location_hash", "lat", "lon")
    dated(obs(spark, sf).join(n, "location_hash")).write.partitionBy("obs_date").parquet(path)
    return path


@query(
    "src2_read_history",
    f"select location_hash, {r('lat', 'lon')}, n, {r('pm25')} from (select location_hash, n.lat, n.lon, count(*) as n, avg(pm25) as pm25 from t_obs o join t_nodes n using (location_hash) group by 1, 2, 3)",
)
def src2(spark, sf):
    nodes, hours = rd.read_history(spark, write_history(spark, sf))
    per_node = hours.groupBy("location_hash").agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("pm25"))
    return rounded(nodes.join(per_node, "location_hash"))


@query("src3_read_training_csv", f"select timestamp, {r('aod', 'pm25', 'pm10')} from t_obs")
def src3(spark, sf):
    path = run_dir(spark, "training")
    obs(spark, sf).select("timestamp", "aod", "pm25", "pm10").write.csv(path, header=True)
    return rounded(rd.read_training_csv(spark, path, ["aod", "pm25", "pm10"]))


def payloads(spark, sf, names, node_col="location_hash"):
    """Hourly JSON objects per node and day, as a feed would deliver them."""
    hour = F.struct(F.col("timestamp"), *[F.col(c).alias(n) for n, c in names.items()])
    grouped = obs(spark, sf).groupBy("location_hash", F.to_date("timestamp").alias("d")).agg(
        F.array_sort(F.collect_list(hour)).alias("h")
    )
    arrays = [F.transform("h.timestamp", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm")).alias("time")]
    arrays += [F.col(f"h.{n}").alias(n) for n in names]
    return grouped.select("location_hash", F.struct(*arrays).alias("hourly"))


@query("src4_explode_hourly", f"select {KEYS}, {r(*AIR_NAMES.values())} from t_obs")
def src4(spark, sf):
    path = run_dir(spark, "payloads")
    payloads(spark, sf, AIR_NAMES).write.option("ignoreNullFields", "false").json(path)
    raw = spark.read.schema(rd.hourly_schema(AIR_NAMES)).json(path)
    return rounded(rd.explode_hourly(raw, AIR_NAMES))


@query("src4_read_payloads", f"select {KEYS}, {r(*WEATHER_NAMES.values())} from t_obs")
def src4_lists(spark, sf):
    """Files that hold one list of payload objects each, read as landed files are."""
    path = run_dir(spark, "payload-lists")
    objects = payloads(spark, sf, WEATHER_NAMES).withColumn("part", F.crc32("location_hash") % 64)
    one = F.to_json(F.struct("location_hash", "hourly"), {"ignoreNullFields": "false"})
    lists = objects.groupBy("part").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(one), ",\n"), F.lit("\n]")).alias("value"))
    lists.write.partitionBy("part").text(path)
    return rounded(rd.explode_hourly(rd.read_payloads(spark, path, WEATHER_NAMES).drop("part"), WEATHER_NAMES))


@query("src5_parse_region", f"select {KEYS}, {r('case when hour(timestamp) = 3 then null else aod end as aod')} from t_obs")
def src5(spark, sf):
    """Satellite answers per node and day: header row, epoch milliseconds, numbers as text."""
    text = F.when(F.hour("timestamp") == 3, F.lit("None")).otherwise(F.col("aod").cast("string"))
    row = F.array(F.lit("id"), (F.unix_timestamp("timestamp") * 1000).cast("string"), text)
    grouped = obs(spark, sf).groupBy("location_hash", F.to_date("timestamp").alias("d")).agg(F.collect_list(row).alias("rows"))
    header = F.array(F.array(F.lit("id"), F.lit("time"), F.lit("Optical_Depth_047")))
    regions = grouped.select("location_hash", F.concat(header, F.col("rows")).alias("region"))
    return rounded(rd.parse_region(regions, "Optical_Depth_047", out="aod"))


@query("src6_load_observations", f"select {KEYS}, {r(*POLLUTANTS)} from t_obs where timestamp >= (select t - interval 8 days from t_as_of) and location_hash in (select location_hash from t_nodes where kind = 'city')")
def src6(spark, sf):
    path = run_dir(spark, "raw")
    dated(obs(spark, sf)).write.partitionBy("obs_date").parquet(path)
    chosen = b.nodes(spark, sf).where("kind = 'city'")
    rows = rd.load_observations(spark.read.parquet(path), b.last_hour(spark, sf), 8, chosen)
    return rounded(rows.select(*K, *POLLUTANTS))


@query("src7_read_parts", f"select {KEYS}, {r('pm25')}, cast(day(timestamp) % 3 as int) as batch from t_obs")
def src7(spark, sf):
    path = run_dir(spark, "parts")
    obs(spark, sf).select(*K, "pm25", (F.dayofmonth("timestamp") % 3).alias("batch")).write.partitionBy("batch").parquet(path)
    return rounded(rd.read_parts(spark, f"{path}").select(*K, "pm25", F.col("batch").cast("int")))


@query(
    "src8_read_weights",
    "with a as (select round(avg(aod) + 1e-9, 3) as a from t_obs) select pollutant, member, round(case when pollutant != 'pm25' then fallback when member = 'huber' then a when member = 'gbt' then 1 - a else 0 end + 1e-9, 6) as weight "
    "from a, (select unnest(['pm25','pm10','no2','so2','co','o3']) as pollutant), (values ('huber', 0.4::double), ('gbt', 0.3::double), ('rf', 0.3::double)) m(member, fallback)",
)
def src8(spark, sf):
    """Mean of weighted hourly PM: learnt weights from a JSON file derived from the data, defaults where it has none."""
    path = run_dir(spark, "weights")
    shares = obs(spark, sf).agg(F.avg("aod").alias("a"))
    text = F.format_string('{"pm25": {"huber": %.3f, "gbt": %.3f}}', F.col("a"), 1 - F.col("a"))
    shares.select(text.alias("value")).write.text(path)
    return rounded(rd.read_weights(spark, path))


# ---- sinks -------------------------------------------------------------------------------------

@query(
    "snk1_upsert",
    f"select {KEYS}, {r('case when hour(timestamp) % 3 = 0 then pm25 + 5 else pm25 end as pm25', 'case when hour(timestamp) % 3 = 0 then null else no2 end as no2')}, cast(case when hour(timestamp) % 3 = 0 then 2 else 1 end as int) as version from t_obs",
)
def snk1(spark, sf):
    """A first load, a revision of every third hour, the same revision again."""
    path = run_dir(spark, "upsert")
    first = dated(obs(spark, sf).select(*K, "pm25", "no2")).withColumn("version", F.lit(1))
    late = first.where(F.hour("timestamp") % 3 == 0).withColumns(
        {"pm25": F.col("pm25") + 5, "no2": F.lit(None).cast("double"), "version": F.lit(2)}
    )
    for rows in (first, late, late):
        tb.upsert(spark, path, rows, K, ["version"], "obs_date")
    return rounded(tb.read_table(spark, path, first.schema).select(*K, "pm25", "no2", "version"))


@query("snk2_insert_if_absent", f"select {KEYS}, {r('case when hour(timestamp) < 12 then pm25 else pm25 + 100 end as pm25')} from t_obs")
def snk2(spark, sf):
    path = run_dir(spark, "insert")
    rows = dated(obs(spark, sf).select(*K, "pm25"))
    tb.insert_if_absent(spark, path, rows.where(F.hour("timestamp") < 12), K, "obs_date")
    more = rows.withColumn("pm25", F.col("pm25") + 100)
    for _ in range(2):
        tb.insert_if_absent(spark, path, more, K, "obs_date")
    return rounded(tb.read_table(spark, path, rows.schema).select(*K, "pm25"))


@query(
    "snk3_register_model",
    """select 'v' || cast(c_nationkey as varchar) as model_version, case when c_nationkey % 2 = 0 then '{"n":' || cast(count(*) as varchar) || '}' else '{"old":1}' end as card,
    cast('2024-01-01' as timestamp) as first_used_at, cast(case when c_nationkey % 2 = 0 then '2024-02-01' else '2024-01-01' end as timestamp) as last_used_at
    from customer where c_nationkey < 20 group by c_nationkey
    union all select 'v' || cast(c_nationkey as varchar), '{"n":' || cast(count(*) as varchar) || '}', cast('2024-02-01' as timestamp), cast('2024-02-01' as timestamp)
    from customer where c_nationkey >= 20 and c_nationkey % 2 = 0 group by c_nationkey""",
)
def snk3(spark, sf):
    """Versions by nation: 0-19 known, even ones come into use again, odd ones send empty cards."""
    per = b.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    version = F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("model_version")
    start = F.lit("2024-01-01").cast("timestamp")
    known = per.where("c_nationkey < 20").select(
        version, F.lit('{"old":1}').alias("card"), start.alias("first_used_at"), start.alias("last_used_at")
    )
    body = F.when(F.col("c_nationkey") % 2 == 0, F.format_string('{"n":%d}', "n")).otherwise(F.lit("{}"))
    return tb.register_model(known, per.select(version, body.alias("card")), "2024-02-01")


@query(
    "snk4_upsert_nodes",
    f"""select location_hash, case when i % 2 = 0 then location_name || ' new' else location_name end as location_name, state, {r('lat', 'lon')},
    case when i % 2 = 0 then 'grid' else kind end as kind, cast(case when i % 3 = 0 and i % 2 = 0 then '2024-02-01' else '2024-01-01' end as timestamp) as created_at
    from (select *, cast(substring(location_hash, 2) as bigint) as i from t_nodes) where not (i % 3 = 0 and i % 2 = 1)""",
)
def snk4(spark, sf):
    """Nodes not divisible by 3 are known; all even ones are written again, moved and renamed."""
    n = b.nodes(spark, sf).withColumn("i", F.substring("location_hash", 2, 20).cast("long"))
    known = n.where("i % 3 != 0").drop("i").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    rows = n.where("i % 2 = 0").withColumns({
        "location_name": F.concat("location_name", F.lit(" new")), "kind": F.lit("grid"),
        "lat": F.when(F.col("i") % 3 == 0, F.col("lat")).otherwise(F.col("lat") + 1),
    })
    return rounded(tb.upsert_nodes(known, rows, "2024-02-01"))


@query("snk5_backfill_write", f"select {KEYS}, {r('pm25')}, cast(day(timestamp) % 4 as int) as batch from t_obs")
def snk5(spark, sf):
    """Two batches are written, then the job starts again with all four (finished ones with other values)."""
    path = run_dir(spark, "backfill")
    rows = obs(spark, sf).select(*K, "pm25", (F.dayofmonth("timestamp") % 4).cast("int").alias("batch"))
    tb.backfill_write(spark, rows.where("batch < 2"), path)
    again = rows.withColumn("pm25", F.when(F.col("batch") < 2, F.lit(-1.0)).otherwise(F.col("pm25")))
    tb.backfill_write(spark, again, path)
    return rounded(tb.read_table(spark, path, rows.schema))


@query(
    "snk6_prune",
    f"select {KEYS}, {r('pm25')} from t_obs where timestamp >= (select t - interval 10 days from t_as_of)",
)
def snk6(spark, sf):
    path = run_dir(spark, "prune")
    rows = dated(obs(spark, sf).select(*K, "pm25"))
    tb.upsert(spark, path, rows, K, [], "obs_date")
    as_of = rows.agg(F.max("timestamp")).first()[0]
    tb.prune(spark, path, "timestamp", "obs_date", as_of, 10)
    return rounded(tb.read_table(spark, path, rows.schema).select(*K, "pm25"))


@query(
    "snk6_prune_counts",
    """select 'raw' as table_name, count(*) filter (timestamp < (select t - interval 10 days from t_as_of)) as dropped, count(*) filter (timestamp >= (select t - interval 10 days from t_as_of)) as kept from t_obs
    union all select 'aqi', count(*) filter (timestamp < (select t - interval 10 days from t_as_of)), count(*) filter (timestamp >= (select t - interval 10 days from t_as_of)) from t_aqi
    union all select 'forecasts', count(*) filter (forecast_generated_at < (select t - interval 5 days from t_as_of)), count(*) filter (forecast_generated_at >= (select t - interval 5 days from t_as_of)) from t_forecasts""",
)
def snk6_counts(spark, sf):
    from vayuspark.plans.aqi import refresh_aqi

    now, o = b.last_hour(spark, sf), obs(spark, sf)
    fc = b.forecasts(b.observations(spark, sf, "node8"))
    return (
        tb.prune_counts(o, "timestamp", now - cal.days(10), "raw")
        .unionByName(tb.prune_counts(refresh_aqi(o), "timestamp", now - cal.days(10), "aqi"))
        .unionByName(tb.prune_counts(fc, "forecast_generated_at", now - cal.days(5), "forecasts"))
    )


# ---- joins -------------------------------------------------------------------------------------

@query(
    "j1_join_weather_air",
    f"select {KEYS}, {r('a.temp_c as temp_c', 'c.pm25 as pm25')} from (select {KEYS}, temp_c from t_obs where hour(timestamp) % 3 != 0) a full join (select {KEYS}, pm25 from t_obs where hour(timestamp) % 4 != 0) c using (location_hash, timestamp)",
)
def j1(spark, sf):
    o = obs(spark, sf)
    wx, aq = o.where(F.hour("timestamp") % 3 != 0).select(*K, "temp_c"), o.where(F.hour("timestamp") % 4 != 0).select(*K, "pm25")
    return rounded(j.join_weather_air(wx, aq))


SERIES = "(select concat('u',cast(user_id as string)) as location_hash, cast(ts as timestamp) as timestamp, case when event_type = 'error' then 'no2' when event_type = 'click' then 'so2' when event_type = 'view' then 'co' else 'aod' end as variable, value from events)"


def series(spark, sf):
    kind = F.when(F.col("event_type") == "error", "no2").when(F.col("event_type") == "click", "so2").when(
        F.col("event_type") == "view", "co").otherwise("aod")
    return b.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("location_hash"),
        F.col("ts").cast("timestamp").alias("timestamp"), kind.alias("variable"), "value",
    )


@query("g1_hourly_median", f"select location_hash, variable, date_trunc('hour', timestamp) as timestamp, {r('median(value) as value')} from {SERIES} group by 1, 2, 3")
def g1(spark, sf):
    return rounded(j.hourly_median(series(spark, sf)))


@query(
    "j2_merge_satellite",
    f"select location_hash, date_trunc('hour', timestamp) as timestamp, {r(*[f'''median(value) filter (variable = '{v}') as {v}''' for v in SATELLITE])} from {SERIES} group by 1, 2",
)
def j2(spark, sf):
    return rounded(j.merge_satellite(j.hourly_median(series(spark, sf))))


@query("j3_with_nodes", f"select location_hash, timestamp, {r('pm25')}, location_name, state, {r('lat', 'lon')}, kind from t_obs join t_nodes using (location_hash)")
def j3(spark, sf):
    return rounded(j.with_nodes(obs(spark, sf).select(*K, "pm25"), b.nodes(spark, sf)))


HAV = "2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(c.lat-g.lat)/2),2) + cos(radians(g.lat))*cos(radians(c.lat))*pow(sin(radians(c.lon-g.lon)/2),2))))"
NEAREST = f"(select *, row_number() over (partition by location_hash order by km, city_order) as rk from (select g.location_hash, g.lat, g.lon, c.location_name as near, c.state, c.city_order, {HAV} as km from t_nodes g cross join {{c}} c where g.kind = 'grid'))"


@query("j4_nearest_city", f"select location_hash, {r('lat', 'lon')}, near, state, {r('km as km', digits=5)} from {NEAREST.format(c='t_supplier_cities')} where rk = 1")
def j4(spark, sf):
    grid = b.nodes(spark, sf).where("kind = 'grid'").select("location_hash", "lat", "lon")
    near = sp.nearest_city(grid, b.supplier_cities(spark, sf))
    return rounded(near.withColumn("km", F.round(F.col("km") + 1e-9, 5)))


@query("j4_nearest_listed_city", f"select location_hash, near, state, {r('km as km', digits=5)} from {NEAREST.format(c='t_cities')} where rk = 1")
def j4_listed(spark, sf):
    grid = b.nodes(spark, sf).where("kind = 'grid'").select("location_hash", "lat", "lon")
    near = sp.nearest_city(grid, nd.cities(spark))
    return near.select("location_hash", "near", "state", F.round(F.col("km") + 1e-9, 5).alias("km"))


@query("j5_drop_near", f"select location_hash, {r('km as km', digits=5)} from {NEAREST.format(c='t_supplier_cities')} where rk = 1 and km > 25")
def j5(spark, sf):
    grid = b.nodes(spark, sf).where("kind = 'grid'").select("location_hash", "lat", "lon")
    far = sp.drop_near(grid, b.supplier_cities(spark, sf))
    return far.select("location_hash", F.round(F.col("km") + 1e-9, 5).alias("km"))


@query(
    "j6_nearest_node",
    f"""select point_id, location_hash, {r('km as km', digits=5)} from (select *, row_number() over (partition by point_id order by km, location_hash) as rk from
    (select p.point_id, n.location_hash, 111.32*sqrt(pow(n.lat-p.lat,2)+pow((n.lon-p.lon)*cos(radians(p.lat)),2)) as km from t_points p cross join t_nodes n)) where rk = 1 and km <= 150""",
)
def j6(spark, sf):
    hit = sp.nearest_node(b.points(spark, sf), b.nodes(spark, sf))
    return hit.select("point_id", "location_hash", F.round(F.col("km") + 1e-9, 5).alias("km"))


@query(
    "j9_patch_columns",
    f"select {KEYS}, {r('case when hour(timestamp) % 2 = 0 then coalesce(o3, pm25) else pm25 end as pm25', 'case when hour(timestamp) % 2 = 0 then coalesce(pm10 + 1, pm10) else pm10 end as pm10', 'no2')} from t_obs",
)
def j9(spark, sf):
    o = obs(spark, sf)
    right = o.where(F.hour("timestamp") % 2 == 0).select(*K, F.col("o3").alias("pm25"), (F.col("pm10") + 1).alias("pm10"))
    return rounded(j.patch_columns(o.select(*K, "pm25", "pm10", "no2"), right, ["pm25", "pm10"]))


def region_edges(spark, sf):
    """Polygons from the supplier table: per nation a box with a square hole, boxes may overlap."""
    nations = b.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k")).select(
        F.col("s_nationkey").alias("polygon"),
        (F.lit(7.0) + (F.col("k") * 6151 % 2400) / 100).alias("y"), (F.lit(68.5) + (F.col("k") * 92821 % 2300) / 100).alias("x"),
    )
    corners = []
    for off, size in ((0.0, 4.0), (1.5, 1.0)):
        ring = [(off, off), (off + size, off), (off + size, off + size), (off, off + size), (off, off)]
        corners += [(*a, *c) for a, c in zip(ring, ring[1:])]
    edge = lambda e: F.struct(*[(F.col(ax) + F.lit(d)).alias(n) for ax, d, n in zip(("x", "y", "x", "y"), e, ("x1", "y1", "x2", "y2"))])
    return nations.select("polygon", F.explode(F.array(*[edge(e) for e in corners])).alias("e")).select("polygon", "e.*")


@query(
    "j11_clip_to_polygon",
    f"""with k as (select s_nationkey as polygon, min(s_suppkey) as k from supplier group by 1),
    x as (select polygon, 7.0 + (k*6151 % 2400)::double/100 as y, 68.5 + (k*92821 % 2300)::double/100 as x from k),
    g as (select a.lat, o.lon from (select round(6.75 + 0.5*i, 4)::double as lat from range(62) t(i)) a, (select round(68.25 + 0.5*i, 4)::double as lon from range(59) t(i)) o)
    select distinct {r('g.lat as lat', 'g.lon as lon')} from g join x on g.lon > x.x and g.lon < x.x + 4 and g.lat > x.y and g.lat < x.y + 4
      and not (g.lon >= x.x + 1.5 and g.lon <= x.x + 2.5 and g.lat >= x.y + 1.5 and g.lat <= x.y + 2.5)""",
)
def j11(spark, sf):
    grid = sp.lattice(spark.range(1).select(F.lit(1).alias("region")), 0.5).select("lat", "lon")
    return rounded(sp.clip_to_polygons(grid, region_edges(spark, sf)))


@query(
    "j12_known_long_series",
    "select location_hash, count(*) as n from t_obs8 where location_hash in (select location_hash from t_nodes8 where cast(substr(location_hash, 2) as int) % 3 <> 1) group by 1 having count(*) >= 169",
)
def j12(spark, sf):
    """Of the dense nodes a third is unknown."""
    known = b.nodes8(spark, sf).where("cast(substr(location_hash, 2) as int) % 3 <> 1")
    return j.known_long_series(b.observations(spark, sf, "node8"), known).groupBy("location_hash").agg(F.count(F.lit(1)).alias("n"))


CAND = "(select cast(o_custkey as varchar) as query, o_orderkey as rank, o_orderpriority as display_name, 2 + (o_orderkey*7919 % 4000)::double/100 as lat, 60 + (o_orderkey*104729 % 4500)::double/100 as lon from orders)"


@query(
    "j15_resolve_places",
    f"""with cand as (select *, lat between 6.0 and 37.5 and lon between 68.0 and 98.0 as ok from {CAND}), x as (
    select query, arg_min(display_name, rank) filter (ok) as display_name, arg_min(lat, rank) filter (ok) as lat, arg_min(lon, rank) filter (ok) as lon, count(*) as n from cand group by 1)
    select c_custkey::varchar as query, display_name, {r('lat', 'lon')}, case when lat is not null then 'ok' when n is not null then 'outside' else 'none found' end as status
    from customer left join x on x.query = c_custkey::varchar""",
)
def j15(spark, sf):
    o = b.table(spark, sf, "orders")
    cand = o.select(
        F.col("o_custkey").cast("string").alias("query"), F.col("o_orderkey").alias("rank"),
        F.col("o_orderpriority").alias("display_name"),
        (F.lit(2.0) + (F.col("o_orderkey") * 7919 % 4000) / 100).cast("string").alias("lat"),
        (F.lit(60.0) + (F.col("o_orderkey") * 104729 % 4500) / 100).cast("string").alias("lon"),
    )
    asked = b.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("query"))
    return rounded(j.resolve_places(asked, cand))


# ---- nodes -------------------------------------------------------------------------------------

HASH = "substring(md5(concat(cast(round(lat,3) as varchar), ',', cast(round(lon,3) as varchar))),1,8)"


@query(
    "u1_build_nodes",
    f"""with far as (select * from {NEAREST.format(c='t_supplier_cities')} where rk = 1 and km > 25),
    u as (select location_name, state, lat, lon, 'city' as kind, 0 as rank, city_order as ord from t_supplier_cities union all
      select distinct printf('Grid %.2fN %.2fE (near %s)', lat, lon, near), state, lat, lon, 'grid', 1, 0 from far),
    h as (select *, {HASH} as location_hash, row_number() over (partition by {HASH} order by rank, ord, lat, lon) as rn from u)
    select location_hash, location_name, state, {r('lat', 'lon')}, kind from h where rn = 1""",
)
def u1(spark, sf):
    grid = b.nodes(spark, sf).where("kind = 'grid'").select("lat", "lon").distinct()
    return rounded(nd.build_nodes(b.supplier_cities(spark, sf), grid))


@query("u2_concat_parts", f"select {KEYS}, {r('pm25')}, cast(null as double) as temp_c from t_obs union all select {KEYS}, null, {r('temp_c')} from t_obs")
def u2(spark, sf):
    o = obs(spark, sf)
    return rounded(j.concat_parts([o.select(*K, "pm25"), o.select(*K, "temp_c")]))


TEXTS = ["Customer#00000001", "  india ", "KENYA", "zzz", "", "9"]


@query(
    "s3_search_nodes",
    "with q as (select distinct lower(trim(x)) as q from (select unnest(['customer#00000001','india','kenya','zzz','9','a ']) as x union all select substr(c_name, 10 + c_custkey % 4, 3 + c_custkey % 5) from customer union all select n_name from nation) where trim(x) <> '') "
    "select * from (select q as query, location_hash, row_number() over (partition by q order by case when kind = 'city' then 0 else 1 end, location_name, location_hash) as place from t_nodes, q "
    "where contains(lower(location_name), q) or contains(lower(state), q)) where place <= 12",
)
def s3(spark, sf):
    """Texts of every customer's and nation's name, and a few of any length, as a table."""
    customers = b.table(spark, sf, "customer").select(F.substring(F.col("c_name"), (F.lit(10) + F.col("c_custkey") % 4).cast("int"), (F.lit(3) + F.col("c_custkey") % 5).cast("int")).alias("query"))
    few = spark.createDataFrame([(t,) for t in [*TEXTS, "a "]], "query string")
    texts = customers.unionByName(b.table(spark, sf, "nation").select(F.col("n_name").alias("query"))).unionByName(few)
    found = nd.search_nodes(b.nodes(spark, sf), texts)
    return found.select("query", "location_hash", F.col("place").cast("long"))


# ---- aggregates --------------------------------------------------------------------------------

@query("g2_aqi_daily", f"select date_trunc('day', timestamp)::timestamp as day, location_hash, {r('avg(aqi) as aqi_mean')}, max(aqi) as aqi_max, {r('avg(pm25_24h_avg) as pm25_mean')} from t_aqi group by 1, 2")
def g2(spark, sf):
    from vayuspark.plans.aqi import refresh_aqi

    return rounded(ag.aqi_daily(refresh_aqi(obs(spark, sf))))


@query("g14_holdout_metrics", f"select location_hash, count(*) as n, {r('sqrt(avg(pow(pm10-pm25,2))) as rmse', 'avg(abs(pm10-pm25)) as mae', '1-avg(pow(pm10-pm25,2))/nullif(var_pop(pm10),0) as r2', digits=5)} from t_obs group by 1")
def g14(spark, sf):
    return rounded(ag.holdout_metrics(obs(spark, sf), "pm10", "pm25", ["location_hash"]), 5)


@query("g16_watched", f"select {r('min(o3) as low', 'max(o3) as high', 'avg(o3) as mean', 'avg(case when o3 is not null then 1 else 0 end) as coverage')}, count(o3) as known from t_obs")
def g16(spark, sf):
    """Range and coverage of O3, observed while a grouped job over the same rows runs."""
    seen_df, seen = ag.watched(obs(spark, sf), "o3 report", "o3")
    per_node = seen_df.groupBy("location_hash").agg(F.count("o3").alias("n"))
    total = per_node.agg(F.sum("n")).first()[0]
    got = seen.get
    return rounded(spark.createDataFrame([(got["low"], got["high"], got["mean"], got["coverage"], total)], "low double, high double, mean double, coverage double, known long"))


@query("w13_keep_last", f"select {KEYS}, {r('case when hour(timestamp) % 2 = 0 then pm25 + 1 else pm25 end as pm25')}, cast(case when hour(timestamp) % 2 = 0 then 2 else 1 end as int) as ingested_at from t_obs")
def w13(spark, sf):
    first = obs(spark, sf).select(*K, "pm25", F.lit(1).alias("ingested_at"))
    again = first.where(F.hour("timestamp") % 2 == 0).withColumns({"pm25": F.col("pm25") + 1, "ingested_at": F.lit(2)})
    return rounded(w.keep_last(again.unionByName(first), K, ["ingested_at"]))


@query("g10_quantiles_by_type", f"select event_type, {r('quantile_cont(value, 0.1) as q10', 'quantile_cont(value, 0.5) as q50', 'quantile_cont(value, 0.9) as q90')} from events group by 1")
def quantiles(spark, sf):
    return rounded(exact_quantiles(b.table(spark, sf, "events"), ["event_type"], "value", [0.1, 0.5, 0.9], ["q10", "q50", "q90"]))
