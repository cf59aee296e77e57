"""Index, trailing means, fills, spine."""

from __future__ import annotations

from pyspark.sql import functions as F

from vayuspark import bridges as b
from vayuspark.catalog.base import query, r, rounded
from vayuspark.catalog.ctes import means_sql
from vayuspark.functions.calendar import days
from vayuspark.operators import windows as w
from vayuspark.plans.aqi import refresh_aqi
from vayuspark.vocab import AVERAGES, POLLUTANTS, RAW, SUB_INDICES

AVG, SUB = list(AVERAGES.values()), list(SUB_INDICES.values())
KEYS = "location_hash, timestamp"


@query("m20_refresh_aqi", f"select {KEYS}, {r(*AVG)}, {r(*SUB)}, aqi, prominent_pollutant, aqi_category from t_aqi")
def m20(spark, sf):
    return rounded(refresh_aqi(b.observations(spark, sf)))


@query(
    "m20_refresh_aqi_since",
    f"""select {KEYS}, {r(*AVG)}, {r(*SUB)}, aqi, prominent_pollutant, aqi_category from t_aqi
    where timestamp >= (select t - interval 8 days from t_as_of)""",
)
def m20_since(spark, sf):
    since = b.last_hour(spark, sf) - days(8)
    return rounded(refresh_aqi(b.observations(spark, sf), since))


@query("w1_trailing_means", f"select {KEYS}, {r(*AVG)} from t_means")
def w1(spark, sf):
    obs = b.observations(spark, sf).select("location_hash", "timestamp", *POLLUTANTS)
    return rounded(w.trailing_means(obs).select("location_hash", "timestamp", *AVG))


@query(
    "w2_trailing_means_rows",
    f"select {KEYS}, {r(*AVG)} from ({means_sql('t_spine8', 'rows between {n} preceding and current row')})",
)
def w2(spark, sf):
    obs = b.observations(spark, sf, "node8").select("location_hash", "timestamp", *POLLUTANTS)
    return rounded(w.trailing_means_rows(w.hourly_spine(obs)).select("location_hash", "timestamp", *AVG))


@query("j13_hourly_spine", f"select {KEYS}, {r(*RAW)} from t_spine8")
def j13(spark, sf):
    return rounded(w.hourly_spine(b.observations(spark, sf, "node8"))).select("location_hash", "timestamp", *RAW)


FILLS = ["pm25", "no2", "o3", "temp_c"]
GAPS = "(select location_hash, timestamp, case when hour(timestamp) in (3,4,5,6,7) then null else pm25 end as pm25, no2, o3, temp_c from t_spine8)"
GAPS_USER = "(select location_hash, timestamp, case when hour(timestamp) in (3,4,5,6,7) then null else pm25 end as pm25, no2, o3, temp_c from t_obs)"


def gappy(df):
    pm25 = F.when(~F.hour("timestamp").isin(3, 4, 5, 6, 7), F.col("pm25")).alias("pm25")
    return df.select("location_hash", "timestamp", pm25, "no2", "o3", "temp_c")


def filled_sql(table: str, forward: int, backward: int) -> str:
    f = ", ".join(
        f"last_value({c} ignore nulls) over (partition by location_hash order by timestamp rows between {forward} preceding and current row) as {c}"
        for c in FILLS
    )
    g = ", ".join(
        f"first_value({c} ignore nulls) over (partition by location_hash order by timestamp rows between current row and {backward} following) as {c}"
        for c in FILLS
    )
    return f"select {KEYS}, {g} from (select {KEYS}, {f} from {table})"


@query("w4_ffill", f"select {KEYS}, {r(*FILLS)} from ({filled_sql(GAPS_USER, 3, 0)})")
def w4(spark, sf):
    return rounded(w.ffill(gappy(b.observations(spark, sf)), FILLS))


@query("w4_ffill_spine", f"select {KEYS}, {r(*FILLS)} from ({filled_sql(GAPS, 3, 0)})")
def w4_spine(spark, sf):
    return rounded(w.ffill(gappy(w.hourly_spine(b.observations(spark, sf, "node8"))), FILLS, hourly=True))


@query("w5_bfill", f"select {KEYS}, {r(*FILLS)} from ({filled_sql(GAPS, 3, 3)})")
def w5(spark, sf):
    gaps = gappy(w.hourly_spine(b.observations(spark, sf, "node8")))
    return rounded(w.fill(gaps, FILLS, forward=3, backward=3, hourly=True))


@query(
    "w6_interpolate_time",
    f"""with x as (select *, row_number() over n as rn from {GAPS} window n as (partition by location_hash order by timestamp)),
    y as (select *, last_value(case when pm25 is not null then timestamp end ignore nulls) over p as t0,
        last_value(pm25 ignore nulls) over p as v0,
        last_value(case when pm25 is not null then rn end ignore nulls) over p as r0,
        first_value(case when pm25 is not null then timestamp end ignore nulls) over f as t1,
        first_value(pm25 ignore nulls) over f as v1
      from x window p as (partition by location_hash order by timestamp rows between unbounded preceding and current row),
        f as (partition by location_hash order by timestamp rows between current row and unbounded following))
    select {KEYS}, {r('''case when pm25 is not null then pm25 when rn - r0 > 3 or v0 is null then null when v1 is null then v0
        else v0 + (v1 - v0) * (epoch(timestamp) - epoch(t0)) / (epoch(t1) - epoch(t0)) end as pm25''')} from y""",
)
def w6(spark, sf):
    gaps = gappy(w.hourly_spine(b.observations(spark, sf, "node8"))).select("location_hash", "timestamp", "pm25")
    return rounded(w.interpolate_time(gaps, ["pm25"]))
