"""Shared tables as SQL text for the oracle side (DuckDB), joined in by name."""

from __future__ import annotations

import re

from vayuspark.bridges import CITIES_SQL, NODES_SQL, NODES8_SQL, POINTS_SQL, obs_sql
from vayuspark.vocab import (
    AVERAGES, BREAKPOINTS, CATEGORIES, CITIES, FUTURE_FEATURES, INDEX_LEVELS, LABELS, PAST_FEATURES, POLLUTANTS,
    RAW, SUB_INDICES, TOP_CATEGORY, WINDOW_HOURS,
)


def sub_index_sql(c: str, pollutant: str) -> str:
    bp, idx = BREAKPOINTS[pollutant], INDEX_LEVELS
    arms = " ".join(
        f"when greatest({c},0) < {bp[i + 1]} then {idx[i]} + (greatest({c},0) - {bp[i]})::double * {idx[i + 1] - idx[i]}::double / {bp[i + 1] - bp[i]}::double"
        for i in range(6)
    )
    return f"(case when {c} is null then null when {c} >= {bp[6]} then {idx[6]}::double {arms} end)"


def category_sql(a: str) -> str:
    arms = " ".join(f"when {a} <= {u} then '{n}'" for u, n in CATEGORIES)
    return f"(case when {a} is null then null {arms} else '{TOP_CATEGORY}' end)"


def category_index_sql(a: str) -> str:
    arms = " ".join(f"when {a} <= {u} then {i}" for i, (u, _) in enumerate(CATEGORIES))
    return f"(case when {a} is null then null {arms} else {len(CATEGORIES)} end)"


def half_even_sql(x: str) -> str:
    return f"cast(round_even(round({x} + 1e-9,6),0) as int)"


def means_sql(table: str, frame: str = "range between interval {n} hours preceding and current row") -> str:
    cols = ", ".join(f"avg({p}) over w{WINDOW_HOURS[p]} as {AVERAGES[p]}" for p in POLLUTANTS)
    spec = "(partition by location_hash order by timestamp {})"
    return (
        f"select *, {cols} from {table} window w24 as {spec.format(frame.format(n=23))}, "
        f"w8 as {spec.format(frame.format(n=7))}"
    )


def aqi_sql(means: str, keep: str = "*") -> str:
    """AQI rows over a table that has the six averages."""
    subs = ", ".join(f"round({sub_index_sql(AVERAGES[p], p)} + 1e-9,6) as {SUB_INDICES[p]}" for p in POLLUTANTS)
    top = "greatest(" + ", ".join(SUB_INDICES.values()) + ")"
    who = "case " + " ".join(f"when {SUB_INDICES[p]} = top_ then '{LABELS[p]}'" for p in POLLUTANTS) + " end"
    return (
        f"select *, {category_sql('aqi')} as aqi_category from (select *, {half_even_sql('top_')} as aqi, "
        f"{who} as prominent_pollutant from (select *, {top} as top_ from (select *, {subs} from {means})) "
        "where top_ is not null)"
    )


FORECAST_SQL = """
select g.timestamp as forecast_generated_at, g.timestamp + to_hours(h.h) as forecast_target_time,
  g.location_hash, cast(h.h as int) as hours_ahead, p.pm25, p.pm10, p.no2, p.so2, p.co, p.o3,
  a.aqi, cast(greatest(a.aqi - 10, 0) as int) as aqi_lower, cast(a.aqi + 10 as int) as aqi_upper,
  a.aqi_category, a.prominent_pollutant, a0.aqi as aqi_huber, a.aqi as aqi_gbt, cast(null as int) as aqi_rf,
  'seasonal' as model_version
from t_obs8 g cross join (select unnest(range(1,25)) as h) h
join t_obs8 p on p.location_hash = g.location_hash and p.timestamp = g.timestamp + to_hours(h.h - 24)
join t_aqi8 a on a.location_hash = g.location_hash and a.timestamp = g.timestamp + to_hours(h.h - 24)
left join t_aqi8 a0 on a0.location_hash = g.location_hash and a0.timestamp = g.timestamp
where hour(g.timestamp) = 0
"""

LOGS = [f"log_{p}" for p in POLLUTANTS]
TWO_PI = "(2*pi())"


def _log(c: str) -> str:
    return f"case when {c} is not null then ln(1 + greatest({c}, 0)) end"


FEATURES_SQL = f"""
select location_hash, timestamp, t, n, {', '.join(f'{_log(c)} as log_{c}' for c in [*POLLUTANTS, 'dust'])}, aod, temp_c, humidity_pct,
  -wind_speed_ms*sin(radians(wind_dir_deg)) as wind_u, -wind_speed_ms*cos(radians(wind_dir_deg)) as wind_v, wind_speed_ms,
  {_log('precip_mm')} as precip_log, pressure_hpa, {_log('boundary_layer_m')} as blh_log, radiation_wm2,
  sin({TWO_PI}*hour(lt)/24) as hour_sin, cos({TWO_PI}*hour(lt)/24) as hour_cos, sin({TWO_PI}*(isodow(lt)-1)/7) as dow_sin, cos({TWO_PI}*(isodow(lt)-1)/7) as dow_cos,
  sin({TWO_PI}*dayofyear(lt)/365.25) as doy_sin, cos({TWO_PI}*dayofyear(lt)/365.25) as doy_cos, case when isodow(lt) >= 6 then 1.0 else 0.0 end::double as is_weekend,
  (lat-6.5)/31 as lat_norm, (lon-68)/29.5 as lon_norm
from (select f.*, f.timestamp + interval 330 minutes as lt, lat, lon, row_number() over w - 1 as t, count(*) over (partition by f.location_hash) as n
  from t_fill8 f join t_nodes8 using (location_hash) where f.location_hash in (select location_hash from t_obs8 group by 1 having count(*) >= 169)
  window w as (partition by f.location_hash order by f.timestamp))
"""


def _any_null(cols: list[str]) -> str:
    return "(" + " or ".join(f"{c} is null" for c in cols) + ")"


FRAME_SQL = f"""
select *, issue and t + 24 < n as valid_issue, issue and t + 24 < n and tgt = 0 as valid_sample from (select *, t >= 167 and past = 0 and fut = 0 as issue from (
select *, {', '.join(f'lag({c}, {k}) over w - {c} as d_lag{k}_{c[4:]}' for k in (1, 3, 6, 24) for c in LOGS)},
  {', '.join(f'avg({c}) over (partition by location_hash order by timestamp rows between {k - 1} preceding and current row) - {c} as d_roll{k}_{c[4:]}' for k in (24, 168) for c in LOGS)},
  {', '.join(f'lag({c}, 24) over w as yday_{c[4:]}' for c in LOGS)},
  count(*) filter ({_any_null(PAST_FEATURES)}) over (partition by location_hash order by timestamp rows between 167 preceding and current row) as past,
  count(*) filter ({_any_null(FUTURE_FEATURES)}) over (partition by location_hash order by timestamp rows between 1 following and 24 following) as fut,
  count(*) filter ({_any_null(LOGS)}) over (partition by location_hash order by timestamp rows between current row and 24 following) as tgt
from t_feat8 window w as (partition by location_hash order by timestamp)))
"""
ROWS_SQL = f"""
select s.location_hash, s.timestamp, cast(h.h as int) as horizon, x.timestamp as target, {', '.join(f's.log_{p} as last_{p}' for p in POLLUTANTS)},
  {', '.join(f'x.log_{p} - s.log_{p} as y_{p}' for p in POLLUTANTS)}, {', '.join(f'x.yday_{p} - s.log_{p} as d_yday_{p}' for p in POLLUTANTS)},
  {', '.join(f'x.{c} as fut_{c}' for c in FUTURE_FEATURES)}
from t_split8 s cross join (select unnest(range(1,25)) as h) h join t_frame8 x on x.location_hash = s.location_hash and x.timestamp = s.timestamp + to_hours(h.h)
where s.split = '{{split}}'
"""


def paths_sql(rows: str, samples: str, deltas: dict[str, str]) -> str:
    """Unrounded index per (sample, step, model) along observed and predicted hours, models as rows."""
    models = " union all ".join(
        f"select location_hash, timestamp, horizon as step, '{m}' as model, "
        + ", ".join(f"exp(greatest(last_{p} + {d.format(p=p)}, 0)) - 1 as {p}" for p in POLLUTANTS)
        + f" from {rows}" for m, d in deltas.items()
    )
    past = (
        "select s.location_hash, s.timestamp, cast(b.b as int) as step, m.model, "
        + ", ".join(f"exp(x.log_{p}) - 1 as {p}" for p in POLLUTANTS)
        + f" from {samples} s cross join (select unnest(range(-22,1)) as b) b cross join (select unnest({list(deltas)}) as model) m "
        "join t_frame8 x on x.location_hash = s.location_hash and x.timestamp = s.timestamp + to_hours(b.b)"
    )
    frame = "(partition by location_hash, timestamp, model order by step rows between {n} preceding and current row)"
    means = ", ".join(
        f"case when count({p}) over w{WINDOW_HOURS[p]} = {WINDOW_HOURS[p]} then avg({p}) over w{WINDOW_HOURS[p]} end as {AVERAGES[p]}" for p in POLLUTANTS
    )
    subs = ", ".join(f"round({sub_index_sql(AVERAGES[p], p)} + 1e-9,6) as {SUB_INDICES[p]}" for p in POLLUTANTS)
    who = "case " + " ".join(f"when {SUB_INDICES[p]} = raw then '{LABELS[p]}'" for p in POLLUTANTS) + " end"
    return (
        f"select *, {who} as prominent_pollutant from (select *, greatest({', '.join(SUB_INDICES.values())}) as raw from (select *, {subs} from (select *, {means} from "
        f"({models} union all {past}) window w24 as {frame.format(n=23)}, w8 as {frame.format(n=7)}) where step >= 1))"
    )


DELTAS = {"truth": "y_{p}", "persistence": "0.0", "seasonal_naive": "d_yday_{p}", "mean": "d_yday_{p}/2"}
LONG_RESIDUALS = " union all ".join(f"select horizon, '{p}' as pollutant, y_{p} - d_yday_{p}/2 as r from t_val8" for p in POLLUTANTS)

CTES: dict[str, str] = {
    "t_obs": obs_sql("user"),
    "t_obs8": obs_sql("node8"),
    "t_nodes": NODES_SQL,
    "t_nodes8": NODES8_SQL,
    "t_supplier_cities": CITIES_SQL,
    "t_points": POINTS_SQL,
    "t_cities": "select * from (values "
    + ", ".join(f"({i}, '{n}', '{s}', {la}::double, {lo}::double)" for i, (n, s, la, lo) in enumerate(CITIES))
    + ") t(city_order, location_name, state, lat, lon)",
    "t_means": means_sql("t_obs"),
    "t_means8": means_sql("t_obs8"),
    "t_aqi": aqi_sql("t_means"),
    "t_aqi8": aqi_sql("t_means8"),
    "t_forecasts": FORECAST_SQL,
    "t_as_of": "select date_trunc('hour', max(cast(ts as timestamp))) as t from events",
    "t_span8": "select location_hash, min(timestamp) as first_hour, max(timestamp) as last_hour from t_obs8 group by 1",
    "t_axis8": "select location_hash, unnest(generate_series(first_hour, last_hour, interval 1 hour)) as timestamp from t_span8",
    "t_fill8": "select location_hash, timestamp, "
    + ", ".join(f"last_value({c} ignore nulls) over (partition by location_hash order by timestamp rows between 3 preceding and current row) as {c}" for c in RAW)
    + " from t_spine8",
    "t_feat8": FEATURES_SQL,
    "t_frame8": FRAME_SQL,
    "t_split8": "select *, case when timestamp >= m - interval 5 days then 'test' when timestamp >= m - interval 9 days and timestamp < m - interval 6 days then 'val' "
    "when timestamp < m - interval 10 days then 'train' end as split from (select *, max(timestamp) over () as m from t_frame8 where valid_sample)",
    "t_train8": ROWS_SQL.format(split="train"),
    "t_val8": ROWS_SQL.format(split="val"),
    "t_test8": ROWS_SQL.format(split="test"),
    "t_quant8": f"select horizon, pollutant, quantile_cont(r, 0.1) as q10, quantile_cont(r, 0.9) as q90 from ({LONG_RESIDUALS}) group by 1, 2",
    "t_paths8": paths_sql("t_test8", "(select * from t_split8 where split = 'test')", DELTAS),
    "t_spine8": "select a.location_hash, a.timestamp, o.* exclude (location_hash, timestamp) from t_axis8 a left join t_obs8 o using (location_hash, timestamp)",
}


def build(body: str) -> str:
    """Put the tables a text names in front of it, in dependency order."""
    done: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"\b[a-z_0-9]+\b", text):
            if word in CTES and word not in done:
                need(CTES[word])
                if word not in done:
                    done.append(word)

    need(body)
    if not done:
        return body
    heads = ", ".join(f"{n} as ({CTES[n]})" for n in done)
    stripped = body.strip()
    if stripped.lower().startswith("with "):
        return f"with {heads}, {stripped[5:]}"
    return f"with {heads} {stripped}"
