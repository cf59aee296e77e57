"""Features, samples, candidates, scores and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vayuspark import bridges as b
from vayuspark.catalog.base import query, r, rounded
from vayuspark.catalog.ctes import category_index_sql, category_sql, half_even_sql, paths_sql
from vayuspark.functions import calendar as cal
from vayuspark.operators import evaluate as ev, features as ft
from vayuspark.operators.blocks import BLOCK
from vayuspark.plans.forecast import forecast_all
from vayuspark.session import cut_lineage
from vayuspark.vocab import FUTURE_FEATURES, PAST_FEATURES, POLLUTANTS, TABULAR_FEATURES

K = ["location_hash", "timestamp"]
KEYS = "location_hash, timestamp"
VAL_DAYS, TEST_DAYS = 4, 5          # the given events span 30 days
NAMES = ["persistence", "seasonal_naive", "mean"]


def frame(spark, sf):
    return ft.hour_frame(b.observations(spark, sf, "node8"), b.nodes8(spark, sf))


def stored_frame(spark, sf):
    """The hour frame is read several times by what follows, so it is written once."""
    return cut_lineage(frame(spark, sf), "frame")


def split(fr, part):
    return ft.chronological_splits(ft.sample_index(fr), VAL_DAYS, TEST_DAYS).where(F.col("split") == part)


def with_mean(rows):
    return ev.with_baselines(rows).withColumns({f"mean_{p}": F.col(f"d_yday_{p}") / 2 for p in POLLUTANTS})


def candidates(fr, part):
    samples = split(fr, part)
    return samples, with_mean(ft.horizon_rows(ft.all_horizons(samples), fr))


def paths(spark, sf):
    fr = stored_frame(spark, sf)
    _, rows = candidates(fr, "test")
    return ev.scored_paths(rows, NAMES)


# ---- features ----------------------------------------------------------------------------------

@query("m1_engineer_features", f"select {KEYS}, t, {r(*PAST_FEATURES)} from t_feat8")
def m1(spark, sf):
    return rounded(ft.engineer_features(b.observations(spark, sf, "node8"), b.nodes8(spark, sf)))


@query("w7_lag_deltas", f"select {KEYS}, {r(*ft.LAG_COLUMNS)} from t_frame8")
def w7(spark, sf):
    return rounded(frame(spark, sf).select(*K, *ft.LAG_COLUMNS))


@query("w8_rolling_deltas", f"select {KEYS}, {r(*ft.ROLL_COLUMNS)} from t_frame8")
def w8(spark, sf):
    return rounded(frame(spark, sf).select(*K, *ft.ROLL_COLUMNS))


@query("w10_valid_issue", f"select {KEYS}, t, valid_issue, valid_sample from t_frame8")
def w10(spark, sf):
    return frame(spark, sf).select(*K, "t", "valid_issue", "valid_sample")


@query("w14_sample_index", f"select {KEYS}, t from t_frame8 where valid_sample and t % 6 = 0 and timestamp >= '2024-01-10' and timestamp < '2024-01-25'")
def w14(spark, sf):
    return ft.sample_index(frame(spark, sf), 6, "2024-01-10", "2024-01-25")


@query("m2_chronological_splits", f"select {KEYS}, t, split from t_split8")
def m2(spark, sf):
    return ft.chronological_splits(ft.sample_index(frame(spark, sf)), VAL_DAYS, TEST_DAYS)


Y = [f"y_{p}" for p in POLLUTANTS]
D = [f"d_yday_{p}" for p in POLLUTANTS]


@query("w11_horizon_rows", f"select {KEYS}, horizon, target, {r(*[f'last_{p}' for p in POLLUTANTS])}, {r(*Y)}, {r(*[f'fut_{c}' for c in FUTURE_FEATURES])} from t_test8")
def w11(spark, sf):
    fr = stored_frame(spark, sf)
    return rounded(ft.horizon_rows(ft.all_horizons(split(fr, "test")), fr).drop(*D, *ft.SEEN, BLOCK))


@query("w9_seasonal_delta", f"select {KEYS}, horizon, {r(*D)} from t_test8")
def w9(spark, sf):
    fr = stored_frame(spark, sf)
    return rounded(ft.horizon_rows(ft.all_horizons(split(fr, "test")), fr).select(*K, "horizon", *D))


SPEC_SQL = " union all ".join(
    [f"select 'past' as part, '{c}' as feature, avg({c}) as mean, stddev_pop({c}) as std from t_split8 where split = 'train'" for c in PAST_FEATURES]
    + [f"select 'future', '{c}', avg(fut_{c}), stddev_pop(fut_{c}) from t_train8 where horizon = 1" for c in FUTURE_FEATURES]
)
STD = "case when std < 1e-6 or std is null then 1 else std end"


@query("g8_fit_scaler", f"select part, feature, {r('mean', STD + ' as std', digits=5)} from ({SPEC_SQL})")
def g8(spark, sf):
    fr = stored_frame(spark, sf)
    return rounded(ft.fit_scaler(split(fr, "train"), fr), 5)


def tstd_sql(rows):
    return " union all ".join(f"select horizon, '{p}' as pollutant, stddev_pop(y_{p}) as std from {rows} group by 1" for p in POLLUTANTS)


@query("g9_target_std", f"select horizon, pollutant, {r(STD + ' as std')} from ({tstd_sql('t_train8')})")
def g9(spark, sf):
    fr = stored_frame(spark, sf)
    return rounded(ft.target_std(ft.horizon_rows(ft.all_horizons(split(fr, "train")), fr)))


_TAB = {c: f"s.{c}" for c in [*PAST_FEATURES, *ft.LAG_COLUMNS, *ft.ROLL_COLUMNS]}
_TAB |= {f"d_yday_{p}": f"x.yday_{p} - s.log_{p}" for p in POLLUTANTS} | {f"fut_{c}": f"x.{c}" for c in FUTURE_FEATURES} | {"horizon": "h.h"}
TABULAR_SQL = f"""(select s.location_hash, s.timestamp, cast(h.h as int) as lead, {', '.join(f'{_TAB[c]} as {c}' for c in TABULAR_FEATURES)}, {', '.join(f'x.log_{p} - s.log_{p} as y_{p}' for p in POLLUTANTS)}
  from t_split8 s cross join (select unnest(range(1,25)) as h) h join t_frame8 x on x.location_hash = s.location_hash and x.timestamp = s.timestamp + to_hours(h.h) where split = 'val')"""


@query("m4_tabular_features", f"select {KEYS}, lead, {r(*TABULAR_FEATURES)}, {r(*Y)} from {TABULAR_SQL}")
def m4(spark, sf):
    fr = stored_frame(spark, sf)
    tab = ft.tabular_features(ft.all_horizons(split(fr, "val")), fr)
    return rounded(tab.drop(*[f"last_{p}" for p in POLLUTANTS], *ft.SEEN, BLOCK))


@query(
    "f16_standardise",
    f"""with spec as ({SPEC_SQL}), m as (select {', '.join(f"max(mean) filter (part = 'past' and feature = '{c}') as m_{c}, max({STD}) filter (part = 'past' and feature = '{c}') as s_{c}" for c in PAST_FEATURES)} from spec)
    select {KEYS}, {r(*[f'coalesce(({c} - m_{c}) / s_{c}, 0) as {c}' for c in PAST_FEATURES], digits=5)} from t_frame8, m""",
)
def f16(spark, sf):
    fr = stored_frame(spark, sf)
    spec = ft.fit_scaler(split(fr, "train"), fr)
    return rounded(ft.standardise_frame(fr, spec).select(*K, *PAST_FEATURES), 5)


_SUM = " + ".join(f"coalesce(x.{c}, 0)" for c in PAST_FEATURES)
_PLACED = " + ".join(f"(((b.b + 167) % 4) * {len(PAST_FEATURES)} + {i}) * coalesce(x.{c}, 0)" for i, c in enumerate(PAST_FEATURES, 1))


@query(
    "w15_past_matrix",
    f"""select s.location_hash, s.timestamp, cast((b.b + 167) // 4 as int) as patch, cast(count(*) * {len(PAST_FEATURES)} as int) as values, {r(f'sum({_SUM}) as total', f'sum({_PLACED}) as by_place', digits=5)}
    from t_split8 s cross join (select unnest(range(-167,1)) as b) b join t_frame8 x on x.location_hash = s.location_hash and x.timestamp = s.timestamp + to_hours(b.b)
    where split = 'test' group by 1, 2, 3""",
)
def w15(spark, sf):
    """All 42 patches of the windows of the test samples: size, sum, and sum of each value times its place."""
    fr = stored_frame(spark, sf)
    m = ft.past_matrix(split(fr, "test"), fr, patch=4).select(*K, F.posexplode("past").alias("patch", "x"))
    known = F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return rounded(m.select(*K, "patch", F.size("x").alias("values"), total(known).alias("total"), total(F.transform(known, lambda v, i: v * (i + 1))).alias("by_place")), 5)


@query(
    "w16_history_conc",
    f"select s.location_hash, s.timestamp, cast(b.b as int) as step, {r(*[f'exp(x.log_{p})-1 as {p}' for p in POLLUTANTS])} from t_split8 s cross join (select unnest(range(-22,1)) as b) b "
    "join t_frame8 x on x.location_hash = s.location_hash and x.timestamp = s.timestamp + to_hours(b.b) where split = 'test'",
)
def w16(spark, sf):
    fr = stored_frame(spark, sf)
    return rounded(ft.history_conc(split(fr, "test"), fr))


def draw_sql(*parts):
    """The number that `_draw` makes of some texts."""
    return f"cast('0x' || substr(md5({' || $$|$$ || '.join(parts)}), 1, 15) as bigint)"


_TIME_TEXT = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')"


@query("m3_subsample", f"select {KEYS}, {r('pm25')} from t_obs order by {draw_sql('location_hash', _TIME_TEXT, '$$3$$')}, location_hash, timestamp limit 1000")
def m3(spark, sf):
    return rounded(ft.subsample(b.observations(spark, sf).select(*K, "pm25"), K, 1000, seed=3))


@query(
    "m5_random_horizons",
    f"select {KEYS}, cast(i as int) as draw, cast({draw_sql('location_hash', _TIME_TEXT, 'cast(i as varchar)', '$$1$$')} % 24 + 1 as int) as horizon from t_split8 cross join (select unnest(range(6)) as i) where split = 'train'",
)
def m5(spark, sf):
    """The lead times of six draws for each training sample."""
    draws = ft.random_horizons(split(frame(spark, sf), "train"), 6, seed=1)
    return draws.select(*K, F.posexplode("leads").alias("draw", "horizon"))


# ---- candidates and scores ---------------------------------------------------------------------

@query("m10_baselines", f"select {KEYS}, horizon, {r(*[f'0 as persistence_{p}' for p in POLLUTANTS], *[f'd_yday_{p} as seasonal_naive_{p}' for p in POLLUTANTS])} from t_test8")
def m10(spark, sf):
    fr = stored_frame(spark, sf)
    _, rows = candidates(fr, "test")
    return rounded(rows.select(*K, "horizon", *[f"{n}_{p}" for n in ev.BASELINES for p in POLLUTANTS]))


@query("w3_aqi_along_path", f"select {KEYS}, step, model, {r('raw', digits=4)}, {half_even_sql('raw')} as aqi, prominent_pollutant from t_paths8")
def w3(spark, sf):
    each = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(f"{n}_raw").alias("raw"), F.col(f"{n}_prominent").alias("prominent_pollutant")) for n in ["truth", *NAMES]
    ]))
    long = paths(spark, sf).select(*K, "step", each.alias("x")).select(*K, "step", "x.*")
    return rounded(long.withColumn("aqi", ev.half_even(F.col("raw"))), 4)


WIDE = "(select p.location_hash, p.timestamp, p.step, p.model, p.raw as pred, q.raw as truth, " + ", ".join(f"p.{p} as {p}, q.{p} as true_{p}" for p in POLLUTANTS) + " from t_paths8 p join t_paths8 q using (location_hash, timestamp, step) where p.model != 'truth' and q.model = 'truth')"
MODEL_SQL = f"""(select model, avg(abs(pred-truth)) as aqi_mae, sqrt(avg(pow(pred-truth,2))) as aqi_rmse, avg(pred-truth) as aqi_bias,
  avg(case when {category_index_sql(half_even_sql('pred'))} = {category_index_sql(half_even_sql('truth'))} then 1 else 0 end) as category_accuracy,
  avg(case when abs(pred-truth) <= 20 then 1 else 0 end) as within_20 from {WIDE} group by 1)"""


@query("g11_score_models", f"select model, {r('aqi_mae', 'aqi_rmse', 'aqi_bias', 'category_accuracy', 'within_20', '1 - aqi_mae / max(case when model = $$persistence$$ then aqi_mae end) over () as skill', digits=4)} from {MODEL_SQL}")
def g11(spark, sf):
    return rounded(ev.score_models(paths(spark, sf), NAMES), 4)


@query("g11_score_horizons", f"select model, step, {r('avg(abs(pred-truth)) as aqi_mae', digits=2)} from {WIDE} group by 1, 2")
def g11h(spark, sf):
    return ev.score_horizons(paths(spark, sf), NAMES)


POLL_SQL = " union all ".join(f"select model, '{p}' as pollutant, avg(abs({p}-true_{p})) as mae, sqrt(avg(pow({p}-true_{p},2))) as rmse from {WIDE} group by 1" for p in POLLUTANTS)


@query("g11_score_pollutants", f"select model, pollutant, {r('mae', 'rmse', '1 - mae / max(case when model = $$persistence$$ then mae end) over (partition by pollutant) as skill', digits=5)} from ({POLL_SQL})")
def g11p(spark, sf):
    return rounded(ev.score_pollutants(paths(spark, sf), NAMES), 5)


@query("s5_best_model", f"select model, {r('aqi_mae', digits=4)} from {MODEL_SQL} where model != 'persistence' order by aqi_mae limit 1")
def s5(spark, sf):
    return rounded(ev.best_model(ev.score_models(paths(spark, sf), NAMES), NAMES[1:]), 4)


RANKS = f"""with e as (select location_hash, timestamp, avg(abs(pred-truth)) filter (model = 'mean') as a, avg(abs(pred-truth)) filter (model = 'persistence') as b from {WIDE} group by 1, 2),
  d as (select a - b as d, round(abs(a - b), 9) as size from e), k as (select d, size, rank() over (order by size) + (count(*) over (partition by size) - 1) / 2.0 as rk, count(*) over (partition by size) as c from d where size > 0),
  s as (select count(*) as n, sum(rk) filter (d > 0) as w_plus, sum(c*c - 1.0) as ties from k)
  select n, {r('w_plus', '(w_plus - n*(n+1)/4.0) / sqrt(n*(n+1)*(2*n+1)/24.0 - ties/48.0) as z')} from s"""


@query("g13_wilcoxon_less", RANKS)
def g13(spark, sf):
    errors = ev.sample_errors(paths(spark, sf), NAMES)
    return rounded(ev.wilcoxon_less(errors, "mean", "persistence").drop("p_value"))


_FIT = "-1.26551223 + t*(1.00002368 + t*(0.37409196 + t*(0.09678418 + t*(-0.18628806 + t*(0.27886807 + t*(-1.13520398 + t*(1.48851587 + t*(-0.82215223 + t*0.17087277))))))))"


@query(
    "g13_wilcoxon_p_value",
    f"""with q as ({RANKS}), x as (select *, abs(z)/sqrt(2) as x, 1/(1 + abs(z)/sqrt(2)/2) as t from q), p as (select *, t*exp(-x*x + {_FIT})/2 as tail from x)
    select n, {r('case when z <= 0 then ln(tail) else ln(1 - tail) end as log_p', digits=3)} from p""",
)
def g13p(spark, sf):
    test = ev.wilcoxon_less(ev.sample_errors(paths(spark, sf), NAMES), "mean", "persistence")
    return rounded(test.select("n", F.log("p_value").alias("log_p")), 3)


@query("g10_residual_quantiles", f"select horizon, pollutant, {r('q10', 'q90')} from t_quant8")
def g10(spark, sf):
    _, rows = candidates(stored_frame(spark, sf), "val")
    return rounded(ev.residual_quantiles(rows, "mean"))


QJOIN = " ".join(f"join t_quant8 q_{p} on q_{p}.horizon = x.horizon and q_{p}.pollutant = '{p}'" for p in POLLUTANTS)
WITHQ = "(select x.*, " + ", ".join(f"q_{p}.q10 as lo_{p}, q_{p}.q90 as hi_{p}" for p in POLLUTANTS) + f" from t_test8 x {QJOIN})"


@query("m11_conformal_interval", f"select {KEYS}, horizon, {r(*[f'd_yday_{p}/2 + lo_{p} as lower_{p}' for p in POLLUTANTS], *[f'd_yday_{p}/2 + hi_{p} as upper_{p}' for p in POLLUTANTS])} from {WITHQ}")
def m11(spark, sf):
    fr = stored_frame(spark, sf)
    q = ev.residual_quantiles(candidates(fr, "val")[1], "mean")
    _, rows = candidates(fr, "test")
    return rounded(ev.with_interval(rows, q, "mean").select(*K, "horizon", *[f"{e}_{p}" for e in ("lower", "upper") for p in POLLUTANTS]))


COVER = paths_sql(WITHQ, "(select * from t_split8 where split = 'test')", {"truth": "y_{p}", "lower": "d_yday_{p}/2 + lo_{p}", "upper": "d_yday_{p}/2 + hi_{p}"})


@query("g12_interval_coverage", f"select count(*) as n, {r('avg(case when t.raw between l.raw and u.raw then 1 else 0 end) as coverage')} from ({COVER}) t join ({COVER}) l using (location_hash, timestamp, step) join ({COVER}) u using (location_hash, timestamp, step) where t.model = 'truth' and l.model = 'lower' and u.model = 'upper'")
def g12(spark, sf):
    fr = stored_frame(spark, sf)
    q = ev.residual_quantiles(candidates(fr, "val")[1], "mean")
    _, rows = candidates(fr, "test")
    return rounded(ev.interval_coverage(ev.scored_paths(ev.with_interval(rows, q, "mean"), ["lower", "upper"])))


GRID = ev.simplex(3)
SEARCH_SQL = f"""with g as (select unnest(range({len(GRID)})) as i, unnest({[w[0] for w in GRID]}::double[]) as a, unnest({[w[1] for w in GRID]}::double[]) as b, unnest({[w[2] for w in GRID]}::double[]) as c),
  e as ({' union all '.join(f"select '{p}' as pollutant, i, a, b, c, avg(abs(b*d_yday_{p} + c*d_yday_{p}/2 - y_{p})) as mae from g cross join t_val8 group by all" for p in POLLUTANTS)}),
  w as (select *, row_number() over (partition by pollutant order by round(mae, 9), i) as rk from e)
  select pollutant, unnest(['persistence','seasonal_naive','mean']) as member, round(unnest([a, b, c]) + 1e-9, 6) as weight, {r('mae')} from w where rk = 1"""


@query("m8_search_weights", SEARCH_SQL)
def m8(spark, sf):
    _, rows = candidates(stored_frame(spark, sf), "val")
    return rounded(ev.search_weights(rows, NAMES))


GIVEN = {"persistence": 0.5, "seasonal_naive": 0.3, "mean": 0.2}


def given_weights(spark):
    return spark.createDataFrame([(p, m, w) for p in POLLUTANTS for m, w in GIVEN.items()], "pollutant string, member string, weight double")


@query("m9_blend", f"select {KEYS}, horizon, {r(*[f'd_yday_{p}*0.4 as ensemble_{p}' for p in POLLUTANTS], *[f'd_yday_{p}*(0.3+0.2/2)/0.5 as pair_{p}' for p in POLLUTANTS])} from t_test8")
def m9(spark, sf):
    """All three members, and only the last two with their weights scaled up."""
    _, rows = candidates(stored_frame(spark, sf), "test")
    both = ev.blend(ev.blend(rows, given_weights(spark), NAMES), given_weights(spark), NAMES[1:], "pair")
    return rounded(both.select(*K, "horizon", *[f"{n}_{p}" for n in ("ensemble", "pair") for p in POLLUTANTS]))


ISSUE = "(select t - interval 30 hours from t_as_of)"
ISSUE_ROWS = f"""(select s.location_hash, s.timestamp, cast(h.h as int) as horizon, {', '.join(f's.log_{p} as last_{p}' for p in POLLUTANTS)}, {', '.join(f'x.yday_{p} - s.log_{p} as d_yday_{p}' for p in POLLUTANTS)},
  {', '.join(f'q_{p}.q10 as lo_{p}, q_{p}.q90 as hi_{p}' for p in POLLUTANTS)}
  from (select * from t_frame8 where valid_issue and timestamp = {ISSUE}) s cross join (select unnest(range(1,25)) as h) h join t_frame8 x on x.location_hash = s.location_hash and x.timestamp = s.timestamp + to_hours(h.h)
  {' '.join(f"join t_quant8 q_{p} on q_{p}.horizon = h.h and q_{p}.pollutant = '{p}'" for p in POLLUTANTS)})"""
ISSUE_PATHS = paths_sql(
    ISSUE_ROWS, f"(select * from t_frame8 where valid_issue and timestamp = {ISSUE})",
    {"ensemble": "d_yday_{p}*0.4", "persistence": "0.0", "seasonal_naive": "d_yday_{p}", "mean": "d_yday_{p}/2", "lower": "d_yday_{p}*0.4 + lo_{p}", "upper": "d_yday_{p}*0.4 + hi_{p}"},
)


@query(
    "m12_forecast_all",
    f"""with z as (select *, {half_even_sql('raw')} as a from ({ISSUE_PATHS}))
    select timestamp as forecast_generated_at, timestamp + to_hours(step) as forecast_target_time, location_hash, step as hours_ahead,
      {r(*[f"max({p}) filter (model = 'ensemble') as {p}" for p in POLLUTANTS], digits=5)}, max(a) filter (model = 'ensemble') as aqi, max(a) filter (model = 'lower') as aqi_lower, max(a) filter (model = 'upper') as aqi_upper,
      {category_sql("max(a) filter (model = 'ensemble')")} as aqi_category, max(prominent_pollutant) filter (model = 'ensemble') as prominent_pollutant,
      {', '.join(f"max(a) filter (model = '{m}') as aqi_{m}" for m in NAMES)}, 'baselines' as model_version from z group by 1, 2, 3, 4""",
)
def m12(spark, sf):
    fr = stored_frame(spark, sf)
    q = ev.residual_quantiles(candidates(fr, "val")[1], "mean")
    predict = lambda leads, f: with_mean(ft.horizon_rows(leads, f))
    as_of = b.last_hour(spark, sf) - cal.hours(30)
    return rounded(forecast_all(fr, as_of, predict, NAMES, given_weights(spark), q, "baselines"), 5)


@query(
    "m15_promote",
    f"""with c as (select max(aqi_mae) filter (model = 'mean') as candidate, max(aqi_mae) filter (model = 'persistence') as champion from {MODEL_SQL})
    select {r('candidate', 'champion', digits=4)}, candidate <= champion * 1.02 as promote from c""",
)
def m15(spark, sf):
    """The mean of both baselines against persistence as the deployed forecast."""
    scores = ev.score_models(paths(spark, sf), NAMES)
    champion = scores.where("model = 'persistence'").withColumn("model", F.lit("mean"))
    return rounded(ev.promote(scores, champion, "mean"), 4)
