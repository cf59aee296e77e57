import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, nodes2, raw_frame, to_spark
from vayuspark.operators import evaluate as ev, features as ft
from vayuspark.plans.forecast import forecast_all
from vayuspark.session import cut_lineage
from vayuspark.vocab import FUTURE_FEATURES, HORIZON, LOOKBACK, MEMBERS, PAST_FEATURES, POLLUTANTS, TABULAR_FEATURES

K = ["location_hash", "timestamp"]


@pytest.fixture(scope="module")
def frame(spark):
    return cut_lineage(ft.hour_frame(to_spark(spark, raw_frame()), nodes2(spark)))


def numpy_valid(pdf):
    """Straight check of one node's windows on filled values."""
    n = len(pdf)
    ok = pdf[PAST_FEATURES].notna().all(axis=1).to_numpy()
    return [t >= LOOKBACK - 1 and t + HORIZON < n and ok[t - LOOKBACK + 1:t + HORIZON + 1].all() for t in range(n)]


def test_validity(spark, frame):
    pdf = frame.where("location_hash = 'n0000001'").orderBy("t").toPandas()
    valid = pdf["valid_sample"].to_numpy()
    assert not valid[:LOOKBACK - 1].any() and not valid[-HORIZON:].any() and not valid[420]
    assert valid.tolist() == numpy_valid(pdf) and valid.any()


def test_features_equal_pandas(spark, frame):
    raw = raw_frame()
    one = raw[raw["location_hash"] == "n0000001"].set_index("timestamp").drop(columns="location_hash").ffill(limit=3)
    got = frame.where("location_hash = 'n0000001'").orderBy("t").toPandas()
    np.testing.assert_allclose(got["log_pm25"].astype(float), np.log1p(one["pm25"].clip(lower=0)), equal_nan=True)
    np.testing.assert_allclose(got["wind_u"].astype(float), -one["wind_speed_ms"] * np.sin(np.deg2rad(one["wind_dir_deg"])), rtol=1e-9)
    local = one.index.tz_localize("UTC").tz_convert("Asia/Kolkata")
    np.testing.assert_allclose(got["doy_cos"], np.cos(2 * np.pi * local.dayofyear / 365.25))
    np.testing.assert_allclose(got["is_weekend"], (local.dayofweek >= 5).astype(float))
    y = np.log1p(one["no2"])
    np.testing.assert_allclose(got["d_lag6_no2"].astype(float)[200:], (y.shift(6) - y)[200:], rtol=1e-9)
    np.testing.assert_allclose(got["d_roll168_no2"].astype(float)[200:], (y.rolling(168, min_periods=1).mean() - y)[200:], rtol=1e-9, atol=1e-12)


def test_splits_do_not_overlap(spark, frame):
    parts = ft.chronological_splits(ft.sample_index(frame), 4, 4)
    edge = {r["split"]: (r["a"], r["b"]) for r in parts.groupBy("split").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()}
    assert edge["train"][1] + pd.Timedelta(hours=HORIZON) <= edge["val"][0]
    assert edge["val"][1] + pd.Timedelta(hours=HORIZON) <= edge["test"][0]


def test_stride_counts_from_the_first_hour(spark, frame):
    assert {r["t"] % 12 for r in ft.sample_index(frame, 12).collect()} == {0}


def test_tabular_columns_align(spark, frame):
    some = ft.sample_index(frame, 24).limit(5)
    got = ft.tabular_features(some.withColumn("leads", F.array(F.lit(7))), frame)
    assert len(TABULAR_FEATURES) == 85 and got.columns[3:88] == TABULAR_FEATURES
    rows = got.toPandas()
    assert len(rows) == 5 and rows["horizon"].tolist() == [7.0] * 5
    base = frame.toPandas().set_index(K)
    for r in rows.to_dict("records"):
        now, then = base.loc[(r["location_hash"], r["timestamp"])], base.loc[(r["location_hash"], r["timestamp"] + pd.Timedelta(hours=7))]
        assert r["y_co"] == pytest.approx(then["log_co"] - now["log_co"])
        day_before = base.loc[(r["location_hash"], r["timestamp"] + pd.Timedelta(hours=7 - 24))]
        assert r["d_yday_co"] == pytest.approx(day_before["log_co"] - now["log_co"])
        assert [r[f"fut_{c}"] for c in FUTURE_FEATURES] == [pytest.approx(then[c]) for c in FUTURE_FEATURES]


def test_past_matrix_shape(spark, frame):
    some = ft.sample_index(frame, 48).limit(3)
    plain, patched = ft.past_matrix(some, frame).first(), ft.past_matrix(some, frame, 4).first()
    assert len(plain["past"]) == 168 and len(plain["past"][0]) == 26
    assert len(patched["past"]) == 42 and len(patched["past"][0]) == 4 * 26


def test_subsample_is_exact_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r["k"] for r in ft.subsample(df, ["k"], 777, 1).collect()}
    b = {r["k"] for r in ft.subsample(df.repartition(7), ["k"], 777, 1).collect()}
    assert len(a) == 777 and a == b and a != {r["k"] for r in ft.subsample(df, ["k"], 777, 2).collect()}
    assert ft.subsample(df, ["k"], 9000).count() == 5000


def test_random_horizons_are_uniform(spark):
    s = spark.range(4000).select(F.concat(F.lit("n"), F.col("id")).alias("location_hash"), F.lit(at(0)).alias("timestamp"))
    got = ft.random_horizons(s, 6, 1).select(F.explode("leads").alias("horizon")).groupBy("horizon").count().toPandas()
    assert sorted(got["horizon"]) == list(range(1, 25)) and got["count"].between(850, 1150).all()


def wide(spark, members, truth=0.0, n=2):
    rows = spark.range(n).select(
        F.concat(F.lit("n"), F.col("id")).alias("location_hash"), F.lit(at(0)).alias("timestamp"), F.lit(1).alias("horizon"),
        *[F.lit(float(truth)).alias(f"y_{p}") for p in POLLUTANTS],
        *[F.lit(float(v)).alias(f"{m}_{p}") for m, v in members.items() for p in POLLUTANTS],
    )
    return rows


def weights(spark, **by_member):
    return spark.createDataFrame([(p, m, w) for p in POLLUTANTS for m, w in by_member.items()], "pollutant string, member string, weight double")


def test_weight_search_finds_the_grid_minimum(spark, monkeypatch):
    """The same tuple as trying all 231, with ties and unknown values, from at most a third of the row copies."""
    rng = np.random.default_rng(5)
    for seed in range(3):
        n, made = 300, []
        data = {f"{m}_{p}": rng.normal(seed, 1, n) for m in MEMBERS for p in POLLUTANTS}
        for k, p in enumerate(POLLUTANTS):
            mix = rng.dirichlet([0.6] * 3)
            data[f"y_{p}"] = sum(w * data[f"{m}_{p}"] for w, m in zip(mix, MEMBERS)) + rng.normal(0, 0.2 * k, n)
        data["y_co"] = data["huber_o3"] * 0 + 1.0
        for m in MEMBERS:
            data[f"{m}_co"] = data["gbt_co"]        # every tuple is as good: the first counts
        frame = pd.DataFrame(data).astype(object)
        frame.loc[::17, "y_pm25"] = None
        errors = ev._errors
        monkeypatch.setattr(ev, "_errors", lambda r, m, wanted, g: made.append(sum(map(len, wanted.values()))) or errors(r, m, wanted, g))
        got = {(r["pollutant"], r["member"]): (r["weight"], r["mae"]) for r in ev.search_weights(spark.createDataFrame(frame)).collect()}
        monkeypatch.undo()
        grid = np.array(ev.simplex(3))
        for p in POLLUTANTS:
            known = ~pd.isna(frame[f"y_{p}"])
            x = np.stack([frame.loc[known, f"{m}_{p}"].astype(float) for m in MEMBERS])
            mae = np.abs(grid @ x - frame.loc[known, f"y_{p}"].astype(float).to_numpy()).mean(axis=1)
            i = min(range(len(grid)), key=lambda i: (round(mae[i], 9), i))
            assert [got[p, m][0] for m in MEMBERS] == pytest.approx(list(grid[i])) and got[p, "rf"][1] == pytest.approx(mae[i])
        assert sum(made) <= 231 * len(POLLUTANTS) // 3 + 231


def test_blend(spark):
    rows, w = wide(spark, {"a": 0, "b": 1, "c": 2}), weights(spark, a=0.5, b=0.5, c=0.0)
    assert ev.blend(rows, w, ["a", "b", "c"]).first()["ensemble_pm25"] == pytest.approx(0.5)
    assert ev.blend(rows, w, ["c"]).first()["ensemble_pm25"] == pytest.approx(2.0)


def test_delta_to_conc(spark):
    from vayuspark.functions.values import delta_to_conc

    df = spark.createDataFrame([(math.log1p(9.0), 0.0), (0.1, -5.0)], "l double, d double")
    assert [r[0] for r in df.select(delta_to_conc(F.col("l"), F.col("d"))).collect()] == [pytest.approx(9.0), 0.0]


def test_simplex():
    grid = ev.simplex(3)
    assert len(grid) == 231 and all(abs(sum(w) - 1) < 1e-9 for w in grid) and len(set(grid)) == 231
    axis = np.round(np.arange(0, 1 + 1e-9, 0.05), 4)
    combos = [tuple(c) for c in np.array(np.meshgrid(axis, axis, axis)).T.reshape(-1, 3) if abs(c.sum() - 1) < 1e-6]
    assert [tuple(map(float, c)) for c in combos] == grid


def test_search_finds_the_mix(spark):
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(size=(3, 400))
    pdf = pd.DataFrame({f"{m}_{p}": v for p in POLLUTANTS for m, v in (("a", a), ("b", b), ("c", c))})
    for p in POLLUTANTS:
        pdf[f"y_{p}"] = 0.35 * a + 0.65 * c
    got = ev.search_weights(spark.createDataFrame(pdf), ["a", "b", "c"]).where("pollutant = 'o3'").collect()
    assert {r["member"]: r["weight"] for r in got} == {"a": 0.35, "b": 0.0, "c": 0.65}


def brute_wilcoxon(x, y):
    d = np.round(x - y, 9)
    d = d[d != 0]
    size = np.abs(d)
    ranks = pd.Series(size).rank().to_numpy()
    n, w_plus = len(d), ranks[d > 0].sum()
    ties = sum(c**3 - c for c in pd.Series(size).value_counts())
    z = (w_plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return n, w_plus, 0.5 * math.erfc(-z / math.sqrt(2))


@pytest.mark.parametrize("shift", [0.0, -0.2, -1.0])
def test_wilcoxon(spark, shift):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(shift, 1, 600), 2)
    b = np.round(rng.normal(0, 1, 600), 2)
    got = ev.wilcoxon_less(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})), "a", "b").first()
    n, w_plus, p = brute_wilcoxon(a, b)
    assert (got["n"], got["w_plus"]) == (n, w_plus) and got["p_value"] == pytest.approx(p, rel=1e-5)


@pytest.mark.parametrize("digits", [1, 6])
def test_wilcoxon_small_is_exact(spark, digits):
    """Few pairs, with ties and a zero: the share of all sign patterns whose rank sum is as low."""
    rng = np.random.default_rng(6)
    a, b = np.round(rng.normal(-0.3, 1, 13), digits), np.round(rng.normal(0, 1, 13), digits)
    a[0] = b[0]
    got = ev.wilcoxon_less(spark.createDataFrame(pd.DataFrame({"a": a, "b": b})), "a", "b").first()
    d = (a - b)[np.round(a - b, 9) != 0]
    ranks = pd.Series(np.round(np.abs(d), 9)).rank().to_numpy()
    w = ranks[d > 0].sum()
    sums = [sum(r for k, r in enumerate(ranks) if signs >> k & 1) for signs in range(2 ** len(d))]
    assert (got["n"], got["w_plus"]) == (len(d), w) and got["p_value"] == pytest.approx(np.mean([s <= w for s in sums]))


def test_wilcoxon_keeps_small_differences(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": np.arange(1, 41) * 1e-10, "b": np.zeros(40)}))
    assert ev.wilcoxon_less(df, "a", "b").first()["n"] == 40
    clear = ev.wilcoxon_less(spark.createDataFrame(pd.DataFrame({"a": np.zeros(40), "b": np.arange(1.0, 41)})), "a", "b").first()
    assert clear["p_value"] == pytest.approx(2.0**-40)
    assert ev.wilcoxon_less(df.where("a > 1"), "a", "b").first()["p_value"] is None


def test_promote(spark):
    s = lambda v: spark.createDataFrame([("ensemble", v)], "model string, aqi_mae double")
    assert ev.promote(s(10.1), s(10.0)).first()["promote"] and not ev.promote(s(10.3), s(10.0)).first()["promote"]
    assert ev.promote(s(10.0), None).first()["promote"]


def test_no_node_to_forecast_is_an_error(spark, frame):
    with pytest.raises(Exception, match="complete window"):
        forecast_all(frame, at(5), lambda leads, f: ev.with_baselines(ft.horizon_rows(leads, f)), ["persistence"], weights(spark, persistence=1.0)).collect()


def test_forecast_rows(spark, frame):
    got = forecast_all(
        frame, at(650), lambda leads, f: ev.with_baselines(ft.horizon_rows(leads, f)), ev.BASELINES, weights(spark, persistence=0.5, seasonal_naive=0.5),
    ).toPandas()
    assert len(got) == 48 and got["hours_ahead"].max() == 24 and got["aqi"].between(0, 500).all() and got["aqi_lower"].isna().all()


def test_targets_are_not_needed_to_issue(spark):
    """Hours after t may lack pollutants: the forecast can start, the sample cannot be learnt from."""
    raw = raw_frame()
    raw.loc[(raw["timestamp"] > at(700)), POLLUTANTS] = np.nan
    got = ft.hour_frame(to_spark(spark, raw), nodes2(spark)).where("location_hash = 'n0000002' and t = 690").first()
    assert not got["valid_sample"]
    assert got["valid_issue"] is True
