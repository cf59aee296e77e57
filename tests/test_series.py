import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import at, series
from vayuspark.operators import blocks, windows as w

N = None


def values(df, col="x"):
    return [r[col] for r in df.orderBy("timestamp").collect()]


def test_ffill_then_bfill(spark):
    df = series(spark, [1, N, N, N, N, N, 7])
    assert values(w.ffill(df, ["x"])) == [1, 1, 1, 1, N, N, 7]
    assert values(w.fill(df, ["x"], 3, 3)) == [1, 1, 1, 1, 7, 7, 7]


def test_interpolation(spark):
    df = series(spark, [0, N, N, N, N, 10, N, N, N, N])
    assert values(w.interpolate_time(df, ["x"])) == [0, 2, 4, 6, N, 10, 10, 10, 10, N]


def random_gaps(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    x[rng.random(n) < 0.6] = np.nan
    x[700:1500] = np.nan
    return x


@pytest.mark.parametrize("hourly", [True, False])
def test_fills_equal_pandas_over_many_blocks(spark, hourly):
    x = random_gaps(2200, 1)
    df = series(spark, [N if np.isnan(v) else v for v in x])
    want = pd.Series(x).ffill(limit=3).bfill(limit=2)
    got = pd.Series(values(w.fill(df, ["x"], 3, 2, hourly=hourly)), dtype=float)
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_row_limits_on_an_uneven_axis(spark):
    """Limits count rows, however far apart the rows are."""
    hours = [0, 5, 900, 901, 5000, 5001, 5002]
    df = series(spark, [1, N, N, N, N, 6, N], hours=hours)
    assert values(w.fill(df, ["x"], 3, 0)) == [1, 1, 1, 1, N, 6, 6]


def test_interpolation_equals_pandas_over_many_blocks(spark):
    x = random_gaps(2200, 2)
    idx = pd.to_datetime([at(i) for i in range(len(x))])
    want = pd.Series(x, index=idx).interpolate(method="time", limit=3)
    got = values(w.interpolate_time(series(spark, [N if np.isnan(v) else v for v in x]), ["x"]))
    np.testing.assert_allclose(np.array(got, dtype=float), want.to_numpy(), rtol=1e-9)


def test_spine_and_keep_last(spark):
    df = series(spark, [1, 2, 3], hours=[0, 4, 4]).withColumn("ingested_at", F.monotonically_increasing_id())
    kept = w.keep_last(df, ["location_hash", "timestamp"], ["x"])
    assert sorted(values(kept)) == [1, 3]
    assert values(w.hourly_spine(kept.drop("ingested_at"))) == [1, N, N, N, 3]


def test_keep_last_of_a_key_with_a_third_of_all_rows(spark):
    rows = spark.range(90000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("k"), F.col("id").alias("v")
    )
    kept = w.keep_last(rows, ["k"], ["v"])
    assert kept.count() == 60001 and kept.where("k = 'hot'").first()["v"] == 89997


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.floats(0, 1))
def test_exact_quantiles_equal_numpy(spark, xs, q):
    xs = xs + [xs[0]] * 20
    df = spark.createDataFrame([("g", float(x)) for x in xs], "g string, v double")
    got = blocks.exact_quantiles(df, ["g"], "v", [q], ["out"]).first()["out"]
    assert got == pytest.approx(np.quantile(xs, q), rel=1e-9, abs=1e-9)


def test_running_before_is_a_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = blocks.running_before(df, [], F.floor(F.col("v") / 37), ["v"]).collect()
    assert all(r["before"] == r["v"] for r in got)


def test_halo_copies_only_what_is_seen(spark):
    df = spark.range(100).withColumnRenamed("id", "pos")
    got = blocks.with_halo(df, F.col("pos"), 10, before=3, after=2)
    assert got.count() == 100 + 10 * 3 + 10 * 2 and blocks.core_rows(got).count() == 100
