import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, gamma_hours, series, six
from vayuspark.functions import cpcb
from vayuspark.operators import evaluate as ev, windows as w
from vayuspark.plans.aqi import aqi_along_path, refresh_aqi
from vayuspark.vocab import AVERAGES, BREAKPOINTS, INDEX_LEVELS, LABELS, POLLUTANTS, WINDOW_HOURS


def test_pm25_breakpoints(spark):
    values = [0, 30, 45, 60, 90, 250, 380, 900, -5, None, float("nan")]
    want = [0, 50, 75, 100, 200, 400, 500, 500, 0, None, None]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, c double")
    got = [r[0] for r in df.orderBy("i").select(cpcb.sub_index("c", "pm25")).collect()]
    assert got == [pytest.approx(x) if x is not None else None for x in want]


def test_categories_and_half_even(spark):
    df = spark.createDataFrame([(50.0,), (51.0,), (200.0,), (301.0,), (401.0,), (50.5,), (51.5,), (100.5,)], "a double")
    got = df.select(cpcb.half_even(F.col("a")), cpcb.category(cpcb.half_even(F.col("a")))).collect()
    assert [r[0] for r in got] == [50, 51, 200, 301, 401, 50, 52, 100]
    assert [r[1] for r in got] == ["Good", "Satisfactory", "Moderate", "Very Poor", "Severe", "Good", "Satisfactory", "Satisfactory"]


def test_composite(spark):
    row = spark.createDataFrame([(45.0, 80.0, 30.0, 10.0, 0.8, 40.0), (None,) * 6], ", ".join(f"{p} double" for p in POLLUTANTS))
    a, b = cpcb.composite(row, {p: p for p in POLLUTANTS}).select("aqi", "prominent_pollutant", "aqi_category").collect()
    assert tuple(a) == (80, "PM10", "Satisfactory")
    assert tuple(b) == (None, None, "Insufficient Data")


def test_tie_goes_to_the_first_pollutant(spark):
    row = spark.createDataFrame([(48.0, None, None, None, None, 80.0)], ", ".join(f"{p} double" for p in POLLUTANTS))
    got = cpcb.with_aqi(row, {p: p for p in POLLUTANTS}).first()
    assert got["sub_index_pm25"] == got["sub_index_o3"] == 80 and got["prominent_pollutant"] == "PM2.5"


def numpy_index(frame):
    """Straight reference: rolling means, interpolation, top."""
    subs = np.vstack([
        np.interp(frame[p].rolling(WINDOW_HOURS[p], min_periods=1).mean().clip(lower=0), BREAKPOINTS[p], INDEX_LEVELS)
        for p in POLLUTANTS
    ])
    return subs.max(axis=0), [LABELS[POLLUTANTS[i]] for i in subs.argmax(axis=0)]


@pytest.mark.parametrize("hours", [72, 800])
def test_refresh_matches_numpy_across_blocks(spark, hours):
    frame = gamma_hours(hours)
    got = refresh_aqi(six(spark, frame)).orderBy("timestamp").collect()
    top, who = numpy_index(frame)
    assert [r["aqi"] for r in got] == [int(np.round(v)) for v in top]
    assert [r["prominent_pollutant"] for r in got] == who


def test_since_has_whole_first_windows(spark):
    obs = six(spark, gamma_hours(100))
    whole = {r["timestamp"]: r for r in refresh_aqi(obs).collect()}
    part = refresh_aqi(obs, at(60)).collect()
    assert len(part) == 40 and all(whole[r["timestamp"]] == r for r in part)


def test_window_skips_a_hole(spark):
    df = series(spark, [*range(1, 26), 99], name="pm25", hours=[*range(25), 55])
    for p in POLLUTANTS[1:]:
        df = df.withColumn(p, F.lit(None).cast("double"))
    got = {r["timestamp"]: r["pm25_24h_avg"] for r in w.trailing_means(df).collect()}
    assert got[at(24)] == pytest.approx(13.5) and got[at(55)] == 99


def test_all_null_hour_has_no_row(spark):
    df = six(spark, gamma_hours(3)).withColumns({p: F.when(F.col("timestamp") > F.lit(at(0)), F.col(p)) for p in POLLUTANTS})
    assert refresh_aqi(df).count() == 2


def test_path_equals_frame(spark):
    frame, t = gamma_hours(), 40
    steps = six(spark, frame).withColumn("step", ((F.unix_timestamp("timestamp") - F.lit(0)) / 3600).cast("int"))
    first = steps.agg(F.min("step")).first()[0]
    steps = steps.withColumn("step", F.col("step") - F.lit(first + t))
    got = aqi_along_path(steps.where("step between -22 and 0"), steps.where("step between 1 and 24"), ["location_hash"])
    top, _ = numpy_index(frame)
    assert [r["aqi"] for r in got.orderBy("step").collect()] == [int(np.round(v)) for v in top[t + 1:t + 25]]


def test_row_means_equal_clock_means_on_a_spine(spark):
    obs = six(spark, gamma_hours(900))
    a = w.trailing_means(obs).select("timestamp", *AVERAGES.values()).orderBy("timestamp").toPandas()
    b = w.trailing_means_rows(w.hourly_spine(obs)).select("timestamp", *AVERAGES.values()).orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_result_does_not_depend_on_partitions(spark):
    obs = six(spark, gamma_hours(200)).unionByName(six(spark, gamma_hours(200, 5), "b"))
    one = refresh_aqi(obs.coalesce(1)).orderBy("location_hash", "timestamp").collect()
    many = refresh_aqi(obs.repartition(13, F.rand(1))).orderBy("location_hash", "timestamp").collect()
    assert one == many


def test_wide_path_guards_short_windows(spark):
    """A window with an unknown hour gives no index for that pollutant."""
    frame = gamma_hours(60)
    steps = six(spark, frame).withColumn("step", (F.unix_timestamp("timestamp") / 3600).cast("int"))
    first = steps.agg(F.min("step")).first()[0]
    steps = steps.withColumn("step", F.col("step") - F.lit(first + 30)).withColumn("timestamp", F.lit(at(30)))
    history = steps.where("step between -22 and 0").withColumn("pm25", F.when(F.col("step") != -3, F.col("pm25")))
    ahead = steps.where("step between 1 and 24").select("location_hash", "timestamp", "step", *[F.col(p).alias(f"truth_{p}") for p in POLLUTANTS])
    known = {p: [r[p] for r in history.orderBy(F.desc("step")).collect()] for p in POLLUTANTS}
    seen = lambda p, k: None if None in known[p][:k] else float(sum(known[p][:k]))
    rows = [(h, *[seen(p, max(0, WINDOW_HOURS[p] - h)) for p in POLLUTANTS]) for h in range(1, 25)]
    sums = spark.createDataFrame(rows, "step int, " + ", ".join(f"seen_{p} double" for p in POLLUTANTS))
    got = ev.path_index(ahead.join(sums, "step").withColumn("_block", F.lit(0)), ["truth"]).orderBy("step").collect()
    assert len(got) == 24 and all(r["truth_prominent"] != "PM2.5" for r in got if r["step"] <= 20)
