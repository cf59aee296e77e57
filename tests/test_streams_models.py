import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, gamma_hours, nodes2, raw_frame, six, to_spark
from vayuspark.operators.windows import keep_last
from vayuspark.plans import ingest as ing, proxy as px, training as tr
from vayuspark.plans.aqi import AQI_COLUMNS, refresh_aqi
from vayuspark.session import run_dir
from vayuspark.sources.tables import read_table
from vayuspark.streaming import jobs
from vayuspark.vocab import POLLUTANTS

K = ["location_hash", "timestamp"]


def stream_of(spark, df, files=3):
    path = run_dir(spark, "in")
    df.repartitionByRange(files, "timestamp").write.parquet(path)
    return jobs.read_stream(spark, path, df.schema)


def drained(spark, df):
    out = run_dir(spark, "out")
    jobs.drain(df, out, run_dir(spark, "cp"))
    return spark.read.schema(df.schema).parquet(out)


def test_streaming_index_equals_batch(spark):
    """Hours in any order, late ones and revisions of older ones; and nothing changes when the stream is started again."""
    obs = six(spark, gamma_hours(100)).where("hour(timestamp) != 7").withColumn("version", F.lit(1))
    first = obs.where("hour(timestamp) % 4 != 1").withColumn("pm25", F.when(F.hour("timestamp") % 4 == 2, F.col("pm25") * 9).otherwise(F.col("pm25")))
    late = obs.where("hour(timestamp) % 4 = 1")
    revised = obs.where("hour(timestamp) % 4 = 2").withColumn("version", F.lit(2))
    folder, index, cp, hours = (run_dir(spark, n) for n in ("in", "index", "cp", "hours"))
    sizes = []
    for part in (first, late, revised):
        part.coalesce(1).write.mode("append").parquet(folder)
        jobs.index_stream(jobs.read_stream(spark, folder, obs.schema, 1), hours, index, cp, ["version"]).awaitTermination()
        sizes.append(read_table(spark, index, refresh_aqi(obs).schema).count())
    jobs.index_stream(jobs.read_stream(spark, folder, obs.schema, 1), hours, index, cp, ["version"]).awaitTermination()
    assert sizes[0] < sizes[1] == sizes[2]
    want = refresh_aqi(obs)
    a, b = (d.select(*AQI_COLUMNS).orderBy("timestamp").toPandas() for d in (read_table(spark, index, want.schema), want))
    pd.testing.assert_frame_equal(a, b)


def test_live_pairs_without_an_index_at_issue(spark):
    """An unknown index at issue leaves its column empty; the pair is given once the watermark has passed."""
    fc = spark.createDataFrame([(at(h), at(h + 1), "a", 1, 10.0, 100, "Satisfactory", "v") for h in (0, 1, 2)], "forecast_generated_at timestamp, forecast_target_time timestamp, location_hash string, hours_ahead int, pm25 double, aqi int, aqi_category string, model_version string")
    came = spark.createDataFrame([("a", at(h), 50 + h, "Good", 5.0) for h in (1, 2, 3, 200)], "location_hash string, timestamp timestamp, aqi int, aqi_category string, pm25 double")
    more = fc.limit(1).withColumn("forecast_generated_at", F.lit(at(200)))
    paths = [run_dir(spark, n) for n in ("fc", "came")]
    for path, df in zip(paths, (fc.unionByName(more), came)):
        df.coalesce(1).write.parquet(path)
    streams = [jobs.read_stream(spark, paths[0], fc.schema), *[jobs.read_stream(spark, paths[1], came.schema) for _ in range(2)]]
    rows = drained(spark, jobs.live_pairs(*streams, "1 hours")).collect()
    assert {(r["forecast_generated_at"], r["issue_aqi"], r["actual"]) for r in rows} == {(at(0), None, 51), (at(1), 51, 52), (at(2), 52, 53)}


def test_stream_upsert_keeps_the_last_and_can_run_again(spark):
    df = spark.createDataFrame([("a", at(h), float(v), v) for h in range(30) for v in (1, 3, 2)], "location_hash string, timestamp timestamp, x double, version int").withColumn("obs_date", F.to_date("timestamp"))
    stream, path, cp = stream_of(spark, df), run_dir(spark, "t"), run_dir(spark, "cp")
    for _ in range(2):
        jobs.upsert_stream(stream, path, cp, ["version"]).awaitTermination()
    got = read_table(spark, path, df.schema)
    assert got.count() == 30 and got.select("x").distinct().collect()[0][0] == 3.0


def test_first_per_hour(spark):
    df = spark.createDataFrame([("a", at(h), float(v)) for h in range(10) for v in (1, 2)], "location_hash string, timestamp timestamp, x double")
    assert drained(spark, jobs.first_per_hour(stream_of(spark, df, 1))).count() == 10


def proxy_rows(n=600, seed=0):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({c: rng.uniform(0.1, 1, n) for c in ("aod", *px.WEATHER)})
    df["pm25"], df["pm10"] = 100 * df["aod"], 180 * df["aod"]
    df.insert(0, "timestamp", [at(i) for i in range(n)])
    df.insert(0, "location_hash", "a")
    return df


TREES = {"maxIter": 5, "maxDepth": 4, "stepSize": 0.5}


def test_gap_filling(spark):
    pdf = proxy_rows()
    full = to_spark(spark, pdf)
    models, metrics = px.train_proxy(full, TREES)
    assert {r["target"]: r["r2"] > 0.8 for r in metrics.collect()} == {"pm25": True, "pm10": True}
    holes = pdf.copy()
    holes.loc[100:110, "pm25"] = np.nan
    holes.loc[105:120, "pm10"] = np.nan
    got = px.fill_pm_gaps(to_spark(spark, holes), models).orderBy("timestamp").toPandas()
    flagged = got["pm_gap_filled"].to_numpy()
    assert np.flatnonzero(flagged).tolist() == list(range(100, 121)) and got["pm25"].notna().all()
    keep = ~np.isin(np.arange(len(pdf)), range(100, 111))
    np.testing.assert_array_equal(got["pm25"][keep], pdf["pm25"][keep])
    assert got["pm25"].between(0, 500).all() and (got["pm25"] - pdf["pm25"]).abs()[100:111].mean() < 15
    plain = px.fill_pm_gaps(to_spark(spark, holes), None)
    assert plain.where("pm_gap_filled").count() == 0 and plain.where("pm25 is null").count() == 11


def test_estimates_replace_nothing(spark):
    pdf = proxy_rows(300)
    models, _ = px.train_proxy(to_spark(spark, pdf), TREES)
    pdf.loc[:, "temp_c"] = np.nan
    pdf.loc[:149, "temp_c"] = 0.5
    got = px.proxy_estimates(to_spark(spark, pdf), models).orderBy("timestamp").toPandas()
    assert got["pm25_proxy"].notna().tolist() == [True] * 152 + [False] * 148      # two rows carried forward
    np.testing.assert_array_equal(got["pm25"], pdf["pm25"])


def test_missing_targets_are_an_error(spark):
    with pytest.raises(ValueError, match="missing columns"):
        px.training_matrix(to_spark(spark, proxy_rows(30)).drop("pm25"))


def test_training_run(spark):
    raw = raw_frame(24 * 26, 3)
    hours = np.tile(np.arange(24 * 26), 2)
    for i, p in enumerate(POLLUTANTS):       # a daily cycle that can be learnt
        raw[p] = 30 + 20 * np.sin(2 * np.pi * hours / 24 + i) + 0.05 * raw[p]
    settings = tr.Settings(
        val_days=4, test_days=4, stride=4, train_draws=2, val_draws=1, train_samples=60,
        gbt={"maxIter": 3, "maxDepth": 2, "stepSize": 0.3}, rf={"numTrees": 5, "maxDepth": 3}, huber={"maxIter": 10, "regParam": 0.01, "epsilon": 1.35},
    )
    run = tr.run_training(to_spark(spark, raw), nodes2(spark), settings, "t1")
    scores = {r["model"]: r["aqi_mae"] for r in run.scores.collect()}
    assert set(scores) == {"persistence", "seasonal_naive", "huber", "gbt", "rf", "ensemble"}
    assert scores["ensemble"] < scores["persistence"]
    w = run.weights.toPandas()
    np.testing.assert_allclose(w.groupby("pollutant")["weight"].sum(), 1.0)
    assert 0 < run.coverage.first()["coverage"] <= 1 and run.quantiles.count() == 144
    import json

    card = json.loads(run.card.first()["card"])
    assert card["model_version"] == "t1" and card["data"]["train_windows"] == 60 and len(card["test"]["models"]) == 6
    stored_run_is_the_same(spark, run, raw, settings)


def stored_run_is_the_same(spark, run, raw, settings):
    from vayuspark.operators import features as ft
    from vayuspark.plans import artefacts
    from vayuspark.session import run_dir

    path = run_dir(spark, "trained")
    assert artefacts.load_run(spark, path) is None
    artefacts.save_run(run, path)
    again = artefacts.load_run(spark, path)
    frame = ft.hour_frame(to_spark(spark, raw), nodes2(spark))
    leads = ft.all_horizons(run.test.orderBy("location_hash", "timestamp").limit(3))
    rows = lambda r: sorted(map(str, tr.predictor(r.models, r.spec, r.stds)(leads, frame).collect()))
    assert len(rows(run)) == 72 and rows(again) == rows(run)
    assert again.card.collect() == run.card.collect() and sorted(again.weights.collect()) == sorted(run.weights.collect())


def test_ingestion_pass(spark):
    from test_tables import payload
    from vayuspark.sources.readers import hourly_schema
    from vayuspark.vocab import AIR_NAMES

    times = ["2026-01-01T00:00", "2026-01-01T01:00", "2026-01-01T02:00"]
    body = {"time": times, **{n: [100.0, None, 102.0] for n in AIR_NAMES}}
    air = spark.createDataFrame([("a", body), ("b", body)], hourly_schema(AIR_NAMES))
    got = ing.ingest(payload(spark), air, at(1.5))
    assert got["observed"].count() == 4 and got["future"].count() == 2 and got["aqi"].count() == 4
    filled = got["frame"].where("location_hash = 'a'").orderBy("timestamp").collect()
    assert [r["pm25"] for r in filled] == [100, 100, 102] and filled[0]["co"] == pytest.approx(0.1)


def test_hot_node_with_many_copies(spark):
    """A third of all rows repeats one node's hours; the index is the same as without the copies."""
    base = six(spark, gamma_hours(48)).unionByName(six(spark, gamma_hours(48, 2), "b"))
    copies = base.where("location_hash = 'a'").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20)))).drop("i")
    clean = keep_last(base.unionByName(copies), K)
    assert refresh_aqi(clean).orderBy(*K).collect() == refresh_aqi(base).orderBy(*K).collect()
