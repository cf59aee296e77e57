import pytest
from pyspark.sql import functions as F

from helpers import at, series
from vayuspark.functions.calendar import as_ts
from vayuspark.operators import joins, quality, serving, skill
from vayuspark.session import run_dir
from vayuspark.sources import readers as rd, tables as tb
from vayuspark.vocab import DEFAULT_WEIGHTS, WEATHER_NAMES

K = ["location_hash", "timestamp"]


def rows(spark, *data):
    df = spark.createDataFrame(list(data), "location_hash string, timestamp timestamp, x double, ingested_at int")
    return df.withColumn("obs_date", F.to_date("timestamp"))


def content(spark, path, schema):
    return sorted((r["location_hash"], r["timestamp"], r["x"]) for r in tb.read_table(spark, path, schema).collect())


def test_upsert_replaces_and_is_idempotent(spark):
    path = run_dir(spark, "t")
    first = rows(spark, ("a", at(0), 1.0, 1), ("a", at(30), 2.0, 1), ("b", at(0), 3.0, 1))
    late = rows(spark, ("a", at(0), 9.0, 2), ("a", at(0), 8.0, 1), ("c", at(60), 5.0, 2))
    for part in (first, late, late):
        tb.upsert(spark, path, part, K, ["ingested_at"], "obs_date")
    assert content(spark, path, first.schema) == [("a", at(0), 9.0), ("a", at(30), 2.0), ("b", at(0), 3.0), ("c", at(60), 5.0)]


def test_insert_if_absent_keeps_old_rows(spark):
    path = run_dir(spark, "t")
    a = rows(spark, ("a", at(0), 1.0, 1))
    tb.insert_if_absent(spark, path, a, K, "obs_date")
    tb.insert_if_absent(spark, path, rows(spark, ("a", at(0), 7.0, 2), ("b", at(0), 2.0, 2)), K, "obs_date")
    assert content(spark, path, a.schema) == [("a", at(0), 1.0), ("b", at(0), 2.0)]


@pytest.mark.parametrize("hour", [0, 13])
def test_prune_is_strict(spark, hour):
    path = run_dir(spark, "t")
    df = rows(spark, *[("a", at(h), float(h), 1) for h in range(240)])
    tb.upsert(spark, path, df, K, ["ingested_at"], "obs_date")
    tb.prune(spark, path, "timestamp", "obs_date", at(120 + hour), 2)
    kept = [r[2] for r in content(spark, path, df.schema)]
    assert min(kept) == 72 + hour and len(kept) == 240 - 72 - hour


def test_prune_with_nothing_left_of_the_day(spark):
    path = run_dir(spark, "t")
    df = rows(spark, ("a", at(0), 0.0, 1), ("a", at(50), 1.0, 1))
    tb.upsert(spark, path, df, K, ["ingested_at"], "obs_date")
    tb.prune(spark, path, "timestamp", "obs_date", at(34), 1)
    assert content(spark, path, df.schema) == [("a", at(50), 1.0)]


def test_prune_twice_and_of_nothing(spark):
    path = run_dir(spark, "t")
    assert tb.prune(spark, path, "timestamp", "obs_date", at(34), 1) == {"dropped": 0, "kept": 0}
    tb.upsert(spark, path, rows(spark, ("a", at(0), 0.0, 1), ("a", at(3), 1.0, 1)), K, ["ingested_at"], "obs_date")
    assert tb.prune(spark, path, "timestamp", "obs_date", at(200), 1) == {"dropped": 2, "kept": 0}
    assert tb.prune(spark, path, "timestamp", "obs_date", at(200), 1) == {"dropped": 0, "kept": 0}


def test_upsert_reads_only_the_days_it_touches(spark):
    path = run_dir(spark, "t")
    old = rows(spark, *[("a", at(24 * d), float(d), 1) for d in range(30)])
    tb.upsert(spark, path, old, K, ["ingested_at"], "obs_date")
    new = rows(spark, ("a", at(24 * 7), 70.0, 2))
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = tb.only(tb.read_table(spark, path, old.schema), tb.touched(new, "obs_date"), "obs_date")._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: [", 1)[1].split("PushedFilters", 1)[0]
    day = new.first()["obs_date"]
    assert "obs_date" in filters and (str(day) in filters or str((day - type(day)(1970, 1, 1)).days) in filters), filters
    tb.upsert(spark, path, new, K, ["ingested_at"], "obs_date")
    assert [r[2] for r in content(spark, path, old.schema)] == [70.0 if d == 7 else float(d) for d in range(30)]


def test_a_write_that_dies_counts_for_nothing(spark, monkeypatch):
    path = run_dir(spark, "t")
    old = rows(spark, *[("a", at(24 * d + h), float(d), 1) for d in range(3) for h in (0, 5)])
    tb.upsert(spark, path, old, K, ["ingested_at"], "obs_date")
    before = content(spark, path, old.schema)
    new = rows(spark, *[("a", at(24 * d), 10.0 + d, 2) for d in range(3)])
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "coalesce", lambda self, n: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            tb.upsert(spark, path, new, K, ["ingested_at"], "obs_date")
    assert content(spark, path, old.schema) == before
    tb.upsert(spark, path, new.where("x > 11"), K, ["ingested_at"], "obs_date")
    assert content(spark, path, old.schema) == sorted([("a", at(0), 0.0), ("a", at(24), 1.0), ("a", at(48), 12.0)] + [("a", at(24 * d + 5), float(d)) for d in range(3)])


def test_a_reader_between_data_and_commit_changes_nothing(spark, monkeypatch):
    """The reader sees the old rows whole, and the write behind it is not lost."""
    path = run_dir(spark, "t")
    old = rows(spark, ("a", at(0), 1.0, 1), ("a", at(30), 2.0, 1))
    tb.upsert(spark, path, old, K, ["ingested_at"], "obs_date")
    started = tb.read_table(spark, path, old.schema)
    seen, frame = [], type(spark.range(1))
    coalesce = frame.coalesce

    def reading(self, n):
        seen.append(content(spark, path, old.schema))
        return coalesce(self, n)

    with monkeypatch.context() as m:
        m.setattr(frame, "coalesce", reading)
        tb.upsert(spark, path, rows(spark, ("a", at(0), 11.0, 2), ("a", at(30), 12.0, 2)), K, ["ingested_at"], "obs_date")
    assert seen == [[("a", at(0), 1.0), ("a", at(30), 2.0)]]
    assert content(spark, path, old.schema) == [("a", at(0), 11.0), ("a", at(30), 12.0)]
    assert sorted(r["x"] for r in started.collect()) == [1.0, 2.0]      # a plan made before the write keeps its state


def test_clean_leaves_what_readers_see(spark):
    path = run_dir(spark, "t")
    for k in range(4):
        tb.upsert(spark, path, rows(spark, ("a", at(0), float(k), k), ("a", at(24 * (1 + k % 2)), 5.0 + k, k)), K, ["ingested_at"], "obs_date")
    want = content(spark, path, rows(spark, ("a", at(0), 0.0, 1)).schema)
    assert tb.clean(spark, path, keep=1) == 2 and tb.clean(spark, path, keep=1) == 0
    assert content(spark, path, rows(spark, ("a", at(0), 0.0, 1)).schema) == want == [("a", at(0), 3.0), ("a", at(24), 7.0), ("a", at(48), 8.0)]


def test_rows_without_a_day_are_kept(spark):
    path = run_dir(spark, "t")
    df = spark.createDataFrame([("a", at(5), 1.0, 1), ("a", at(0), 2.0, 1)], "location_hash string, timestamp timestamp, x double, ingested_at int").withColumn("obs_date", F.when(F.col("x") > 1, F.to_date("timestamp")))
    tb.upsert(spark, path, df, K, ["ingested_at"], "obs_date")
    tb.upsert(spark, path, df.withColumn("x", F.col("x") + 5).withColumn("ingested_at", F.lit(2)).where("obs_date is null"), K, ["ingested_at"], "obs_date")
    tb.insert_if_absent(spark, path, df, K, "obs_date")
    assert sorted(r["x"] for r in tb.read_table(spark, path, df.schema).collect()) == [2.0, 6.0]


def test_backfill_goes_on_where_it_stopped(spark, monkeypatch):
    monkeypatch.setattr(tb, "BATCHES", 2)
    path = run_dir(spark, "t")
    df = spark.createDataFrame([(b, "x") for b in (None, 0, 1, 2, 3)], "batch int, v string")
    frame, writes = type(spark.range(1)), []
    coalesce = frame.coalesce

    def dying(self, n):
        writes.append(1)
        if len(writes) == 2:
            raise RuntimeError("gone")
        return coalesce(self, n)

    with monkeypatch.context() as m:
        m.setattr(frame, "coalesce", dying)
        with pytest.raises(RuntimeError):
            tb.backfill_write(spark, df, path)
    assert tb.backfill_write(spark, df.withColumn("v", F.lit("y")), path) == 2
    got = {r["batch"]: r["v"] for r in tb.read_table(spark, path, df.schema).collect()}
    assert got == {None: "x", 0: "x", 1: "y", 2: "y", 3: "y"}


def test_backfill_skips_finished_batches(spark):
    path = run_dir(spark, "t")
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "batch int, v string")
    assert tb.backfill_write(spark, df.where("batch = 1"), path) == 0
    assert tb.backfill_write(spark, df.withColumn("v", F.lit("z")), path) == 1
    assert {(r["batch"], r["v"]) for r in tb.read_table(spark, path, df.schema).collect()} == {(1, "x"), (2, "z"), (None, "z")}


def test_registry(spark):
    empty = spark.createDataFrame([], "model_version string, card string, first_used_at timestamp, last_used_at timestamp")
    cards = spark.createDataFrame([("v1", '{"a":1}'), ("v2", "{}")], "model_version string, card string")
    one = tb.register_model(empty, cards, at(0))
    two = tb.register_model(one, spark.createDataFrame([("v1", '{"a":2}')], cards.schema), at(5)).collect()
    assert [tuple(r) for r in two] == [("v1", '{"a":2}', at(0), at(5))]
    assert serving.newest_card(one).first()["card"] == '{"a":1}'


def test_node_upsert_keeps_place(spark):
    old = spark.createDataFrame([("h", "old", "s", 1.0, 2.0, "grid", at(0))], "location_hash string, location_name string, state string, lat double, lon double, kind string, created_at timestamp")
    new = spark.createDataFrame([("h", "new", "t", 9.0, 9.0, "city"), ("i", "n", None, 3.0, 4.0, "grid")], "location_hash string, location_name string, state string, lat double, lon double, kind string")
    got = sorted(tuple(r) for r in tb.upsert_nodes(old, new, at(1)).collect())
    assert got == [("h", "new", "t", 1.0, 2.0, "city", at(0)), ("i", "n", None, 3.0, 4.0, "grid", at(1))]


def payload(spark, base=10.0):
    times = ["2026-01-01T00:00", "2026-01-01T01:00", "2026-01-01T02:00"]
    body = {"time": times, **{n: [base + i for i in range(3)] for n in WEATHER_NAMES}}
    return spark.createDataFrame([("a", body), ("b", body)], rd.hourly_schema(WEATHER_NAMES))


def test_payloads(spark):
    got = rd.explode_hourly(payload(spark), WEATHER_NAMES)
    assert got.count() == 6 and got.columns == [*K, *WEATHER_NAMES.values()]
    first = quality.standardise_units(got).orderBy("timestamp").first()
    assert first["timestamp"] == at(0) and first["wind_speed_ms"] == pytest.approx(10 / 3.6)


@pytest.mark.parametrize("as_list", [True, False])
def test_payload_files(spark, as_list, tmp_path):
    import json

    one = {"location_hash": "a", "hourly": {"time": ["2026-01-01T00:00"], "temperature_2m": [1.5]}}
    (tmp_path / "x.json").write_text(json.dumps([one, {**one, "location_hash": "b"}] if as_list else one, indent=1))
    got = rd.explode_hourly(rd.read_payloads(spark, str(tmp_path), WEATHER_NAMES), WEATHER_NAMES)
    assert sorted((r["location_hash"], r["temp_c"], r["wind_dir_deg"]) for r in got.collect()) == [("a", 1.5, None), ("b", 1.5, None)][: 2 if as_list else 1]


def test_missing_time_axis(spark):
    broken = spark.createDataFrame([("a", None)], rd.hourly_schema(WEATHER_NAMES))
    with pytest.raises(Exception, match="time axis"):
        rd.explode_hourly(broken, WEATHER_NAMES).collect()


def test_region_without_rows(spark):
    df = spark.createDataFrame([("a", [["id", "time", "B"], ["i", "1767225600000", "0.5"], ["i", "1767229200000", "x"]]), ("b", [["id", "time", "B"]])], "location_hash string, region array<array<string>>")
    got = [tuple(r) for r in rd.parse_region(df, "B").orderBy("timestamp").collect()]
    assert got == [("a", at(0), 0.5), ("a", at(1), None)]


def test_weights_fall_back(spark, tmp_path):
    def table(path):
        return {(r["pollutant"], r["member"]): r["weight"] for r in rd.read_weights(spark, path).collect()}

    missing = table(str(tmp_path / "no.json"))
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "w.json").write_text('{"co": {"gbt": 1.0}}')
    assert missing == table(str(tmp_path / "bad.json")) and missing["pm25", "huber"] == DEFAULT_WEIGHTS["huber"]
    learnt = table(str(tmp_path / "w.json"))
    assert learnt["co", "gbt"] == 1.0 and learnt["co", "rf"] == 0.0 and learnt["o3", "rf"] == DEFAULT_WEIGHTS["rf"]


def test_card_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"model_version": "v9"}')
    assert tuple(rd.read_card(spark, str(tmp_path / "c.json")).first()) == ("v9", '{"model_version": "v9"}')
    assert rd.read_card(spark, str(tmp_path / "none.json")).count() == 0


def test_split_at_half_past(spark):
    seen, ahead = quality.split_observed_future(series(spark, range(60)), at(4.5))
    assert seen.agg(F.max("timestamp")).first()[0] == at(4) and ahead.agg(F.min("timestamp")).first()[0] == at(5)
    assert ahead.agg(F.max("timestamp")).first()[0] == at(52)


def test_skill_of_one_pending_run(spark):
    runs = [(at(h), at(h + 1), "a", 1, 10.0, 100, "Satisfactory", "v") for h in (0, 1, 30)]
    fc = spark.createDataFrame(runs, "forecast_generated_at timestamp, forecast_target_time timestamp, location_hash string, hours_ahead int, pm25 double, aqi int, aqi_category string, model_version string")
    aqi = spark.createDataFrame([("a", at(1), 90, "Satisfactory"), ("a", at(2), 210, "Poor")], "location_hash string, timestamp timestamp, aqi int, aqi_category string")
    obs = spark.createDataFrame([("a", at(2), 14.0)], "location_hash string, timestamp timestamp, pm25 double")
    scored = spark.createDataFrame([(at(0),)], "forecast_generated_at timestamp")
    got = skill.evaluate_forecast_skill(fc, aqi, obs, scored, at(26)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["forecast_generated_at"], r["n_nodes"], r["aqi_mae"], r["aqi_bias"], r["category_accuracy"], r["persistence_aqi_mae"], r["pm25_mae"]) == (at(1), 1, 110, -110, 0, 120, 4)
    assert skill.evaluate_forecast_skill(fc, aqi, obs, scored, at(26), rescore=True).count() == 2


def test_summary_tie_goes_to_the_earliest_hour(spark):
    data = [("a", h, 171 + h, "Moderate" if h in (2, 3) else "Poor" if h in (1, 4) else "Severe") for h in range(1, 6)]
    df = spark.createDataFrame(data, "location_hash string, hours_ahead int, aqi int, aqi_category string").withColumns(
        {"forecast_generated_at": as_ts(at(0)), "model_version": F.lit("v"), "forecast_target_time": as_ts(at(1))}
    )
    got = serving.forecast_summary(df).first()
    assert (got["aqi_min"], got["aqi_max"], got["dominant_category"]) == (172, 176, "Poor")
    assert serving.forecast_peak(df).first()["hours_ahead"] == 5


def test_patch_takes_known_values_only(spark):
    left, right = series(spark, [1, 2, None]), series(spark, [None, 5, 6])
    assert [r["x"] for r in joins.patch_columns(left, right, ["x"]).orderBy("timestamp").collect()] == [1, 5, 6]
