"""Fits side by side within the executors' memory, and what makes a fit cheaper without changing it."""

import threading

import numpy as np
from pyspark.ml.feature import VectorAssembler

from vayuspark.plans import fits, proxy as px, training as tr


def test_large_fits_do_not_share_the_memory():
    assert fits.fits_at_once(20_000, 85, 40) == fits.AT_ONCE and fits.fits_at_once(0, 85) == fits.AT_ONCE
    assert fits.fits_at_once(10**8, 85, 40) == 1
    for rows in (10**5, 10**6, 3 * 10**6, 6 * 10**6):
        n = fits.fits_at_once(rows, 85, 40)
        assert n == fits.AT_ONCE or n * rows * (250 + 4 * 85 + 8 * 40) <= fits.CACHED_AT_ONCE < (n + 1) * rows * (250 + 4 * 85 + 8 * 40)


def test_folds_wait_when_the_rows_are_many(spark, monkeypatch):
    """The same folds and scores, one fit at a time."""
    rng = np.random.default_rng(3)
    names = ["aod", *px.WEATHER, *px.TARGETS]
    rows = [(f"n{i % 3}", i // 3, *map(float, v)) for i, v in enumerate(rng.gamma(3, 10, (600, len(names))))]
    df = spark.createDataFrame(rows, "location_hash string, hour int, " + ", ".join(f"{c} double" for c in names))
    obs = df.selectExpr("location_hash", "timestamp '2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, hour) as timestamp", *names)
    running, most, lock = [0], [0], threading.Lock()
    fit = px.Pipeline.fit

    def counted(self, *args):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return fit(self, *args)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(px.Pipeline, "fit", counted)
    trees = {"maxIter": 2, "maxDepth": 2}
    usual = px.cross_validate(obs, "pm25", 3, trees).collect()
    assert most[0] > 1
    most[0] = 0
    monkeypatch.setattr(fits, "CACHED_AT_ONCE", 1000)
    assert px.cross_validate(obs, "pm25", 3, trees).collect() == usual
    assert most[0] == 1


def test_forest_keeps_its_trees_with_cached_nodes(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([tuple(map(float, v)) for v in rng.normal(size=(500, 4))], "a double, b double, c double, label double").repartition(2).cache()
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    settings = tr.Settings(rf={"numTrees": 5, "maxDepth": 5})
    forest = tr.regressor("rf", settings)
    assert forest.getCacheNodeIds()
    trees = lambda model: model.toDebugString.split("\n", 1)[1]
    assert trees(forest.fit(rows)) == trees(tr.regressor("rf", settings).setCacheNodeIds(False).fit(rows))
