"""Members of the ensemble with Spark ML, the whole training run and the model card."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime
from functools import partial

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from vayuspark.operators import evaluate as ev, features as ft
from vayuspark.operators.blocks import BLOCK
from vayuspark.operators.windows import NODE, TIME
from vayuspark.plans.fits import fits_at_once, side_by_side
from vayuspark.session import cut_lineage
from vayuspark.vocab import FUTURE_FEATURES, HORIZON, LOOKBACK, MEMBERS, PAST_FEATURES, POLLUTANTS, TABULAR_FEATURES


@dataclass
class Settings:
    """Small defaults; raise them with the data."""

    val_days: int = 21
    test_days: int = 35
    stride: int = 1
    train_samples: int | None = None
    eval_samples: int | None = None
    train_draws: int = 6
    val_draws: int = 4
    gbt: dict = field(default_factory=lambda: {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8})
    rf: dict = field(default_factory=lambda: {"numTrees": 40, "maxDepth": 8})
    huber: dict = field(default_factory=lambda: {"maxIter": 50, "regParam": 0.01, "epsilon": 1.35})
    seed: int = 42


def regressor(member: str, settings: Settings):
    """One untrained regressor. Trees have no Huber loss in Spark ML, so boosting takes absolute error."""
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction"}
    if member == "huber":
        return LinearRegression(loss="huber", **settings.huber, **common)
    if member == "gbt":
        return GBTRegressor(lossType="absolute", validationIndicatorCol="is_val", seed=settings.seed, **settings.gbt, **common)
    # the same trees, but each pass starts at a row's last node and not at the root of all trees
    return RandomForestRegressor(seed=settings.seed, **{"cacheNodeIds": True, **settings.rf}, **common)


def matrix(leads: DataFrame, frame: DataFrame, spec: DataFrame) -> DataFrame:
    """Tabular rows with the assembled, standardised feature vector."""
    rows = ft.tabular_features(leads, frame, spec).fillna(0.0, TABULAR_FEATURES)
    return VectorAssembler(inputCols=TABULAR_FEATURES, outputCol="features").transform(rows).select(
        NODE, TIME, "lead", "features", *[f"last_{p}" for p in POLLUTANTS], *[f"y_{p}" for p in POLLUTANTS],
        *[f"d_yday_{p}" for p in POLLUTANTS], BLOCK, *ft.SEEN,
    )


def _std_of(stds: DataFrame):
    """Scale of the log change per pollutant and lead time, as array literals (144 numbers)."""
    known = {(s["pollutant"], s["horizon"]): s["std"] for s in stds.collect()}
    scales = {p: F.array(*[F.lit(float(known[p, h])) for h in range(1, HORIZON + 1)]) for p in POLLUTANTS}
    return lambda p: F.element_at(scales[p], F.col("lead"))


def train_members(train: DataFrame, val: DataFrame, stds: DataFrame, settings: Settings | None = None, members: list[str] = MEMBERS) -> dict:
    """{(member, pollutant): model}: six models per member on the scaled log change.

    `train` and `val` are matrices; boosting stops early on `val`. Some fits run at a time over one stored matrix, each
    spread over the cluster by Spark ML.
    """
    settings = settings or Settings()
    std = _std_of(stds)
    both = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    labels = {p: (F.col(f"y_{p}") / std(p)).alias(f"label_{p}") for p in POLLUTANTS}
    rows = cut_lineage(both.select("features", "is_val", *labels.values()), "matrix")

    def fit(m: str, p: str):
        data = rows.select("features", "is_val", F.col(f"label_{p}").alias("label")).where(F.col("label").isNotNull())
        return regressor(m, settings).fit(data if m == "gbt" else data.where(~F.col("is_val")))

    # boosting takes longest, so it starts first
    names = [(m, p) for m in sorted(members, key=lambda m: m != "gbt") for p in POLLUTANTS]
    at_once = fits_at_once(rows.count(), len(TABULAR_FEATURES), settings.rf.get("numTrees", 20))
    found = dict(zip(names, side_by_side(rows.sparkSession, [partial(fit, m, p) for m, p in names], at_once)))
    return {(m, p): found[m, p] for p in POLLUTANTS for m in members}


def predict_members(rows: DataFrame, models: dict, stds: DataFrame) -> DataFrame:
    """Add `<member>_<pollutant>` log changes to a matrix and name the lead `horizon`."""
    std = _std_of(stds)
    for (m, p), model in models.items():
        rows = model.setPredictionCol("_pred").transform(rows).withColumn(f"{m}_{p}", F.col("_pred") * std(p)).drop("_pred")
    return rows.drop("features").withColumnRenamed("lead", "horizon")


def predictor(models: dict, spec: DataFrame, stds: DataFrame):
    """The `predict` argument of `forecast_all`."""
    return lambda leads, frame: predict_members(matrix(leads, frame, spec), models, stds)


@dataclass
class Run:
    models: dict
    spec: DataFrame
    stds: DataFrame
    weights: DataFrame
    quantiles: DataFrame
    scores: DataFrame
    horizons: DataFrame
    pollutants: DataFrame
    test: DataFrame
    coverage: DataFrame
    p_value: DataFrame
    card: DataFrame


def run_training(
    obs: DataFrame, nodes: DataFrame, settings: Settings | None = None, version: str = "dev", members: list[str] = MEMBERS,
    source: str = "table", trained_at: datetime | None = None,
) -> Run:
    """Features -> splits -> scalers -> members -> weights and quantiles on validation -> scores on test."""
    s = settings or Settings()
    frame = cut_lineage(ft.hour_frame(obs, nodes), "frame")
    parts = ft.chronological_splits(ft.sample_index(frame, s.stride), s.val_days, s.test_days)

    def part(name: str, limit: int | None, seed: int = 0) -> DataFrame:
        rows = parts.where(F.col("split") == name).select(NODE, TIME, "t")
        return rows if limit is None else ft.subsample(rows, [NODE, TIME], limit, seed)

    train, val, test = (
        cut_lineage(part(n, k, i), n) for n, k, i in (("train", s.train_samples, 0), ("val", s.eval_samples, 0), ("test", s.eval_samples, 3))
    )
    spec = cut_lineage(ft.fit_scaler(train, frame), "spec")
    stds = cut_lineage(ft.target_std(ft.horizon_rows(ft.all_horizons(train), frame)), "stds")
    began = time.monotonic()
    models = train_members(
        matrix(ft.random_horizons(train, s.train_draws, 1), frame, spec),
        matrix(ft.random_horizons(val, s.val_draws, 2), frame, spec), stds, s, members,
    )
    minutes = (time.monotonic() - began) / 60
    predict = predictor(models, spec, stds)
    val_rows = cut_lineage(predict(ft.all_horizons(val), frame), "val-rows")
    weights = cut_lineage(ev.search_weights(val_rows, members), "weights")
    quantiles = cut_lineage(ev.residual_quantiles(ev.blend(val_rows, weights, members)), "quantiles")

    test_rows = ev.with_baselines(ev.blend(predict(ft.all_horizons(test), frame), weights, members))
    names = [*ev.BASELINES, *members, "ensemble"]
    paths = cut_lineage(
        ev.scored_paths(ev.with_interval(test_rows, quantiles), [*names, "lower", "upper"]), "paths"
    )
    # small tables that the card and the stored run read again: each is worked out once
    small = {
        "scores": ev.score_models(paths, names), "horizons": ev.score_horizons(paths, names), "pollutants": ev.score_pollutants(paths, names),
        "coverage": ev.interval_coverage(paths), "errors": ev.sample_errors(paths, ["ensemble", *members]),
    }
    kept = dict(zip(small, side_by_side(frame.sparkSession, [partial(cut_lineage, df, name) for name, df in small.items()])))
    best = ev.best_model(kept["scores"], members).first()["model"]
    p_value = cut_lineage(ev.wilcoxon_less(kept.pop("errors"), "ensemble", best).withColumn("best_member", F.lit(best)), "p-value")
    run = Run(models=models, spec=spec, stds=stds, weights=weights, quantiles=quantiles, test=test, p_value=p_value, card=None, **kept)
    run.card = model_card(run, obs, {"train": train, "val": val, "test": test}, version, source, trained_at, minutes)
    return run


def model_card(
    run: Run, obs: DataFrame, parts: dict[str, DataFrame], version: str, source: str = "table", trained_at: datetime | None = None,
    minutes: float | None = None,
) -> DataFrame:
    """(model_version, card): span, window counts, weights, quantiles and metrics as one JSON text.

    The test period goes from its first issue hour to the last hour of the data.
    """
    rows = lambda df: df.agg(F.collect_list(F.struct("*")).alias("x")).scalar()
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    span = obs.agg(F.min(TIME).alias("start"), F.max(TIME).alias("end"), F.count_distinct(NODE).alias("nodes"))
    first = parts["test"].agg(F.min(TIME).alias("t")).scalar()
    data = F.struct(
        F.lit(source).alias("source"), "start", "end", "nodes", *[count(d).alias(f"{n}_windows") for n, d in parts.items()],
        F.array(first, F.col("end")).alias("test_period"),
    )
    shape = F.struct(
        F.lit(LOOKBACK).alias("lookback_hours"), F.lit(HORIZON).alias("horizon_hours"),
        F.lit(len(PAST_FEATURES)).alias("past_features"), F.lit(len(FUTURE_FEATURES)).alias("future_features"),
        F.round(F.lit(minutes).cast("double"), 1).alias("train_minutes"),
    )
    test = F.struct(
        rows(run.scores).alias("models"), rows(run.horizons).alias("by_horizon"), rows(run.pollutants).alias("by_pollutant"),
        rows(run.coverage).alias("interval_80_coverage"), rows(run.p_value).alias("ensemble_vs_best_member"),
    )
    card = F.struct(
        F.lit(version).alias("model_version"), F.lit(trained_at).cast("timestamp").alias("trained_at"), data.alias("data"), shape.alias("architecture"),
        rows(run.weights).alias("ensemble_weights"), rows(run.quantiles).alias("residual_quantiles"), test.alias("test"),
    )
    return span.select(F.lit(version).alias("model_version"), F.to_json(card).alias("card"))
