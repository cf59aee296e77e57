"""Particulate matter from AOD and weather: training, checks, gap filling."""

from __future__ import annotations

from functools import partial

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from vayuspark.functions.calendar import utc_calendar
from vayuspark.functions.values import clamp
from vayuspark.operators.aggregates import holdout_metrics
from vayuspark.operators.blocks import exact_quantiles
from vayuspark.operators.quality import PROXY_CORE, training_rows
from vayuspark.operators.windows import NODE, TIME, ffill, fill
from vayuspark.plans.fits import fits_at_once, side_by_side
from vayuspark.session import cut_lineage
from vayuspark.vocab import PROXY_DEFAULTS, PROXY_FEATURES, PROXY_FILL_ROWS, PROXY_LIMITS

TARGETS = ["pm25", "pm10"]
TREES = {"maxIter": 40, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.85}
WEATHER = PROXY_FEATURES[1:6]


def with_utc_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(utc_calendar(F.col(TIME)))


def _with_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in PROXY_DEFAULTS.items()})


def fill_features(df: DataFrame) -> DataFrame:
    """Defaults for pressure and mixing height; AOD carried 3 rows, then the node's median; the rest 2 rows each way."""
    carried = ffill(_with_defaults(df), ["aod"])
    middle = exact_quantiles(carried, [NODE], "aod", [0.5], ["_median"])
    joined = carried.join(middle, NODE, "left").withColumn("aod", F.coalesce("aod", "_median")).select(*df.columns)
    return fill(joined, ["aod", *WEATHER], PROXY_FILL_ROWS, PROXY_FILL_ROWS)


def training_matrix(obs: DataFrame) -> DataFrame:
    """Rows with AOD and both targets, weather gaps filled, ten features."""
    rows = _with_defaults(training_rows(obs).select(NODE, TIME, "aod", *WEATHER, *TARGETS))
    filled = fill(rows, ["aod", *WEATHER], PROXY_FILL_ROWS, PROXY_FILL_ROWS)
    return with_utc_calendar(filled).dropna(subset=PROXY_FEATURES)


def fold_of(k: int, seed: int = 42):
    return F.pmod(F.xxhash64(NODE, TIME, F.lit(seed)), F.lit(k)).cast("int")


def _pipeline(target: str, trees: dict, stop_early: bool) -> Pipeline:
    model = GBTRegressor(featuresCol="scaled", labelCol=target, predictionCol="prediction", seed=42, **trees)
    if stop_early:
        model = model.setValidationIndicatorCol("is_holdout")
    return Pipeline(stages=[
        VectorAssembler(inputCols=PROXY_FEATURES, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True), model,
    ])


def train_proxy(obs: DataFrame, trees: dict | None = None) -> tuple[dict, DataFrame]:
    """({target: pipeline model}, holdout RMSE/MAE/R2 per target); a fifth of the rows is held out."""
    rows = cut_lineage(training_matrix(obs).withColumn("is_holdout", fold_of(5) == 0), "proxy-rows")
    fits = [partial(_pipeline(target, trees or TREES, True).fit, rows) for target in TARGETS]
    models, metrics = dict(zip(TARGETS, side_by_side(obs.sparkSession, fits))), None
    for target, model in models.items():
        held = holdout_metrics(model.transform(rows.where("is_holdout")), target, "prediction").select(
            F.lit(target).alias("target"), "*"
        )
        metrics = held if metrics is None else metrics.unionByName(held)
    return models, metrics


def save_proxy(models: dict, path: str) -> None:
    """The pipelines; they count when the list of targets is there, which is written last."""
    spark = SparkSession.active()
    for target, model in models.items():
        model.write().overwrite().save(f"{path}/{target}")
    spark.createDataFrame([(t,) for t in models], "target string").coalesce(1).write.mode("overwrite").parquet(f"{path}/complete")


def load_proxy(spark: SparkSession, path: str) -> dict | None:
    """The stored pipelines, or None where no whole set is."""
    try:
        targets = [r["target"] for r in spark.read.schema("target string").parquet(f"{path}/complete").collect()]
    except AnalysisException:
        return None
    return {t: PipelineModel.load(f"{path}/{t}") for t in TARGETS if t in targets}


def cross_validate(obs: DataFrame, target: str, k: int = 5, trees: dict | None = None) -> DataFrame:
    """Mean and spread of RMSE and R2 over k hash folds; each fold is fitted once for both."""
    rows = cut_lineage(training_matrix(obs).withColumn("fold", fold_of(k)), "folds")
    pipeline = _pipeline(target, trees or TREES, False)

    def one(fold: int) -> list[float]:
        held = pipeline.copy().fit(rows.where(F.col("fold") != fold)).transform(rows.where(F.col("fold") == fold))
        held = cut_lineage(held.select(F.col(target).cast("double").alias(target), "prediction"), "held-out")
        return [float(RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName=m).evaluate(held)) for m in ("rmse", "r2")]

    each = side_by_side(obs.sparkSession, [partial(one, fold) for fold in range(k)], fits_at_once(rows.count(), len(PROXY_FEATURES)))
    found = dict(zip(("rmse", "r2"), zip(*each)))
    mean = {m: sum(v) / k for m, v in found.items()}
    spread = {m: (sum((x - mean[m]) ** 2 for x in v) / k) ** 0.5 for m, v in found.items()}
    return obs.sparkSession.createDataFrame([(target, m, mean[m], spread[m]) for m in found], "target string, metric string, mean double, std double")


def _predicted(df: DataFrame, models: dict) -> DataFrame:
    """Add `_pm25` and `_pm10` within their physical limits."""
    for target, model in models.items():
        df = model.transform(df).withColumn(f"_{target}", clamp(F.col("prediction"), 0.0, PROXY_LIMITS[target])).drop(
            "features", "scaled", "prediction"
        )
    return df


def proxy_estimates(df: DataFrame, models: dict) -> DataFrame:
    """Add pm25_proxy and pm10_proxy where AOD, temperature and humidity are known; nothing is replaced."""
    filled = fill_features(df)
    usable = F.lit(True)
    for c in PROXY_CORE:
        usable = usable & F.col(c).isNotNull()
    ready = with_utc_calendar(filled).where(usable).dropna(subset=PROXY_FEATURES)
    estimates = _predicted(ready, models).select(
        NODE, TIME, F.col("_pm25").alias("pm25_proxy"), F.col("_pm10").alias("pm10_proxy")
    )
    return filled.join(estimates, [NODE, TIME], "left")


def fill_pm_gaps(df: DataFrame, models: dict | None) -> DataFrame:
    """Fill missing pm25 and pm10 only, where all ten features are there, and flag those rows.

    Features are filled along each node's whole series; without models nothing changes.
    """
    if not models:
        return df.withColumn("pm_gap_filled", F.lit(False))
    gap = F.col("pm25").isNull() | F.col("pm10").isNull()
    features = fill_features(df.select(NODE, TIME, "aod", *WEATHER, *TARGETS)).where(gap)
    ready = with_utc_calendar(features).dropna(subset=PROXY_FEATURES)
    estimates = _predicted(ready, models).select(NODE, TIME, "_pm25", "_pm10", F.lit(True).alias("_filled"))
    joined = df.join(estimates, [NODE, TIME], "left")
    return joined.withColumns({
        "pm25": F.coalesce("pm25", "_pm25"), "pm10": F.coalesce("pm10", "_pm10"),
        "pm_gap_filled": F.coalesce("_filled", F.lit(False)),
    }).select(*[c for c in df.columns if c != "pm_gap_filled"], "pm_gap_filled")
