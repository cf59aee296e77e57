"""A trained run as a folder: models, scales, weights, quantiles, scores and card, for a job in another session.

The folder counts only with its list of models, which is written last; a save that died is written anew.
"""

from __future__ import annotations

import hashlib
from dataclasses import fields
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from vayuspark.plans.fits import side_by_side
from vayuspark.plans.training import Run, Settings, run_training
from vayuspark.session import shared_dir
from vayuspark.vocab import MEMBERS, POLLUTANTS

KINDS = {"huber": LinearRegressionModel, "gbt": GBTRegressionModel, "rf": RandomForestRegressionModel}
COMPLETE, MODELS = "complete", "member string, pollutant string"
TABLES = [f.name for f in fields(Run) if f.name != "models"]


def save_run(run: Run, path: str) -> None:
    spark = run.spec.sparkSession
    models = [partial(model.write().overwrite().save, f"{path}/models/{member}/{pollutant}") for (member, pollutant), model in run.models.items()]
    tables = [partial(getattr(run, name).write.mode("overwrite").parquet, f"{path}/{name}") for name in TABLES]
    side_by_side(spark, models + tables)
    spark.createDataFrame(list(run.models), MODELS).coalesce(1).write.mode("overwrite").parquet(f"{path}/{COMPLETE}")


def load_run(spark: SparkSession, path: str) -> Run | None:
    """The run, or None where no whole one is."""
    try:
        names = [(r["member"], r["pollutant"]) for r in spark.read.schema(MODELS).parquet(f"{path}/{COMPLETE}").collect()]
    except AnalysisException:
        return None
    names = [(m, p) for p in POLLUTANTS for m in MEMBERS if (m, p) in names]
    models = side_by_side(spark, [partial(KINDS[m].load, f"{path}/models/{m}/{p}") for m, p in names])
    return Run(models=dict(zip(names, models)), **{name: spark.read.parquet(f"{path}/{name}") for name in TABLES})


def _content(df: DataFrame) -> tuple:
    """A few numbers that change with any row."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first())


def run_path(obs: DataFrame, nodes: DataFrame, settings: Settings, version: str) -> str:
    """The folder of a run: named by its settings and by the rows of both tables."""
    key = hashlib.sha256(repr((settings, version, _content(obs), _content(nodes))).encode()).hexdigest()[:16]
    return f"{shared_dir(obs.sparkSession)}/trained-{key}"


def trained_anew(obs: DataFrame, nodes: DataFrame, settings: Settings, version: str) -> Run:
    """Train and store, whatever is there."""
    path = run_path(obs, nodes, settings, version)
    save_run(run_training(obs, nodes, settings, version), path)
    return load_run(obs.sparkSession, path)


def trained_once(obs: DataFrame, nodes: DataFrame, settings: Settings, version: str) -> Run:
    """The stored run of these settings over these rows; it is trained and stored if there is none."""
    return load_run(obs.sparkSession, run_path(obs, nodes, settings, version)) or trained_anew(obs, nodes, settings, version)
