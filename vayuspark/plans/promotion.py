"""The registry of trained runs: which one is the champion, and whether a candidate takes its place.

`champions` is a table that is only added to, a row for each change; its newest row points to the folder of the run in use.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, types as T

from vayuspark.operators import evaluate as ev, features as ft
from vayuspark.plans.artefacts import load_run
from vayuspark.plans.training import Run, predictor
from vayuspark.session import cut_lineage
from vayuspark.vocab import MEMBERS

CHAMPIONS = T.StructType().add("promoted_at", T.TimestampType()).add("model_version", T.StringType()).add("run", T.StringType()).add(
    "candidate", T.DoubleType()).add("champion", T.DoubleType()).add("card", T.StringType())


def champions(spark: SparkSession, registry: str) -> DataFrame:
    try:
        return spark.read.schema(CHAMPIONS).parquet(f"{registry}/champions")
    except AnalysisException:
        return spark.createDataFrame([], CHAMPIONS)


def champion(spark: SparkSession, registry: str) -> Row | None:
    """The row of the run in use; None before the first."""
    rows = champions(spark, registry).orderBy("promoted_at", "run", ascending=False).limit(1).collect()
    return rows[0] if rows else None


def members_of(run: Run) -> list[str]:
    return [m for m in MEMBERS if any(m == name for name, _ in run.models)]


def score_run(run: Run, samples: DataFrame, frame: DataFrame) -> DataFrame:
    """Scores of a stored run on any samples: its own scaler, members, scales and weights."""
    rows = predictor(run.models, run.spec, run.stds)(ft.all_horizons(samples), frame)
    blended = ev.with_baselines(ev.blend(rows, run.weights, members_of(run)))
    return ev.score_models(ev.scored_paths(blended, ["persistence", "ensemble"]), ["persistence", "ensemble"])


def challenge(spark: SparkSession, registry: str, run_path: str, obs: DataFrame, nodes: DataFrame, now: datetime) -> DataFrame:
    """(candidate, champion, promote): the champion is scored on the candidate's test hours, made ready with its own scaler.

    A candidate that is no worse by the tolerance, or that meets no usable champion, becomes the champion.
    """
    candidate = load_run(spark, run_path)
    if candidate is None:
        raise ValueError(f"no whole run in {run_path}")
    old = champion(spark, registry)
    deployed = load_run(spark, old["run"]) if old else None
    scores = None
    if deployed is not None:
        scores = score_run(deployed, candidate.test, cut_lineage(ft.hour_frame(obs, nodes), "frame"))
    verdict = cut_lineage(ev.promote(candidate.scores, scores), "verdict")
    row = verdict.first()
    if row["promote"]:
        card = candidate.card.first()
        new = [(now, card["model_version"], run_path, row["candidate"], row["champion"], card["card"])]
        spark.createDataFrame(new, CHAMPIONS).coalesce(1).write.mode("append").parquet(f"{registry}/champions")
    return verdict
