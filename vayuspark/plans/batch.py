"""The batch jobs over a folder of tables: ingest, refresh, forecast, score, prune, export.

Each job reads and writes whole tables by partition and can be run again after a failure: upserts and
inserts are keyed, so a repeated run leaves the tables as one run does.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vayuspark.functions.calendar import as_ts, days
from vayuspark.operators.features import hour_frame
from vayuspark.operators.nodes import build_nodes, cities
from vayuspark.operators.quality import mask_gap_filled_targets
from vayuspark.operators.serving import as_json, snapshot_lines
from vayuspark.operators.skill import RUN, SKILL_COLUMNS, evaluate_forecast_skill, pending_runs, skill_summary
from vayuspark.operators.spatial import clip_to_polygons, lattice
from vayuspark.operators.windows import NODE, TIME, keep_last
from vayuspark.plans.aqi import AQI_COLUMNS, refresh_aqi
from vayuspark.plans.artefacts import load_run, save_run
from vayuspark.plans.forecast import forecast_all
from vayuspark.plans.ingest import hours_from_payloads, ingest
from vayuspark.plans.promotion import challenge, champion, members_of
from vayuspark.plans.proxy import load_proxy, save_proxy, train_proxy
from vayuspark.plans.training import Settings, predictor, run_training
from vayuspark.session import cut_lineage
from vayuspark.sources.readers import load_observations
from vayuspark.sources.tables import backfill_write, insert_if_absent, prune, read_table, register_model, replace_table, upsert, upsert_nodes
from vayuspark.vocab import (
    AVERAGES, FORECAST_DAYS, MEMBERS, POLLUTANTS, RAW, RAW_DAYS, SUB_INDICES,
)

LOOKBACK_DAYS = 8


def _schema(text: str) -> T.StructType:
    """Schema from `name type` pairs, usable before a session exists."""
    out = T.StructType()
    for name, kind in (pair.split() for pair in text.split(", ")):
        out = out.add(name, kind)
    return out


def _doubles(names) -> str:
    return ", ".join(f"{n} double" for n in names)


SCHEMAS = {
    "raw_observations": _schema(
        f"{TIME} timestamp, {NODE} string, {_doubles(RAW)}, pm_gap_filled boolean, ingested_at timestamp, obs_date date"
    ),
    "aqi_computed": _schema(
        f"{TIME} timestamp, {NODE} string, {_doubles([*AVERAGES.values(), *SUB_INDICES.values()])}, aqi integer, "
        "prominent_pollutant string, aqi_category string, computed_at timestamp, obs_date date"
    ),
    "aqi_forecasts": _schema(
        f"{RUN} timestamp, forecast_target_time timestamp, {NODE} string, hours_ahead integer, {_doubles(POLLUTANTS)}, aqi integer, "
        "aqi_lower integer, aqi_upper integer, aqi_category string, prominent_pollutant string, "
        + ", ".join(f"aqi_{m} integer" for m in MEMBERS) + ", model_version string, run_date date"
    ),
    "forecast_skill": _schema(
        f"{RUN} timestamp, hours_ahead integer, n_nodes long, aqi_mae double, aqi_rmse double, aqi_bias double, "
        "category_accuracy double, persistence_aqi_mae double, pm25_mae double, model_version string, "
        "evaluated_at timestamp, run_date date"
    ),
    "model_registry": _schema("model_version string, card string, first_used_at timestamp, last_used_at timestamp"),
    "grid_nodes": _schema(
        f"{NODE} string, location_name string, state string, lat double, lon double, kind string, created_at timestamp"
    ),
}


class Tables:
    """The tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path(name), SCHEMAS[name])

    def replace(self, name: str, df: DataFrame) -> None:
        """For the two dimensions without a date."""
        replace_table(df, self.path(name))


def shaped(df: DataFrame, name: str) -> DataFrame:
    """Columns of the table in its types; missing ones as nulls."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]
    ])


def ingest_job(tables: Tables, weather: DataFrame, air: DataFrame, as_of: datetime, models: dict | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Land payloads, fill PM gaps, upsert the observed hours, refresh the index; returns the whole hourly frame."""
    out = ingest(weather, air, as_of, models)
    observed = out["observed"].withColumns({"ingested_at": as_ts(as_of), "obs_date": F.to_date(TIME)})
    upsert(tables.spark, tables.path("raw_observations"), shaped(observed, "raw_observations"), [TIME, NODE], ["ingested_at"], "obs_date")
    if nodes is not None:
        tables.replace("grid_nodes", upsert_nodes(tables.read("grid_nodes"), nodes, as_of))
    refresh_job(tables, as_of, as_of - timedelta(days=LOOKBACK_DAYS))
    return out["frame"]


def refresh_job(tables: Tables, as_of: datetime, since: datetime) -> None:
    """Work out the index again for every hour from `since` on. One day more is read, older folders are not."""
    recent = load_observations(tables.read("raw_observations"), as_ts(since), 1)
    rows = refresh_aqi(recent, since).withColumns({"computed_at": as_ts(as_of), "obs_date": F.to_date(TIME)})
    upsert(tables.spark, tables.path("aqi_computed"), shaped(rows.select(*AQI_COLUMNS, "computed_at", "obs_date"), "aqi_computed"), [TIME, NODE], ["computed_at"], "obs_date")


def forecast_job(
    tables: Tables, frame: DataFrame, as_of: datetime, predict: Callable[[DataFrame, DataFrame], DataFrame],
    members: list[str], weights: DataFrame, quantiles: DataFrame | None = None, card: DataFrame | None = None, version: str = "untrained",
) -> None:
    """Forecast every node with a whole window; a run that is stored already stays as it is."""
    if card is not None:
        tables.replace("model_registry", register_model(tables.read("model_registry"), card, as_of))
    rows = forecast_all(frame, as_of, predict, members, weights, quantiles, version).withColumn("run_date", F.to_date(RUN))
    insert_if_absent(tables.spark, tables.path("aqi_forecasts"), shaped(rows, "aqi_forecasts"), [RUN, "forecast_target_time", NODE], "run_date")


def skill_job(tables: Tables, as_of: datetime, rescore: bool = False) -> None:
    """Score the runs whose day has passed. Only the days from the first to the last of them are read of any table."""
    forecasts, scored = tables.read("aqi_forecasts"), tables.read("forecast_skill")
    past = forecasts.where(F.col("run_date") <= F.lit((as_of - timedelta(hours=25)).date()))
    first, last = pending_runs(past, scored, as_of, rescore).agg(F.to_date(F.min(RUN)), F.to_date(F.max(RUN))).first()
    if first is None:
        return
    runs = F.col("run_date").between(F.lit(first), F.lit(last))
    observed = F.col("obs_date").between(F.lit(first), F.lit(last + timedelta(days=2)))  # 24 hours from an issue late on the last day
    new = evaluate_forecast_skill(
        forecasts.where(runs), tables.read("aqi_computed").where(observed), tables.read("raw_observations").where(observed), scored.where(runs), as_of, rescore
    )
    rows = shaped(new.select(*SKILL_COLUMNS, as_ts(as_of).alias("evaluated_at"), F.to_date(RUN).alias("run_date")), "forecast_skill")
    if rescore:
        upsert(tables.spark, tables.path("forecast_skill"), rows, [RUN, "hours_ahead"], ["evaluated_at"], "run_date")
    else:
        insert_if_absent(tables.spark, tables.path("forecast_skill"), rows, [RUN, "hours_ahead"], "run_date")


def prune_job(tables: Tables, as_of: datetime, raw_days: int = RAW_DAYS, forecast_days: int = FORECAST_DAYS) -> dict[str, dict[str, int]]:
    """Rows dropped and kept of each table; a table that was never written has none."""
    return {
        name: prune(tables.spark, tables.path(name), column, partition, as_of, keep)
        for name, column, partition, keep in (
            ("raw_observations", TIME, "obs_date", raw_days), ("aqi_computed", TIME, "obs_date", raw_days),
            ("aqi_forecasts", RUN, "run_date", forecast_days),
        )
    }


def export_job(tables: Tables, as_of: datetime, out: str) -> None:
    """The dashboard snapshot as JSON lines, from the recent partitions only."""
    as_of_ts = as_ts(as_of)
    recent = tables.read("aqi_computed").where(F.col("obs_date") >= F.to_date(as_of_ts - days(6)))
    runs = tables.read("aqi_forecasts").where(F.col("run_date") >= F.to_date(as_of_ts - days(3)))
    scored = tables.read("forecast_skill").where(F.col("run_date") >= F.to_date(as_of_ts - days(8)))
    lines = snapshot_lines(recent, runs, tables.read("grid_nodes"), as_of, tables.read("model_registry"), skill_summary(scored, as_of))
    as_json(lines).write.mode("overwrite").text(out)


# ---- jobs that learn, and whole passes -----------------------------------------------------------

def nodes_job(tables: Tables, as_of: datetime, step: float = 1.0, edges: DataFrame | None = None) -> None:
    """Cities and the grid points away from them; with polygon edges only points inside."""
    spark = tables.spark
    grid = lattice(spark.range(1).select(F.lit(1).alias("region")), step).select("lat", "lon")
    if edges is not None:
        grid = clip_to_polygons(grid, edges).select("lat", "lon")
    tables.replace("grid_nodes", upsert_nodes(tables.read("grid_nodes"), build_nodes(cities(spark), grid), as_of))


def proxy_job(tables: Tables, obs: DataFrame | None = None) -> DataFrame:
    """Train and store the models that fill PM gaps; returns their holdout scores."""
    rows = tables.read("raw_observations") if obs is None else obs
    models, scores = train_proxy(mask_gap_filled_targets(rows) if "pm_gap_filled" in rows.columns else rows)
    save_proxy(models, tables.path("proxy_models"))
    return scores


def train_job(
    tables: Tables, as_of: datetime, settings: Settings | None = None, version: str | None = None, obs: DataFrame | None = None,
    nodes: DataFrame | None = None, members: list[str] = MEMBERS,
) -> DataFrame:
    """Train on the stored hours (or a history), store the run, and let it challenge the champion; returns the verdict."""
    obs = mask_gap_filled_targets(tables.read("raw_observations")) if obs is None else obs
    nodes = tables.read("grid_nodes") if nodes is None else nodes
    version = version or f"{as_of:%Y.%m.%d}"
    path = f"{tables.path('runs')}/{version}"
    save_run(run_training(obs, nodes, settings, version, members, "observations", as_of), path)
    return challenge(tables.spark, tables.root, path, obs, nodes, as_of)


def champion_forecast_job(tables: Tables, ahead: DataFrame, as_of: datetime) -> None:
    """Forecast with the champion: stored hours of the look-back, and `ahead`, the hourly frame with the covariates to come."""
    row = champion(tables.spark, tables.root)
    run = load_run(tables.spark, row["run"]) if row else None
    if run is None:
        raise ValueError("no champion: run the job train first")
    first = as_of - timedelta(days=2 * LOOKBACK_DAYS)
    stored = tables.read("raw_observations").where(F.col("obs_date") >= F.lit(first.date())).select(NODE, TIME, *RAW)
    both = keep_last(stored.withColumn("_new", F.lit(0)).unionByName(ahead.select(NODE, TIME, *RAW).withColumn("_new", F.lit(1))), [NODE, TIME], ["_new"]).drop("_new")
    frame = cut_lineage(hour_frame(both, tables.read("grid_nodes")), "frame")
    card = run.card.select("model_version", "card")
    forecast_job(tables, frame, as_of, predictor(run.models, run.spec, run.stds), members_of(run), run.weights, run.quantiles, card, row["model_version"])


def backfill_job(tables: Tables, weather: DataFrame, air: DataFrame, as_of: datetime, batches: int = 64, to_tables: bool = True) -> int:
    """A long history from payloads, kept by batches of nodes (those there already are skipped); returns how many were there.

    With `to_tables` the hours are also upserted and their index worked out.
    """
    rows = hours_from_payloads(weather, air).withColumn("batch", F.pmod(F.xxhash64(NODE), F.lit(batches)).cast("int"))
    rows = cut_lineage(rows, "history")
    there = backfill_write(tables.spark, rows, tables.path("history"))
    if to_tables:
        observed = rows.where(F.col(TIME) <= as_ts(as_of)).withColumns({"ingested_at": as_ts(as_of), "obs_date": F.to_date(TIME), "pm_gap_filled": F.lit(False)})
        upsert(tables.spark, tables.path("raw_observations"), shaped(observed, "raw_observations"), [TIME, NODE], ["ingested_at"], "obs_date")
        first = rows.agg(F.min(TIME)).first()[0]
        if first is not None:
            refresh_job(tables, as_of, first)
    return there


def all_job(tables: Tables, weather: DataFrame, air: DataFrame, as_of: datetime) -> None:
    """Ingest, forecast with the champion, score, prune; can be run again."""
    frame = ingest_job(tables, weather, air, as_of, load_proxy(tables.spark, tables.path("proxy_models")))
    champion_forecast_job(tables, frame, as_of)
    skill_job(tables, as_of)
    prune_job(tables, as_of)
