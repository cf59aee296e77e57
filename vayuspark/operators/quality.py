"""Units, schema, ranges and checks of incoming hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vayuspark.functions.calendar import as_ts, floor_hour, hours
from vayuspark.functions.geo import in_box
from vayuspark.operators.blocks import running_before
from vayuspark.vocab import COUNTRY_BOX, RAW, SATELLITE

CORE_WEATHER = ["temp_c", "humidity_pct", "wind_speed_ms"]
PROXY_CORE = ["aod", "temp_c", "humidity_pct"]


def standardise_units(df: DataFrame) -> DataFrame:
    """km/h -> m/s for wind, ug/m3 -> mg/m3 for CO."""
    factors = {"wind_speed_ms": 3.6, "co": 1000.0}
    return df.withColumns({c: F.col(c) / F.lit(f) for c, f in factors.items() if c in df.columns})


def complete_schema(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Missing measurement columns as nulls; the gap-fill flag defaults to false."""
    missing = [c for c in (expected or RAW) if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else df
    flag = F.col("pm_gap_filled") if "pm_gap_filled" in df.columns else F.lit(None).cast("boolean")
    return df.withColumn("pm_gap_filled", F.coalesce(flag, F.lit(False)))


def split_observed_future(df: DataFrame, as_of, ahead_hours: int = 48) -> tuple[DataFrame, DataFrame]:
    """Hours up to the floored clock, and the forecast hours of the next two days."""
    now = floor_hour(as_ts(as_of))
    ts = F.col("timestamp")
    return df.where(ts <= now), df.where((ts > now) & (ts <= now + hours(ahead_hours)))


def training_nodes(nodes: DataFrame, stride: int = 10) -> DataFrame:
    """All city nodes and every `stride`-th grid node in (lat, lon) order."""
    grid = nodes.where(F.col("kind") == "grid")
    placed = running_before(grid, [], F.floor(F.col("lat") * 20), ["lat", "lon", "location_hash"], out="_n")
    picked = placed.where(F.col("_n") % stride == 0).drop("_n")
    return nodes.where(F.col("kind") == "city").unionByName(picked)


def within_box(df: DataFrame, box: tuple = COUNTRY_BOX) -> DataFrame:
    return df.where(in_box(F.col("lat"), F.col("lon"), box))


def mask_gap_filled_targets(df: DataFrame) -> DataFrame:
    """PM values that a model filled are no training targets."""
    kept = ~F.coalesce(F.col("pm_gap_filled"), F.lit(False))
    return df.withColumns({c: F.when(kept, F.col(c)) for c in ("pm25", "pm10")})


def _need(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def validate_ingestion(df: DataFrame, min_rows: int = 24, sparse_below: float = 0.3) -> DataFrame:
    """Share of known values per satellite column and whether it is sparse; too few rows is an error."""
    _need(df, CORE_WEATHER, "ingested hours")
    present = [c for c in SATELLITE if c in df.columns]
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in present],
    )
    guarded = totals.withColumn(
        "n_rows",
        F.when(F.col("n_rows") >= min_rows, F.col("n_rows")).otherwise(
            F.raise_error(F.lit(f"fewer than {min_rows} hours")).cast("long")
        ),
    )
    return guarded.unpivot("n_rows", present, "variable", "coverage").withColumn(
        "sparse", F.col("coverage") < sparse_below
    )


def validate_proxy_input(df: DataFrame) -> DataFrame:
    """Rows that have at least one of AOD, temperature and humidity."""
    _need(df, PROXY_CORE, "gap-filling input")
    return df.dropna(how="all", subset=PROXY_CORE)


def proxy_input_counts(df: DataFrame) -> DataFrame:
    unusable = F.coalesce(*PROXY_CORE).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(unusable).alias("n_dropped"))


def training_rows(df: DataFrame) -> DataFrame:
    """Rows with AOD and both PM targets."""
    _need(df, ["aod", "pm25", "pm10"], "gap-filling training")
    return df.dropna(subset=["aod", "pm25", "pm10"])
