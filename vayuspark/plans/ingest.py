"""One ingestion pass over landed payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vayuspark.operators.joins import join_weather_air, patch_columns
from vayuspark.operators.quality import complete_schema, split_observed_future, standardise_units
from vayuspark.operators.windows import NODE, TIME, fill
from vayuspark.plans.aqi import refresh_aqi
from vayuspark.plans.proxy import fill_pm_gaps
from vayuspark.session import cut_lineage
from vayuspark.sources.readers import explode_hourly
from vayuspark.vocab import AIR_NAMES, FILL_HOURS, RAW, WEATHER_NAMES


def hours_from_payloads(weather: DataFrame, air: DataFrame) -> DataFrame:
    """Payload objects of both feeds -> one row per node and hour in our units, short dropouts filled."""
    joined = join_weather_air(explode_hourly(weather, WEATHER_NAMES), explode_hourly(air, AIR_NAMES))
    whole = complete_schema(standardise_units(joined)).drop("pm_gap_filled").select(NODE, TIME, *RAW)
    return fill(whole, RAW, FILL_HOURS, FILL_HOURS)


def ingest(weather: DataFrame, air: DataFrame, as_of, models: dict | None = None) -> dict[str, DataFrame]:
    """`observed` rows to upsert, `frame` (observed and forecast hours, gap-filled PM) and `aqi` rows."""
    frame = cut_lineage(hours_from_payloads(weather, air), "hours")      # read by everything below
    observed, future = split_observed_future(frame, as_of)
    observed = fill_pm_gaps(observed, models)
    patched = patch_columns(frame, observed, ["pm25", "pm10"])
    return {
        "observed": observed, "future": future, "frame": patched,
        "aqi": refresh_aqi(observed.select(NODE, TIME, *RAW)),
    }
