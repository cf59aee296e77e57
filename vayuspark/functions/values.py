"""Small numeric and map expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vayuspark.vocab import REDACTED, SATELLITE_SCALE, SENSITIVE_KEYS


def wind_vector(speed: Column, degrees: Column) -> tuple[Column, Column]:
    """(u, v) of the wind from the direction it blows from."""
    angle = F.radians(degrees)
    return -speed * F.sin(angle), -speed * F.cos(angle)


def log_positive(x: Column) -> Column:
    """log1p of the value cut at 0; null stays null."""
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def delta_to_conc(last_log: Column, delta: Column) -> Column:
    total = last_log + delta
    return F.when(total.isNotNull(), F.expm1(F.greatest(total, F.lit(0.0))))


def standardise(x: Column, mean: Column, std: Column) -> Column:
    return F.coalesce((x - mean) / std, F.lit(0.0))


def column_density_to_ug(mol_m2: Column, molar_mass: float, mixing_height: Column) -> Column:
    """mol/m2 spread over the mixing height, in ug/m3; a height of 0 or less is an error."""
    checked = F.when(mixing_height > 0, mixing_height).when(
        mixing_height <= 0, F.raise_error(F.lit("mixing height must be positive")).cast("double")
    )
    return mol_m2 * F.lit(molar_mass) / checked * F.lit(1e6)


def satellite_scale(variable: Column) -> Column:
    """Factor to the stored unit by product name; unknown products keep theirs."""
    out = None
    for name, factor in SATELLITE_SCALE.items():
        hit = F.lower(variable) == name
        out = F.when(hit, F.lit(factor)) if out is None else out.when(hit, F.lit(factor))
    return out.otherwise(F.lit(1.0))


def safe_divide(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den == 0, F.lit(default)).otherwise(num / den)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def redact(entries: Column) -> Column:
    """Map with the values of sensitive keys masked."""
    return F.transform_values(
        entries, lambda k, v: F.when(F.lower(k).isin(SENSITIVE_KEYS), F.lit(REDACTED)).otherwise(v)
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating NaN becomes null; done once where data enter."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}) if floats else df
