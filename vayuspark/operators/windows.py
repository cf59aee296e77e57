"""Hourly series per node: spine, fills, trailing means, lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vayuspark.functions.calendar import as_ts, hour_number, hours
from vayuspark.operators.blocks import BLOCK, block_window, core_rows, running_before, with_halo
from vayuspark.vocab import AVERAGES, FILL_HOURS, WINDOW_HOURS

NODE, TIME = "location_hash", "timestamp"
BLOCK_HOURS = 24 * 28


def keep_last(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the highest order; equal order falls back to a row hash.

    A grouped maximum combines on the map side, so a key repeated in a third of the rows is no hot spot.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in (order or [])], F.xxhash64(*rest).alias("_tie"))
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def node_span(df: DataFrame) -> DataFrame:
    return df.groupBy(NODE).agg(F.min(TIME).alias("first_hour"), F.max(TIME).alias("last_hour"))


def hourly_spine(df: DataFrame) -> DataFrame:
    """Every hour from a node's first to its last; hours without a row carry nulls."""
    axis = node_span(df).select(
        NODE, F.explode(F.sequence("first_hour", "last_hour", F.expr("interval 1 hour"))).alias(TIME)
    )
    return axis.join(df, [NODE, TIME], "left")


def trailing_means(
    df: DataFrame, since=None, averages: dict[str, int] | None = None, names: dict[str, str] | None = None,
    block_hours: int = 24 * 14,
) -> DataFrame:
    """Mean of the last w hours by the clock, nulls skipped, from as many rows as there are.

    Reads one day before `since` so that the first means are whole, gives rows from `since` on.
    """
    windows, names = averages or WINDOW_HOURS, names or AVERAGES
    reach = max(windows.values()) - 1
    if since is not None:
        since = as_ts(since)
        df = df.where(F.col(TIME) >= since - hours(reach + 1))
    seconds = F.unix_timestamp(TIME)
    blocked = with_halo(df.withColumn("_sec", seconds), F.col("_sec"), block_hours * 3600, before=reach * 3600)
    w = block_window([NODE], "_sec")
    out = blocked.select(
        "*",
        *[
            F.avg(p).over(w.rangeBetween(-(h - 1) * 3600, 0)).alias(names[p])
            for p, h in windows.items()
        ],
    )
    out = core_rows(out).drop("_sec")
    return out if since is None else out.where(F.col(TIME) >= since)


def trailing_means_rows(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Row-counted twin of `trailing_means`; equal to it on a spine, where a row is an hour."""
    names = names or AVERAGES
    reach = max(WINDOW_HOURS.values()) - 1
    blocked = with_halo(df.withColumn("_hour", hour_number(F.col(TIME))), F.col("_hour"), BLOCK_HOURS, before=reach)
    w = block_window([NODE], "_hour")
    out = blocked.select(
        "*", *[F.avg(p).over(w.rowsBetween(-(h - 1), 0)).alias(names[p]) for p, h in WINDOW_HOURS.items()]
    )
    return core_rows(out).drop("_hour")


def with_position(df: DataFrame, keys: list[str] | None = None, out: str = "_pos") -> DataFrame:
    """0-based row number per node in time order, counted day by day."""
    day = F.floor(hour_number(F.col(TIME)) / 24)
    return running_before(df, keys or [NODE], day, [TIME], out=out)


def fill_forward(col: str, limit: int, w) -> Column:
    return F.last(col, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def fill_backward(col: str, limit: int, w) -> Column:
    return F.first(col, ignorenulls=True).over(w.rowsBetween(0, limit))


def fill(df: DataFrame, cols: list[str], forward: int = 0, backward: int = 0, hourly: bool = False) -> DataFrame:
    """Carry values forward over at most `forward` rows, then back over at most `backward` rows.

    The first nulls of a long gap are filled as well; the rest stay null. With `hourly` a row is known
    to be an hour (spine or payload axis), so its position needs no counting.
    """
    placed = df.withColumn("_pos", hour_number(F.col(TIME))) if hourly else with_position(df)
    blocked = with_halo(placed, F.col("_pos"), BLOCK_HOURS, before=forward, after=backward)
    w = block_window([NODE], "_pos")
    if forward:
        blocked = blocked.withColumns({c: fill_forward(c, forward, w) for c in cols})
    if backward:
        blocked = blocked.withColumns({c: fill_backward(c, backward, w) for c in cols})
    return core_rows(blocked).drop("_pos").select(*df.columns)


def ffill(df: DataFrame, cols: list[str], limit: int = FILL_HOURS, hourly: bool = False) -> DataFrame:
    return fill(df, cols, forward=limit, hourly=hourly)


def bfill(df: DataFrame, cols: list[str], limit: int = FILL_HOURS, hourly: bool = False) -> DataFrame:
    return fill(df, cols, backward=limit, hourly=hourly)


def interpolate_time(df: DataFrame, cols: list[str], limit: int = 3) -> DataFrame:
    """Linear in time between known neighbours, for the first `limit` nulls after a value.

    Nulls after the last value carry it on (same limit); nulls before the first stay null. The right
    neighbour may lie any distance away, so it is found per block first and then across blocks.
    """
    placed = with_position(df)
    out = placed.withColumn("_blk", F.floor(F.col("_pos") / BLOCK_HOURS))
    # first known value of every later block, from one row per (node, block)
    at = {c: F.when(F.col(c).isNotNull(), F.col("_pos")) for c in cols}
    knots = out.groupBy(NODE, "_blk").agg(
        *[F.min_by(TIME, at[c]).alias(f"_t_{c}") for c in cols], *[F.min_by(c, at[c]).alias(f"_v_{c}") for c in cols]
    )
    ahead = Window.partitionBy(NODE).orderBy("_blk").rowsBetween(1, Window.unboundedFollowing)
    knot_of = lambda c: F.when(F.col(f"_v_{c}").isNotNull(), F.struct(F.col(f"_t_{c}").alias("t"), F.col(f"_v_{c}").alias("v")))
    later = knots.select(NODE, "_blk", *[F.first(knot_of(c), ignorenulls=True).over(ahead).alias(f"_later_{c}") for c in cols])
    joined = out.join(later, [NODE, "_blk"], "left").drop("_blk")
    blocked = with_halo(joined, F.col("_pos"), BLOCK_HOURS, before=limit)
    w = block_window([NODE], "_pos")
    # From the end backwards the frame only grows, so the next value costs one pass over a block.
    back = w.rowsBetween(-limit, 0)
    fore = Window.partitionBy(NODE, BLOCK).orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    knot = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(TIME).alias("t"), F.col(c).alias("v"))) for c in cols}
    blocked = blocked.select(
        "*",
        *[F.last(knot[c], ignorenulls=True).over(back).alias(f"_left_{c}") for c in cols],
        *[F.last(knot[c], ignorenulls=True).over(fore).alias(f"_here_{c}") for c in cols],
    )
    filled = {}
    for c in cols:
        left = F.col(f"_left_{c}")
        right = F.coalesce(F.col(f"_here_{c}"), F.col(f"_later_{c}"))
        gone = F.unix_timestamp(TIME) - F.unix_timestamp(left["t"])
        span = F.unix_timestamp(right["t"]) - F.unix_timestamp(left["t"])
        line = left["v"] + (right["v"] - left["v"]) * gone / span
        filled[c] = F.coalesce(F.col(c), F.when(right.isNotNull(), line).otherwise(left["v"]))
    return core_rows(blocked.withColumns(filled)).select(*df.columns)


def lag_deltas(values: list[str], lags: list[int], w, name) -> list[Column]:
    """y[t-k] - y[t] on a spine."""
    return [(F.lag(v, k).over(w) - F.col(v)).alias(name(v, k)) for k in lags for v in values]


def rolling_deltas(values: list[str], widths: list[int], w, name) -> list[Column]:
    """Mean of the last k hours, nulls skipped, minus y[t], on a spine."""
    return [
        (F.avg(v).over(w.rowsBetween(-(k - 1), 0)) - F.col(v)).alias(name(v, k)) for k in widths for v in values
    ]
