"""Leakage-safe features of every node-hour, sample index, splits, scalers, tabular rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vayuspark.functions.calendar import as_ts, days, hour_number, hours, local_calendar
from vayuspark.functions.geo import unit_coordinates
from vayuspark.functions.values import log_positive, standardise, wind_vector
from vayuspark.operators.blocks import BLOCK, CORE, block_window, core_rows, running_before, with_halo
from vayuspark.operators.windows import (
    BLOCK_HOURS, NODE, TIME, fill_forward, keep_last, lag_deltas, rolling_deltas,
)
from vayuspark.vocab import (
    FILL_HOURS, FUTURE_FEATURES, HISTORY, HORIZON, LAGS, LOGGED, LOOKBACK, PAST_FEATURES, POLLUTANTS, RAW,
    ROLLS, TABULAR_FEATURES, WINDOW_HOURS,
)

LOGS = [f"log_{p}" for p in POLLUTANTS]
LAG_COLUMNS = [f"d_lag{k}_{p}" for k in LAGS for p in POLLUTANTS]
ROLL_COLUMNS = [f"d_roll{w}_{p}" for w in ROLLS for p in POLLUTANTS]
YDAY = [f"yday_{p}" for p in POLLUTANTS]
SEEN = [f"seen_{p}" for p in POLLUTANTS]
#: Hours of a block in which samples meet the hours around them.
SAMPLE_HOURS = 24 * 14
FRAME_COLUMNS = [NODE, TIME, "t", *PAST_FEATURES, *LAG_COLUMNS, *ROLL_COLUMNS, *YDAY, "valid_issue", "valid_sample"]


def _axis(obs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Gap-free hours of the known nodes with raw values, coordinates and the first hour.

    Row counts and spans come from one narrow pass; the join from the axis leaves unknown nodes out.
    """
    order = ["ingested_at"] if "ingested_at" in obs.columns else []
    rows = keep_last(obs.select(NODE, TIME, *RAW, *order), [NODE, TIME], order).select(NODE, TIME, *RAW)
    span = (
        obs.groupBy(NODE)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(TIME).alias("first_hour"), F.max(TIME).alias("last_hour"))
        .where(F.col("_rows") > LOOKBACK)
        .join(nodes.select(NODE, "lat", "lon"), NODE)
    )
    lat, lon = unit_coordinates(F.col("lat"), F.col("lon"))
    axis = span.select(
        NODE, lat.alias("lat_norm"), lon.alias("lon_norm"), hour_number(F.col("first_hour")).alias("_first"),
        hour_number(F.col("last_hour")).alias("_last"),
        F.explode(F.sequence("first_hour", "last_hour", F.expr("interval 1 hour"))).alias(TIME),
    )
    return axis.join(rows, [NODE, TIME], "left").withColumn("_hour", hour_number(F.col(TIME)))


def _feature_columns() -> dict[str, Column]:
    u, v = wind_vector(F.col("wind_speed_ms"), F.col("wind_dir_deg"))
    return {
        **{f"log_{c}": log_positive(F.col(c)) for c in LOGGED},
        "wind_u": u, "wind_v": v, "precip_log": log_positive(F.col("precip_mm")),
        "blh_log": log_positive(F.col("boundary_layer_m")), **local_calendar(F.col(TIME)),
    }


def _blocked(obs: DataFrame, nodes: DataFrame, before: int, after: int):
    w = block_window([NODE], "_hour")
    blocked = with_halo(_axis(obs, nodes), F.col("_hour"), BLOCK_HOURS, before=before + FILL_HOURS, after=after)
    filled = blocked.select(
        NODE, TIME, "_hour", "_first", "_last", BLOCK, CORE, "lat_norm", "lon_norm",
        *[fill_forward(c, FILL_HOURS, w).alias(c) for c in RAW],
    )
    return filled.withColumns(_feature_columns()), w


def engineer_features(obs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The 26 features of every hour of every known node with enough rows; nulls mark long gaps."""
    blocked, _ = _blocked(obs, nodes, 0, 0)
    return core_rows(blocked).select(NODE, TIME, (F.col("_hour") - F.col("_first")).alias("t"), *PAST_FEATURES)


def hour_frame(obs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Features, lag and rolling deltas, yesterday's logs and validity, all on one partitioning.

    `valid_issue`: a forecast can start here (168 whole hours up to t, covariates for t+1..t+24).
    `valid_sample`: the targets of t..t+24 are there as well.
    """
    blocked, w = _blocked(obs, nodes, LOOKBACK - 1, HORIZON)
    gap = lambda cols: F.greatest(*[F.col(c).isNull().cast("int") for c in cols])
    marked = blocked.withColumns({
        "_past_gap": gap(PAST_FEATURES), "_future_gap": gap(FUTURE_FEATURES), "_target_gap": gap(LOGS),
        "t": F.col("_hour") - F.col("_first"),
    })
    none = lambda c, a, b: F.sum(c).over(w.rowsBetween(a, b)) == 0
    issue = (
        (F.col("t") >= LOOKBACK - 1) & (F.col("_hour") + HORIZON <= F.col("_last"))
        & none("_past_gap", -(LOOKBACK - 1), 0) & none("_future_gap", 1, HORIZON)
    )
    rows = marked.select(
        NODE, TIME, BLOCK, CORE, "t", *PAST_FEATURES,
        *lag_deltas(LOGS, LAGS, w, lambda v, k: f"d_lag{k}_{v[4:]}"),
        *rolling_deltas(LOGS, ROLLS, w, lambda v, k: f"d_roll{k}_{v[4:]}"),
        *[F.lag(v, HORIZON).over(w).alias(f"yday_{v[4:]}") for v in LOGS],
        F.coalesce(issue, F.lit(False)).alias("valid_issue"),
        F.coalesce(issue & none("_target_gap", 0, HORIZON), F.lit(False)).alias("valid_sample"),
    )
    return core_rows(rows).select(*FRAME_COLUMNS)


# ---- samples -----------------------------------------------------------------------------------

def sample_index(frame: DataFrame, stride: int = 1, start=None, end=None, valid: str = "valid_sample") -> DataFrame:
    """Usable issue hours, every `stride`-th hour counted from the node's first."""
    rows = frame.where(F.col(valid) & (F.col("t") % stride == 0))
    rows = rows if start is None else rows.where(F.col(TIME) >= as_ts(start))
    rows = rows if end is None else rows.where(F.col(TIME) < as_ts(end))
    return rows.select(NODE, TIME, "t")


def chronological_splits(samples: DataFrame, val_days: int = 21, test_days: int = 35) -> DataFrame:
    """Add `split`: train | val | test by issue time; hours whose targets reach the next part have none."""
    newest = samples.agg(F.max(TIME).alias("m")).scalar()
    test = newest - days(test_days)
    val, gap, ts = test - days(val_days), hours(HORIZON), F.col(TIME)
    part = (
        F.when(ts >= test, "test").when((ts >= val) & (ts < test - gap), "val").when(ts < val - gap, "train")
    )
    return samples.withColumn("split", part)


def _draw(*parts) -> Column:
    """A number of 60 bits from the md5 of some texts: the same draw wherever md5 is known."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _as_text(c: str, kind: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind == "timestamp" else F.col(c).cast("string")


def subsample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (all when there are fewer): those with the lowest seeded hash of the key.

    The cut is found by counting hash ranges, so nothing is sorted in one task.
    """
    kinds = dict(df.dtypes)
    hashed = df.withColumn("_h", _draw(*[_as_text(k, kinds[k]) for k in keys], F.lit(str(seed))))
    placed = running_before(hashed, [], F.shiftright("_h", 46), ["_h", *keys], out="_rank")
    return placed.where(F.col("_rank") < n).drop("_h", "_rank")


def random_horizons(samples: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Add `leads`: k lead times per sample, uniform on 1..24, drawn with replacement from a hash."""
    draw = lambda i: (_draw(F.col(NODE), _as_text(TIME, "timestamp"), i.cast("string"), F.lit(str(seed))) % HORIZON + 1).cast("int")
    return samples.withColumn("leads", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), draw))


def all_horizons(samples: DataFrame) -> DataFrame:
    """Add `leads`: 1..24."""
    return samples.withColumn("leads", F.sequence(F.lit(1), F.lit(HORIZON)))


def _around(samples: DataFrame, frame: DataFrame, columns: list[str], before: int, after: int) -> DataFrame:
    """The samples with `_hours`, the frame's rows around them as (_hour, columns...), and `_at`, their own place in it from 0.

    Frame and samples go to blocks of hours in one exchange, the frame with the few hours that a neighbour's samples see. A
    block's hours are one array of bounded length; what a sample sees is cut out of it in place, so that no row is joined or
    moved for each hour seen. The frame has every hour of a node from its first to its last, as `hour_frame` gives it.
    """
    hour = hour_number(F.col(TIME))
    rows = with_halo(frame.select(NODE, F.struct(hour.alias("_hour"), *columns).alias("_row"), hour.alias("_pos")), F.col("_pos"), SAMPLE_HOURS, before, after)
    own = samples.select(NODE, F.floor(hour / SAMPLE_HOURS).alias(BLOCK), F.struct(hour.alias("_hour"), *[c for c in samples.columns if c != NODE]).alias("_sample"))
    both = rows.select(NODE, BLOCK, "_row").unionByName(own, allowMissingColumns=True)
    blocks = both.groupBy(NODE, BLOCK).agg(F.sort_array(F.collect_list("_row")).alias("_hours"), F.collect_list("_sample").alias("_samples"))
    whole = F.col("_hours")[F.size("_hours") - 1]["_hour"] - F.col("_hours")[0]["_hour"] + 1 == F.size("_hours")
    broken = F.raise_error(F.lit("the hours of a node in the frame must follow each other without gaps")).cast("boolean")
    blocks = blocks.where((F.size("_hours") > 0) & (F.size("_samples") > 0)).where(F.when(whole, True).otherwise(broken))
    each = blocks.select(NODE, BLOCK, "_hours", F.explode("_samples").alias("_s"))
    return each.select(NODE, *[F.col(f"_s.{c}") for c in samples.columns if c != NODE], BLOCK, "_hours", (F.col("_s._hour") - F.col("_hours")[0]["_hour"]).cast("int").alias("_at"))


def _seen(n: int) -> Column:
    """The last n hours up to t, fewer where the node has fewer."""
    first = F.greatest(F.col("_at") - (n - 1), F.lit(0))
    return F.slice("_hours", first + 1, F.col("_at") - first + 1)


def horizon_rows(samples: DataFrame, frame: DataFrame, base: list[str] | None = None) -> DataFrame:
    """(sample, horizon) with `last_p` at t, true log change `y_p`, `d_yday_p` and covariates at t+h.

    `seen_p`: the sum of the concentrations up to t that a trailing mean at t+h still covers, null if one of them is unknown.
    """
    base = base or []
    around = _around(samples.select(NODE, TIME, "leads"), frame, list(dict.fromkeys([*LOGS, *YDAY, *FUTURE_FEATURES, *base])), HISTORY - 1, HORIZON)

    def sums(p: str) -> Column:
        """At k the sum of the last k concentrations."""
        longer = lambda acc, row: F.concat(acc, F.array(F.element_at(acc, -1) + F.expm1(row[f"log_{p}"])))
        return F.aggregate(F.reverse(_seen(WINDOW_HOURS[p] - 1)), F.array(F.lit(0.0)), longer).alias(f"_sums_{p}")

    at_issue = F.get("_hours", F.col("_at"))
    wide = around.select(
        NODE, TIME, BLOCK, at_issue.alias("_now"), *[sums(p) for p in POLLUTANTS],
        F.explode(F.transform("leads", lambda h: F.struct(h.alias("horizon"), F.get("_hours", (F.col("_at") + h).cast("int")).alias("x")))).alias("_then"),
    ).where(F.col("_now").isNotNull() & F.col("_then.x").isNotNull())
    now, then, lead = F.col("_now"), F.col("_then.x"), F.col("_then.horizon")
    return wide.select(
        NODE, TIME, BLOCK, lead.alias("horizon"), (F.col(TIME) + hours(lead)).alias("target"), *[now[c].alias(c) for c in base],
        *[now[f"log_{p}"].alias(f"last_{p}") for p in POLLUTANTS],
        *[(then[f"log_{p}"] - now[f"log_{p}"]).alias(f"y_{p}") for p in POLLUTANTS],
        *[(then[f"yday_{p}"] - now[f"log_{p}"]).alias(f"d_yday_{p}") for p in POLLUTANTS],
        *[then[c].alias(f"fut_{c}") for c in FUTURE_FEATURES],
        *[F.get(f"_sums_{p}", F.greatest(F.lit(WINDOW_HOURS[p]) - lead, F.lit(0)).cast("int")).alias(f"seen_{p}") for p in POLLUTANTS],
    )


def tabular_features(samples: DataFrame, frame: DataFrame, spec: DataFrame | None = None) -> DataFrame:
    """85 columns per (sample, horizon) plus the targets; with `spec` past and covariates are standardised."""
    base = PAST_FEATURES + LAG_COLUMNS + ROLL_COLUMNS
    rows = horizon_rows(samples, frame, base)
    if spec is not None:
        rows = standardise_frame(rows, spec)
    rows = rows.withColumn("horizon_h", F.col("horizon").cast("double"))
    features = [F.col("horizon_h" if c == "horizon" else c) for c in TABULAR_FEATURES]
    return rows.select(
        NODE, TIME, F.col("horizon").alias("lead"), *[c.alias(n) for c, n in zip(features, TABULAR_FEATURES)],
        *[f"last_{p}" for p in POLLUTANTS], *[f"y_{p}" for p in POLLUTANTS], BLOCK, *SEEN,
    )


# ---- scaling -----------------------------------------------------------------------------------

def _spread(x: Column) -> Column:
    return F.when(x >= 1e-6, x).otherwise(F.lit(1.0))


def fit_scaler(samples: DataFrame, frame: DataFrame) -> DataFrame:
    """(part, feature, mean, std): past features at t, covariates at t+1, nulls skipped."""
    def stats(rows, columns, part):
        wide = rows.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns])
        long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns])).alias("x"))
        return long.select(F.lit(part).alias("part"), "x.feature", "x.s.mean", _spread(F.col("x.s.std")).alias("std"))

    at_t = frame.join(samples.select(NODE, TIME), [NODE, TIME], "left_semi")
    following = samples.select(NODE, (F.col(TIME) + hours(1)).alias(TIME))
    at_next = frame.join(following, [NODE, TIME], "left_semi")
    return stats(at_t, PAST_FEATURES, "past").unionByName(stats(at_next, FUTURE_FEATURES, "future"))


def target_std(rows: DataFrame) -> DataFrame:
    """(horizon, pollutant, std) of the log changes."""
    wide = rows.groupBy("horizon").agg(*[_spread(F.stddev_pop(f"y_{p}")).alias(p) for p in POLLUTANTS])
    return wide.unpivot("horizon", POLLUTANTS, "pollutant", "std")


def standardise_frame(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """(x - mean) / std, null -> 0, for past features and `fut_` covariates that `rows` has.

    The 42 learnt pairs are read once and become literals.
    """
    pairs = {(s["part"], s["feature"]): (s["mean"], s["std"]) for s in spec.collect()}
    names = [("past", f, f) for f in PAST_FEATURES] + [("future", f, f"fut_{f}") for f in FUTURE_FEATURES]
    columns = set(rows.columns)
    return rows.withColumns({
        n: standardise(F.col(n), *[F.lit(v).cast("double") for v in pairs[part, f]])
        for part, f, n in names if n in columns
    })


# ---- windows per sample ------------------------------------------------------------------------

def past_matrix(samples: DataFrame, frame: DataFrame, patch: int | None = None) -> DataFrame:
    """168 ordered rows of past features per sample, optionally cut into patches of some hours."""
    around = _around(samples.select(NODE, TIME), frame, PAST_FEATURES, LOOKBACK - 1, 0).where(F.get("_hours", F.col("_at")).isNotNull())
    matrix = around.select(NODE, TIME, F.transform(_seen(LOOKBACK), lambda r: F.array(*[r[c] for c in PAST_FEATURES])).alias("past"))
    if patch:
        cut = lambda i: F.flatten(F.slice(F.col("past"), i * patch + 1, F.lit(patch)))
        matrix = matrix.withColumn("past", F.transform(F.sequence(F.lit(0), F.lit(LOOKBACK // patch - 1)), cut))
    return matrix


def history_conc(samples: DataFrame, frame: DataFrame, last_hours: int = HISTORY) -> DataFrame:
    """Concentrations of the last hours up to t: (node, issue time, step <= 0, six values)."""
    around = _around(samples.select(NODE, TIME), frame, LOGS, last_hours - 1, 0).where(F.get("_hours", F.col("_at")).isNotNull())
    rows = around.select(NODE, TIME, F.size(_seen(last_hours)).alias("_n"), F.posexplode(_seen(last_hours)).alias("_i", "_row"))
    return rows.select(NODE, TIME, (F.col("_i") - F.col("_n") + 1).alias("step"), *[F.expm1(F.col("_row")[f"log_{p}"]).alias(p) for p in POLLUTANTS])
