"""Blending, intervals and scores of candidate forecasts.

A candidate is a set of columns `<name>_<pollutant>` of log changes next to the true ones, so that every
candidate is scored in the same pass over the same rows and no row is copied per model.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from vayuspark.functions.cpcb import category_index, half_even, prominent, settle, settled_index
from vayuspark.functions.values import delta_to_conc
from vayuspark.operators.blocks import BLOCK, exact_quantiles, order_bucket, running_before
from vayuspark.operators.features import SEEN
from vayuspark.operators.windows import NODE, TIME
from vayuspark.session import cut_lineage
from vayuspark.vocab import CLOSE_AQI, INTERVAL, MEMBERS, POLLUTANTS, PROMOTION_TOLERANCE, WINDOW_HOURS

KEYS = [NODE, TIME]
BASELINES = ["persistence", "seasonal_naive"]


def with_baselines(rows: DataFrame) -> DataFrame:
    """Persistence (no change) and the same hour of the day before as candidates."""
    return rows.withColumns({
        **{f"persistence_{p}": F.lit(0.0) for p in POLLUTANTS},
        **{f"seasonal_naive_{p}": F.col(f"d_yday_{p}") for p in POLLUTANTS},
    })


# ---- blend -------------------------------------------------------------------------------------

def simplex(n: int, step: float = 0.05) -> list[tuple[float, ...]]:
    """All weight tuples on the grid that sum to 1: last weight slowest, then the first, then the others."""
    units = round(1 / step)

    def parts(left: int, slots: int):
        if slots == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in parts(left - i, slots - 1):
                yield (i, *rest)

    order = sorted(parts(units, n), key=lambda w: (w[-1], *w[:-1]))
    return [tuple(round(i * step, 4) for i in w) for w in order]


#: Weight tuples of each pollutant that are tried in one pass.
TRIED = 7


def _errors(rows: DataFrame, members: list[str], wanted: dict[str, list[int]], grid: list[tuple[float, ...]]) -> dict:
    """{(pollutant, place in the grid): (mean error, its slope by each weight)} of some tuples, one row copy for each."""
    place = {p: k + 1 for k, p in enumerate(POLLUTANTS)}
    tried = F.array(*[
        F.struct(F.lit(place[p]).alias("p"), F.lit(i).alias("i"), *[F.lit(w).alias(m) for m, w in zip(members, grid[i])]) for p, some in wanted.items() for i in some
    ])
    each = rows.select("y", *members, F.explode(tried).alias("w"))
    own = each.select("w.p", "w.i", F.element_at("y", F.col("w.p")).alias("y"), *[F.element_at(m, F.col("w.p")).alias(f"x_{m}") for m in members], *[F.col(f"w.{m}").alias(f"w_{m}") for m in members])
    off = sum(F.col(f"w_{m}") * F.col(f"x_{m}") for m in members) - F.col("y")
    means = own.groupBy("p", "i").agg(F.avg(F.abs(off)).alias("mae"), *[F.avg(F.signum(off) * F.col(f"x_{m}")).alias(m) for m in members]).collect()
    return {(POLLUTANTS[r["p"] - 1], r["i"]): (r["mae"], [r[m] for m in members]) for r in means}


def search_weights(rows: DataFrame, members: list[str] = MEMBERS, step: float = 0.05) -> DataFrame:
    """(pollutant, member, weight, mae): the grid weights with the least mean error of the log change.

    The mean error is convex in the weights, so its value and slope at one tuple bound it from below at all others. Each pass
    works out a few tuples per pollutant, those with the lowest bounds, and ends when the bounds of all others are above the
    best error found: the result is that of the whole grid (231 tuples for three members), of which some 20 are tried.
    """
    spark, grid = rows.sparkSession, simplex(len(members), step)
    narrow = rows.select(F.array(*[f"y_{p}" for p in POLLUTANTS]).alias("y"), *[F.array(*[f"{m}_{p}" for p in POLLUTANTS]).alias(m) for m in members])
    narrow = cut_lineage(narrow, "weights")
    known: dict[str, dict[int, tuple[float, list[float]]]] = {p: {} for p in POLLUTANTS}
    start = [i for i, w in enumerate(grid) if max(w) == 1.0] + [min(range(len(grid)), key=lambda i: sum((x - 1 / len(members)) ** 2 for x in grid[i]))]
    wanted = {p: sorted(set(start)) for p in POLLUTANTS}
    while wanted:
        for (p, i), found in _errors(narrow, members, wanted, grid).items():
            known[p][i] = found
        wanted = {}
        for p, tried in known.items():
            tried = {i: x for i, x in tried.items() if x[0] is not None}
            if not tried:
                continue
            best, first = min((round(mae, 9), i) for i, (mae, _) in tried.items())
            bound = lambda i: max(mae + sum(g * (a - b) for g, a, b in zip(slope, grid[i], grid[k])) for k, (mae, slope) in tried.items())
            # an earlier tuple also counts when it is as good, a later one must be better by a 9th digit
            left = sorted((x, i) for i in range(len(grid)) if i not in tried and (x := bound(i)) < best + (6e-10 if i < first else -4e-10))
            if left:
                wanted[p] = [i for _, i in left[:TRIED]]
    out = []
    for p in POLLUTANTS:
        tried = [(round(mae, 9), i, mae) for i, (mae, _) in known[p].items() if mae is not None]
        _, i, mae = min(tried) if tried else (None, 0, None)
        out += [(p, m, w, mae) for m, w in zip(members, grid[i])]
    return spark.createDataFrame(out, "pollutant string, member string, weight double, mae double")


def blend(rows: DataFrame, weights: DataFrame, present: list[str] = MEMBERS, name: str = "ensemble") -> DataFrame:
    """Weighted mean over the members at hand, weights scaled to sum 1, all zero -> plain mean.

    The few learnt weights (pollutants x members) are read once and become literals.
    """
    known = {(w["pollutant"], w["member"]): w["weight"] for w in weights.collect()}
    out = {}
    for p in POLLUTANTS:
        share = [known.get((p, m), 0.0) for m in present]
        total = sum(share)
        share = [w / total for w in share] if total > 0 else [1 / len(present)] * len(present)
        out[f"{name}_{p}"] = sum(F.lit(w) * F.col(f"{m}_{p}") for w, m in zip(share, present))
    return rows.withColumns(out)


def residual_quantiles(rows: DataFrame, name: str = "ensemble") -> DataFrame:
    """(horizon, pollutant, q10, q90) of true minus predicted change, exact."""
    residuals = rows.select("horizon", *[(F.col(f"y_{p}") - F.col(f"{name}_{p}")).alias(p) for p in POLLUTANTS])
    long = residuals.unpivot("horizon", POLLUTANTS, "pollutant", "r")
    return exact_quantiles(long, ["horizon", "pollutant"], "r", list(INTERVAL), ["q10", "q90"])


def with_interval(rows: DataFrame, quantiles: DataFrame, name: str = "ensemble") -> DataFrame:
    """Candidates `lower` and `upper`: the prediction plus the residual quantiles of its lead time."""
    pick = lambda p, q: F.max(F.when(F.col("pollutant") == p, F.col(q)))
    wide = quantiles.groupBy("horizon").agg(
        *[pick(p, q).alias(f"_{q}_{p}") for p in POLLUTANTS for q in ("q10", "q90")]
    )
    joined = rows.join(F.broadcast(wide), "horizon", "left")      # 24 rows by construction
    return joined.withColumns({
        **{f"lower_{p}": F.col(f"{name}_{p}") + F.col(f"_q10_{p}") for p in POLLUTANTS},
        **{f"upper_{p}": F.col(f"{name}_{p}") + F.col(f"_q90_{p}") for p in POLLUTANTS},
    }).drop(*[f"_{q}_{p}" for p in POLLUTANTS for q in ("q10", "q90")])


# ---- index along the path ----------------------------------------------------------------------

def to_concentrations(rows: DataFrame, variants: list[str]) -> DataFrame:
    """(keys, step, `<variant>_<pollutant>`, `seen_<pollutant>`) concentrations from log changes; `truth` stands for `y`."""
    delta = lambda v, p: F.col(f"y_{p}" if v == "truth" else f"{v}_{p}")
    return rows.select(
        *KEYS, BLOCK, F.col("horizon").cast("int").alias("step"), *SEEN,
        *[delta_to_conc(F.col(f"last_{p}"), delta(v, p)).alias(f"{v}_{p}") for v in variants for p in POLLUTANTS],
    )


def path_index(forecast: DataFrame, variants: list[str]) -> DataFrame:
    """Unrounded index and prominent pollutant per variant along observed and forecast hours.

    A mean needs every hour of its window: the observed ones are `seen_<pollutant>`, the sum of those up to t that it covers,
    the others are rows of the path. The rows of a path come from one block, so they are where the window needs them.
    """
    w = Window.partitionBy(NODE, BLOCK, TIME).orderBy("step")

    def strict_mean(v: str, p: str) -> Column:
        width, c = WINDOW_HOURS[p], f"{v}_{p}"
        frame = w.rowsBetween(-(width - 1), 0)
        whole = F.count(c).over(frame) == F.least(F.col("step"), F.lit(width))
        return F.when(whole, (F.col(f"seen_{p}") + F.sum(c).over(frame)) / width)

    means = forecast.select("*", *[strict_mean(v, p).alias(f"_m_{v}_{p}") for v in variants for p in POLLUTANTS]).drop(BLOCK, *SEEN)
    subs = {(v, p): settled_index(f"_m_{v}_{p}", p) for v in variants for p in POLLUTANTS}
    tops = means.withColumns({
        **{f"_s_{v}_{p}": x for (v, p), x in subs.items()},
        # named twice on purpose: a shared expression gets its own generated method, also when the
        # sub-index columns themselves are pruned; one method for all of them is too big for the JIT
        **{f"{v}_raw": F.greatest(*[subs[v, p] for p in POLLUTANTS] * 2) for v in variants},
    })
    named = tops.withColumns({
        f"{v}_prominent": prominent({p: F.col(f"_s_{v}_{p}") for p in POLLUTANTS}, F.col(f"{v}_raw")) for v in variants
    })
    return named.drop(*[f"_{k}_{v}_{p}" for k in ("m", "s") for v in variants for p in POLLUTANTS])


def scored_paths(rows: DataFrame, names: list[str]) -> DataFrame:
    """Concentrations and index of the truth and of every candidate per (sample, step)."""
    variants = ["truth", *names]
    return path_index(to_concentrations(rows, variants), variants)


# ---- scores ------------------------------------------------------------------------------------

def _long(wide: DataFrame, names: list[str], fields: list[str], group: list[str]) -> DataFrame:
    each = F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), *[F.col(f"{n}__{f}").alias(f) for f in fields]) for n in names
    ]))
    return wide.select(*group, each.alias("x")).select(*group, "x.*")


def score_models(paths: DataFrame, names: list[str]) -> DataFrame:
    """Index MAE, RMSE, bias, category accuracy, share within 20, skill against persistence, per candidate."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    raws = paths.select(*[f"{n}_raw" for n in ("truth", *names)])
    rounded = raws.withColumns({f"_r_{n}": half_even(F.col(f"{n}_raw")) for n in ("truth", *names)})
    paths = rounded.withColumns({f"_c_{n}": category_index(F.col(f"_r_{n}")) for n in ("truth", *names)})
    for n in names:
        err = F.col(f"{n}_raw") - F.col("truth_raw")
        same = F.col(f"_c_{n}") == F.col("_c_truth")
        aggs += [
            F.avg(F.abs(err)).alias(f"{n}__aqi_mae"), F.sqrt(F.avg(err * err)).alias(f"{n}__aqi_rmse"),
            F.avg(err).alias(f"{n}__aqi_bias"), F.avg(same.cast("int")).alias(f"{n}__category_accuracy"),
            F.avg((F.abs(err) <= CLOSE_AQI).cast("int")).alias(f"{n}__within_{CLOSE_AQI}"),
        ]
    fields = ["aqi_mae", "aqi_rmse", "aqi_bias", "category_accuracy", f"within_{CLOSE_AQI}"]
    wide = paths.agg(*aggs).withColumn("_base", F.col("persistence__aqi_mae"))
    return _long(wide, names, fields, ["_base"]).withColumn(
        "skill", 1 - F.col("aqi_mae") / F.when(F.col("_base") != 0, F.col("_base"))
    ).drop("_base")


def score_horizons(paths: DataFrame, names: list[str]) -> DataFrame:
    """Index MAE per candidate and lead time, to 2 digits."""
    wide = paths.groupBy("step").agg(
        *[settle(F.avg(F.abs(F.col(f"{n}_raw") - F.col("truth_raw"))), 2).alias(f"{n}__aqi_mae") for n in names]
    )
    return _long(wide, names, ["aqi_mae"], ["step"])


def score_pollutants(paths: DataFrame, names: list[str]) -> DataFrame:
    """Concentration MAE, RMSE and skill per candidate and pollutant."""
    pairs = [(n, p) for n in names for p in POLLUTANTS]
    err = lambda n, p: F.col(f"{n}_{p}") - F.col(f"truth_{p}")
    wide = paths.agg(*[
        F.struct(F.avg(F.abs(err(n, p))).alias("mae"), F.sqrt(F.avg(err(n, p) * err(n, p))).alias("rmse")).alias(f"{n}__{p}")
        for n, p in pairs
    ])
    each = F.explode(F.array(*[
        F.struct(
            F.lit(n).alias("model"), F.lit(p).alias("pollutant"), F.col(f"{n}__{p}.mae").alias("mae"),
            F.col(f"{n}__{p}.rmse").alias("rmse"), F.col(f"persistence__{p}.mae").alias("base"),
        ) for n, p in pairs
    ]))
    return wide.select(each.alias("x")).select(
        "x.model", "x.pollutant", "x.mae", "x.rmse",
        (1 - F.col("x.mae") / F.when(F.col("x.base") != 0, F.col("x.base"))).alias("skill"),
    )


def interval_coverage(paths: DataFrame) -> DataFrame:
    """Share of hours whose true index lies between the two ends."""
    inside = F.col("truth_raw").between(F.col("lower_raw"), F.col("upper_raw"))
    return paths.agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("int")).alias("coverage"))


def best_model(scores: DataFrame, names: list[str], by: str = "aqi_mae") -> DataFrame:
    """The candidate with the least error; a tie goes to the one named first."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("model"))
    kept = scores.where(F.col("model").isin(names))
    return kept.agg(F.min_by(F.struct("model", by), F.struct(by, order)).alias("b")).select("b.*")


def normal_below(z: Column) -> Column:
    """Share of the normal law below z, relative error about 1e-7 (rational Chebyshev fit of erfc)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(fit[-1])
    for c in reversed(fit[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly) / 2
    return F.when(z <= 0, tail).otherwise(1 - tail)


def _exact_below(ranks: Column, w2: Column, n: Column) -> Column:
    """Chance that the signed ranks (given doubled, as an array) sum to at most w2 if every sign is a fair coin."""
    top = F.aggregate(ranks, F.lit(0).cast("long"), lambda a, r: a + r)
    start = F.transform(F.sequence(F.lit(0).cast("long"), top), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    # ways[s]: subsets of the ranks so far with sum s
    ways = F.aggregate(ranks, start, lambda ways, r: F.transform(ways, lambda x, s: x + F.when(s >= r, F.get(ways, (s - r).cast("int"))).otherwise(0.0)))
    below = F.aggregate(F.slice(ways, F.lit(1), (w2 + 1).cast("int")), F.lit(0.0), lambda a, x: a + x)
    return below / F.pow(F.lit(2.0), n)


def wilcoxon_less(errors: DataFrame, a: str, b: str, exact_below: int = 50) -> DataFrame:
    """Signed-rank test that `a` is less than `b` over paired rows.

    By the normal law with tie correction; for up to `exact_below` pairs by the exact law of the ranks (ties included).
    Equal differences (to 9 digits) share a rank and are counted before they are ranked; only differences of 0 drop out.
    """
    d = F.col(a) - F.col(b)
    # two numbers a pair, stored: the few of a small case are read again below
    pairs = cut_lineage(errors.select(d.alias("d"), F.round(F.abs(d), 9).alias("size")).where("d <> 0"), "pairs")
    sizes = pairs.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = running_before(sizes, [], order_bucket(F.col("size")), ["size"], F.col("n"), "before")
    rank = F.col("before") + (F.col("n") + 1) / 2
    n3 = F.pow(F.col("n").cast("double"), 3)
    total = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("up") * rank).alias("w_plus"),
        F.sum(n3 - F.col("n")).alias("_ties"),
    )
    few = pairs.limit(exact_below + 1).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    few = running_before(few, [], order_bucket(F.col("size")), ["size"], F.col("n"), "before")
    # ranks of at most exact_below + 1 pairs, used only if these are all pairs
    doubled = F.array_repeat((2 * F.col("before") + F.col("n") + 1).cast("long"), F.col("n").cast("int"))
    ranks = few.agg(F.flatten(F.collect_list(doubled)).alias("_ranks")).select(F.coalesce("_ranks", F.array().cast("array<bigint>")))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(F.when(var > 0, var))
    exact = _exact_below(F.col("_ranks"), F.round(F.col("w_plus") * 2).cast("long"), n)
    p = F.when(F.col("n") > exact_below, normal_below(F.col("z"))).when(F.col("n") > 0, exact)
    return total.withColumn("z", z).withColumn("_ranks", ranks.scalar()).select("n", "w_plus", "z", p.alias("p_value"))


def sample_errors(paths: DataFrame, names: list[str]) -> DataFrame:
    """Mean absolute index error per sample and candidate."""
    return paths.groupBy(*KEYS).agg(*[F.avg(F.abs(F.col(f"{n}_raw") - F.col("truth_raw"))).alias(n) for n in names])


def promote(candidate: DataFrame, champion: DataFrame | None, model: str = "ensemble") -> DataFrame:
    """Whether the candidate's index error is at most 2 % above the champion's; no champion -> yes."""
    cand = candidate.where(F.col("model") == model).select(F.col("aqi_mae").alias("candidate"))
    old = F.lit(None).cast("double")
    if champion is not None:
        old = champion.where(F.col("model") == model).agg(F.max("aqi_mae").alias("m")).scalar()
    joined = cand.withColumn("champion", old)
    fine = F.col("champion").isNull() | (F.col("candidate") <= F.col("champion") * PROMOTION_TOLERANCE)
    return joined.withColumn("promote", fine)
