"""Nearest sites and point-in-polygon without pairing everything with everything."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from vayuspark.functions.geo import DEGREE_KM, EARTH_KM, equirect_km, haversine_km, location_hash
from vayuspark.operators.blocks import running_before
from vayuspark.session import cut_lineage
from vayuspark.vocab import DEDUPE_KM, GRID_BOX, NEAREST_KM

CELL = 1 / 64      # degrees of the finest cell: at most a few hundred places at three decimals
LEVELS = 16        # every level doubles the cell; the last holds the whole globe
ROUND = 360 * 64   # cells of one way round


def _ix(x: Column) -> Column:
    return F.floor((x + 512) / CELL).cast("long")


def _gap(a: Column, b: Column) -> tuple[Column, Column]:
    """Least and greatest distance in degrees between two cell indices of one axis."""
    steps = F.abs(a - b)
    return F.greatest(steps - 1, F.lit(0)) * CELL, (steps + 1) * CELL


def _cos_range(ix: Column) -> tuple[Column, Column]:
    low, high = ix * CELL - 512, (ix + 1) * CELL - 512
    far = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))
    near = F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))
    return F.cos(F.radians(far)), F.cos(F.radians(near))


def _bounds(metric: str, pi, pj, si, sj) -> tuple[Column, Column]:
    """Least and greatest km between a point cell and a site cell (with a little slack)."""
    lat0, lat1 = _gap(pi, si)
    lon0, lon1 = _gap(pj, sj)
    pc0, pc1 = _cos_range(pi)
    if metric == "equirect":
        low = F.sqrt(lat0 * lat0 + F.pow(lon0 * pc0, 2)) * DEGREE_KM
        high = F.sqrt(lat1 * lat1 + F.pow(lon1 * pc1, 2)) * DEGREE_KM
    else:
        sc0, sc1 = _cos_range(si)
        half = lambda d: F.pow(F.sin(F.radians(F.least(d, F.lit(180.0))) / 2), 2)
        a0 = half(lat0) + pc0 * sc0 * half(lon0)
        a1 = half(lat1) + pc1 * sc1 * half(lon1)
        km = lambda a: 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
        around = lon1 > 180
        beyond = lon0 > 180     # the copy of the site on the other side is closer
        low = F.when(beyond, F.lit(float("inf"))).when(around, F.lit(0.0)).otherwise(km(a0))
        high = F.when(around, F.lit(math.pi * EARTH_KM)).otherwise(km(a1))
    return low * 0.999999 - 1e-6, high * 1.000001 + 1e-6


def _levels(df: DataFrame, i: str, j: str) -> DataFrame:
    """Every cell under the number of each cell that encloses it."""
    size = F.pow(F.lit(2.0), F.col("level")).cast("long")
    return df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumns({
        "ci": F.floor(F.col(i) / size), "cj": F.floor(F.col(j) / size),
    })


def _candidates(pc: DataFrame, sc: DataFrame, metric: str, max_km: float | None) -> DataFrame:
    """(pi, pj, si, sj): for every occupied point cell the site cells that can hold its nearest site.

    Both sides are distinct cells, so their number is bounded by geography, not by the tables. A first
    bound comes from any site that shares an enclosing cell; cells farther than the bound drop out.
    """
    cols = [F.col(c) for c in ("pi", "pj", "si", "sj")]
    low, high = _bounds(metric, *cols)
    pyramid = _levels(sc, "si", "sj")
    # any one site cell per enclosing cell, packed in one number so that it is aggregated by hash
    packed = F.min(F.shiftleft("si", 32) + F.col("sj")).alias("s")
    one_site = pyramid.groupBy("level", "ci", "cj").agg(packed).select(
        "level", "ci", "cj", F.shiftright("s", 32).alias("si"), F.col("s").bitwiseAND(2**32 - 1).alias("sj")
    )
    reach = F.min(high)
    if max_km is not None:
        reach = F.least(reach, F.lit(float(max_km)))
    first = (
        _levels(pc, "pi", "pj").join(one_site, ["level", "ci", "cj"])
        .groupBy("pi", "pj").agg(reach.alias("reach"))
    )
    # the level whose cell is at least as wide as the reach: its 3 x 3 block covers the reach
    cos_near = F.cos(F.radians(F.least(F.abs(F.col("pi") * CELL - 512) + CELL + F.col("reach") / 111.0, F.lit(89.9))))
    sine = F.sin(F.least(F.col("reach") / (2 * EARTH_KM), F.lit(math.pi / 2))) / cos_near
    wide = F.degrees(2 * F.asin(F.least(sine, F.lit(1.0)))) if metric == "haversine" else F.col("reach") / DEGREE_KM / cos_near
    degrees = F.greatest(wide, F.col("reach") / 111.0) * 1.001
    level = F.least(F.greatest(F.ceil(F.log2(degrees / CELL)), F.lit(0)), F.lit(LEVELS)).cast("int")
    size = F.pow(F.lit(2.0), F.col("level")).cast("long")
    around = F.sequence(F.lit(-1), F.lit(1))
    blocks = (
        first.withColumn("level", level)
        .withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around))
        .withColumns({"ci": F.floor(F.col("pi") / size) + F.col("_i"), "cj": F.floor(F.col("pj") / size) + F.col("_j")})
    )
    pairs = blocks.join(pyramid, ["level", "ci", "cj"]).select(*cols, "reach", low.alias("low"), high.alias("high"))
    pairs = pairs.where(F.col("low") <= F.col("reach"))
    best = pairs.groupBy("pi", "pj").agg(F.min("high").alias("best"))
    return pairs.join(best, ["pi", "pj"]).where(F.col("low") <= F.col("best")).select("pi", "pj", "si", "sj")


def nearest(
    points: DataFrame, sites: DataFrame, order: str, metric: str = "haversine", max_km: float | None = None,
) -> DataFrame:
    """Nearest site of every point: (point columns, `site` struct, `km`); ties go to the least `order`.

    Points and sites at one coordinate are taken once, so repeated places cost nothing. The result has
    one row per point that has a site (within `max_km`).
    """
    where = points.select("lat", "lon").distinct()
    others = [c for c in sites.columns if c not in ("lat", "lon")]
    at = sites.groupBy("lat", "lon").agg(F.min_by(F.struct(*others), F.col(order)).alias("_s")).select(
        F.col("lat").alias("slat"), F.col("lon").alias("slon"), "_s"
    )
    left = where.withColumns({"pi": _ix(F.col("lat")), "pj": _ix(F.col("lon"))})
    right = at.withColumns({"si": _ix(F.col("slat")), "sj": _ix(F.col("slon"))})
    if metric == "haversine":   # each site once more, a way round further, so that +-180 degrees is no edge
        shifted = F.when(F.col("slon") > 0, F.col("sj") - ROUND).otherwise(F.col("sj") + ROUND)
        right = right.withColumn("sj", F.explode(F.array("sj", shifted)))
    cells = _candidates(
        where.select(_ix(F.col("lat")).alias("pi"), _ix(F.col("lon")).alias("pj")).distinct(),
        right.select("si", "sj").distinct(),
        metric, max_km,
    )
    distance = equirect_km if metric == "equirect" else haversine_km
    km = distance(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    pairs = left.join(cells, ["pi", "pj"]).join(right, ["si", "sj"]).withColumn("km", km)
    if max_km is not None:
        pairs = pairs.where(F.col("km") <= max_km)
    site = F.struct(F.col("slat").alias("lat"), F.col("slon").alias("lon"), "_s.*")
    found = pairs.groupBy("lat", "lon").agg(
        F.min("km").alias("km"), F.min_by(site, F.struct("km", F.col(f"_s.{order}"))).alias("site")
    )
    return points.join(found, ["lat", "lon"], "inner")


def nearest_city(grid: DataFrame, cities: DataFrame) -> DataFrame:
    """Grid points with the name and state of the closest city and its distance."""
    return nearest(grid, cities, "city_order").withColumns(
        {"near": F.col("site.location_name"), "state": F.col("site.state")}
    ).drop("site")


def drop_near(grid: DataFrame, cities: DataFrame, km: float = DEDUPE_KM) -> DataFrame:
    """Grid points farther than `km` from every city."""
    return nearest_city(grid, cities).where(F.col("km") > km)


def nearest_node(points: DataFrame, nodes: DataFrame, max_km: float = NEAREST_KM) -> DataFrame:
    """Closest node within `max_km` per request; requests without one have no row."""
    return nearest(points, nodes, "location_hash", "equirect", max_km).select(
        *points.columns, F.col("site.location_hash").alias("location_hash"),
        F.col("site.location_name").alias("location_name"), "km",
    )


def lattice_axis(low: float, high: float, step: float) -> Column:
    """Cell centres along one axis."""
    count = math.ceil((high - low - step / 2) / step - 1e-9)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.round(F.lit(low + step / 2) + i * step, 4))


def lattice(rows: DataFrame, step: float, box: tuple = GRID_BOX) -> DataFrame:
    """The lattice of the box once per input row (pass one row per region)."""
    return rows.withColumn("lat", F.explode(lattice_axis(box[0], box[1], step))).withColumn(
        "lon", F.explode(lattice_axis(box[2], box[3], step))
    )


#: Bands of latitude, and segments of a scan line, by quantiles of the points.
BANDS, SEGMENTS = 256, 256


def _quantile_bucket(points: DataFrame, column: str, n: int):
    """A number from 0 to n - 1 that rises with the value, with about as many of the points' values in each bucket.

    The n - 1 edges are read once and become literals.
    """
    edges = points.agg(F.percentile_approx(column, [k / n for k in range(1, n)], 100 * n)).first()[0] or [0.0]
    known = F.array(*[F.lit(float(e)) for e in sorted(set(edges))])
    return lambda y: F.size(F.filter(known, lambda e: e <= y)).cast("long")


def clip_to_polygons(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points strictly inside the union of polygons (holes by parity).

    `edges`: polygon, x1, y1, x2, y2. Each latitude in use becomes a scan line: an edge meets it in one
    longitude, crossings of a polygon open and close in turn, and a running sum along the line says how
    many polygons cover a point. A border point is covered on one side only and drops out. The scan is
    done twice, with edges taken at their lower and at their upper end, so level borders drop out too.

    Edges and lines meet by bands of latitude that hold equally many lines, and the running sums are made of
    totals of segments of a line and sums inside a segment, so neither a narrow strip of points nor a
    single latitude with all of them is one task.
    """
    lines = cut_lineage(points.select("lat").distinct(), "lines")
    inside = cut_lineage(points.select("lat", "lon").distinct(), "places")
    band, segment = _quantile_bucket(lines, "lat", BANDS), _quantile_bucket(inside, "lon", SEGMENTS)
    spans = edges.withColumns({"_y0": F.least("y1", "y2"), "_y1": F.greatest("y1", "y2")}).where("_y0 < _y1")
    met = spans.withColumn("_b", F.explode(F.sequence(band(F.col("_y0")), band(F.col("_y1"))))).join(
        lines.withColumn("_b", band(F.col("lat"))), "_b"
    )
    x = F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    rules = {
        "lower": (F.col("lat") >= F.col("_y0")) & (F.col("lat") < F.col("_y1")),
        "upper": (F.col("lat") > F.col("_y0")) & (F.col("lat") <= F.col("_y1")),
    }
    for rule in rules.values():
        crossings = met.where(rule).select("polygon", "lat", x.alias("lon"))
        turn = F.row_number().over(Window.partitionBy("polygon", "lat").orderBy("lon")) % 2
        events = crossings.withColumn("step", F.when(turn == 1, F.lit(1)).otherwise(F.lit(-1)))
        marked = inside.withColumns({"step": F.lit(0), "point": F.lit(1)}).unionByName(
            events.select("lat", "lon", "step", F.lit(0).alias("point"))
        )
        # one row for each place, so that what lies before it is plain
        places = cut_lineage(marked.groupBy("lat", "lon").agg(F.sum("step").alias("step"), F.max("point").alias("point")), "scan")
        summed = running_before(places, ["lat"], segment(F.col("lon")), ["lon"], F.col("step"), "_left")
        inside = summed.where((F.col("point") == 1) & (F.col("_left") > 0) & (F.col("_left") + F.col("step") > 0)).select("lat", "lon")
    return points.join(inside, ["lat", "lon"], "left_semi")


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("location_hash", location_hash(F.col("lat"), F.col("lon")))
