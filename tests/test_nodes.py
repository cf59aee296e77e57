import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vayuspark.functions import geo, values
from vayuspark.operators import joins, nodes as nd, quality, spatial as sp
from vayuspark.vocab import CITIES


def brute(points, sites, metric):
    out = []
    for la, lo in points:
        best = None
        for i, (sa, so) in enumerate(sites):
            if metric == "equirect":
                km = 111.32 * math.hypot(sa - la, (so - lo) * math.cos(math.radians(la)))
            else:
                a = math.sin(math.radians(sa - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(sa)) * math.sin(math.radians(so - lo) / 2) ** 2
                km = 2 * 6371.0 * math.asin(min(1, math.sqrt(a)))
            if best is None or km < best[0] - 1e-9:
                best = (km, i)
        out.append(best)
    return out


@pytest.mark.parametrize("metric", ["haversine", "equirect"])
@pytest.mark.parametrize("spread", ["even", "hot"])
def test_nearest_equals_brute_force(spark, metric, spread):
    rng = np.random.default_rng(3)
    pts = np.column_stack([rng.uniform(-40, 60, 150), rng.uniform(-170, 170, 150)])
    sites = np.column_stack([rng.uniform(-60, 60, 40), rng.uniform(-170, 170, 40)])
    if spread == "hot":       # a third of all sites and points in one cell
        sites[:30] = [20, 70] + rng.uniform(0, 0.2, (30, 2))
        pts[:50] = [20, 70] + rng.uniform(0, 0.2, (50, 2))
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, lat double, lon double")
    s = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(sites)], "site int, lat double, lon double")
    got = {r["id"]: (r["km"], r["site"]["site"]) for r in sp.nearest(p, s, "site", metric).collect()}
    want = brute(pts, sites, metric)
    assert len(got) == len(pts)
    for i, (km, site) in enumerate(want):
        assert got[i][0] == pytest.approx(km, rel=1e-9) and got[i][1] == site


def test_nearest_around_the_globe(spark):
    """Places next to +-180 degrees and to the poles, and one site for half of the globe."""
    rng = np.random.default_rng(4)
    pts = np.column_stack([rng.uniform(-89, 89, 200), rng.uniform(-180, 180, 200)])
    pts[:60, 1] = rng.choice([-1, 1], 60) * rng.uniform(179, 180, 60)
    sites = np.column_stack([rng.uniform(-85, 85, 40), rng.uniform(-180, 180, 40)])
    sites[:20, 1] = rng.choice([-1, 1], 20) * rng.uniform(170, 180, 20)
    for own in (sites, sites[:1], np.array([[10.0, 170.0], [10.0, -179.9]])):
        p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate([*pts, (10, 179.95)])], "id int, lat double, lon double")
        s = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(own)], "site int, lat double, lon double")
        got = {r["id"]: (r["km"], r["site"]["site"]) for r in sp.nearest(p, s, "site").collect()}
        want = brute([*pts, (10, 179.95)], own, "haversine")
        assert len(got) == len(want)
        for i, (km, site) in enumerate(want):
            assert got[i][0] == pytest.approx(km, rel=1e-9) and got[i][1] == site


def test_nearest_node_limit(spark):
    node = spark.createDataFrame([("h", "x", 20.0, 75.0)], "location_hash string, location_name string, lat double, lon double")
    near, far = 20.0 + 149 / 111.32, 20.0 + 151 / 111.32
    pts = spark.createDataFrame([(1, near, 75.0), (2, far, 75.0)], "id int, lat double, lon double")
    assert [r["id"] for r in sp.nearest_node(pts, node).collect()] == [1]


def test_polygon_with_hole_overlap_and_border(spark):
    def ring(x0, y0, x1, y1):
        c = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        return [(*a, *b) for a, b in zip(c, c[1:])]

    edges = [("a", *e) for e in ring(0, 0, 4, 4) + ring(1, 1, 2, 2)] + [("b", *e) for e in ring(3, 3, 6, 6)] + [("c", *e) for e in ring(4, 0, 8, 2)]
    e = spark.createDataFrame([(p, *map(float, r)) for p, *r in edges], "polygon string, x1 double, y1 double, x2 double, y2 double")
    pts = {"in": (0.5, 0.5), "hole": (1.5, 1.5), "out": (9, 9), "both": (3.5, 3.5), "edge": (0, 2), "top": (2, 4), "corner": (0, 0), "hole edge": (1, 1.5), "b": (5, 5), "level": (0.5, 1.0), "seam": (4, 1)}
    df = spark.createDataFrame([(k, float(y), float(x)) for k, (x, y) in pts.items()], "k string, lat double, lon double")
    got = {r["k"] for r in sp.clip_to_polygons(df, e).collect()}
    assert got == {"in", "both", "b", "level", "seam"}       # the seam of two touching polygons is inside their union


def test_one_latitude_is_no_one_task(spark):
    """All points on one scan line: its rows are dealt into many segments, and the answer stays that of a plain scan."""
    n = 6_000
    df = spark.range(n).select(F.lit(2.0).alias("lat"), (F.pow(F.col("id") / n, 3.0) * 40).alias("lon"))
    ring = lambda p, a, b: [(p, a, 0.0, b, 0.0), (p, b, 0.0, b, 4.0), (p, b, 4.0, a, 4.0), (p, a, 4.0, a, 0.0)]
    spans = [(1.0, 3.0), (2.5, 7.0), (20.0, 33.0)]
    e = spark.createDataFrame([r for i, (a, b) in enumerate(spans) for r in ring(f"p{i}", a, b)], "polygon string, x1 double, y1 double, x2 double, y2 double")
    got = sorted(r["lon"] for r in sp.clip_to_polygons(df, e).collect())
    assert got == sorted(r["lon"] for r in df.collect() if any(a < r["lon"] < b for a, b in spans))
    segment = sp._quantile_bucket(df, "lon", sp.SEGMENTS)
    sizes = [r["count"] for r in df.groupBy("lat", segment(F.col("lon")).alias("s")).count().collect()]
    assert len(sizes) > 200 and max(sizes) < 5 * n / sp.SEGMENTS


def test_triangle_vertices(spark):
    e = spark.createDataFrame([("t", 0.0, 0.0, 4.0, 2.0), ("t", 4.0, 2.0, 0.0, 4.0), ("t", 0.0, 4.0, 0.0, 0.0)], "polygon string, x1 double, y1 double, x2 double, y2 double")
    df = spark.createDataFrame([("in", 2.0, 1.0), ("tip", 2.0, 4.0), ("past", 2.0, 5.0), ("before", 2.0, -1.0)], "k string, lat double, lon double")
    assert {r["k"] for r in sp.clip_to_polygons(df, e).collect()} == {"in"}


def test_lattice_size(spark):
    got = sp.lattice(spark.range(1).select("id"), 1.0).agg(F.count("*"), F.min("lat"), F.max("lat"), F.max("lon")).first()
    assert tuple(got) == (31 * 29, 7.0, 37.0, 96.5)
    fine = sp.lattice(spark.range(1).select("id"), 0.5).count()
    assert fine == len(np.arange(6.75, 37.5, 0.5)) * len(np.arange(68.25, 97.5, 0.5))


def test_build_nodes_city_wins(spark):
    grid = spark.createDataFrame([(28.5, 77.5), (25.5, 70.5)], "lat double, lon double")
    nodes = nd.build_nodes(nd.cities(spark), grid).collect()
    grids = [n for n in nodes if n["kind"] == "grid"]
    assert sum(n["kind"] == "city" for n in nodes) == len(CITIES) == 112
    assert [n["location_name"] for n in grids] == ["Grid 25.50N 70.50E (near Jodhpur)"]
    assert len({n["location_hash"] for n in nodes}) == len(nodes)


def test_hash_matches_md5(spark):
    import hashlib

    df = spark.createDataFrame([(28.6139, 77.2090), (10.0, 70.5)], "lat double, lon double")
    got = [r[0] for r in df.select(geo.location_hash(F.col("lat"), F.col("lon"))).collect()]
    assert got == [hashlib.md5(t.encode()).hexdigest()[:8] for t in ("28.614,77.209", "10.0,70.5")]


def test_bounding_box_and_places(spark):
    q = spark.createDataFrame([("delhi",), ("london",), ("nowhere",)], "query string")
    c = spark.createDataFrame(
        [("delhi", 1, "far", "51.5", "-0.13"), ("delhi", 2, "near", "28.61", "77.21"), ("delhi", 3, "later", "20", "77"), ("london", 1, "l", "51.5", "-0.13"), ("london", 2, "k", "24.86", "67.01")],
        "query string, rank int, display_name string, lat string, lon string",
    )
    got = {r["query"]: (r["status"], r["display_name"]) for r in joins.resolve_places(q, c).collect()}
    assert got == {"delhi": ("ok", "near"), "london": ("outside", None), "nowhere": ("none found", None)}


def test_search(spark):
    n = spark.createDataFrame(
        [("1", "Agra", "UP", "city"), ("2", "Grid near Agra", "UP", "grid"), ("3", "Pune", None, "city")],
        "location_hash string, location_name string, state string, kind string",
    ).withColumns({"lat": F.lit(1.0), "lon": F.lit(1.0)})
    got = [(r["query"], r["location_hash"]) for r in nd.search_nodes(n, [" AGRA ", "", "pu"], 12).orderBy("query", "place").collect()]
    assert got == [("agra", "1"), ("agra", "2"), ("pu", "3")]
    assert nd.search_nodes(n, ["  "]).count() == 0 and nd.search_nodes(n, []).count() == 0
    table = spark.createDataFrame([("Agra",), ("agra ",), (None,), ("g",), ("une",), ("near  agra",), ("UP",), ("xyz",)], "query string")
    hits = sorted((r["query"], r["place"], r["location_hash"]) for r in nd.search_nodes(n, table, 2).collect())
    assert hits == [("agra", 1, "1"), ("agra", 2, "2"), ("g", 1, "1"), ("g", 2, "2"), ("une", 1, "3"), ("up", 1, "1"), ("up", 2, "2")]


def test_search_looks_up_no_more_rows_than_its_limit(spark):
    """Texts made of common runs (the rarest three letters of many are in hundreds of names) against a plain search."""
    rows = [(f"h{i:04d}", f"Site {i * 7 % 1000:06d}" if i % 50 else None, f"State {i % 3}", "city" if i % 11 == 0 else "grid") for i in range(1500)]
    nodes = spark.createDataFrame(rows, "location_hash string, location_name string, state string, kind string").withColumns({"lat": F.lit(1.0), "lon": F.lit(1.0)})
    texts = sorted({f"{i:06d}"[i % 4:] for i in range(0, 1000, 3)} | {"000", "site 000", "site 0001", "e", "state 1", "nothing", "0000000", "site 000123 and more"})
    wanted = spark.createDataFrame([(t,) for t in texts], "query string")
    looked_up = {r["query"]: r["count"] for r in nd.text_hits(nodes, wanted, 5).groupBy("query").count().collect()}
    assert looked_up["000"] == looked_up["e"] == 5 and max(looked_up.values()) == 5
    plain = []
    for t in texts:
        hits = [r for r in rows if t in (r[1] or "").lower() or t in r[2].lower()]
        hits.sort(key=lambda r: (r[3] != "city", r[1] is not None, r[1] or "", r[0]))
        plain += [(t, r[0], k) for k, r in enumerate(hits[:5], 1)]
    assert sorted((r["query"], r["location_hash"], r["place"]) for r in nd.search_nodes(nodes, wanted, 5).collect()) == sorted(plain)


def test_training_nodes_stride(spark):
    n = spark.createDataFrame([(f"g{i:02d}", 7.0 + i, 70.0, "grid") for i in range(25)] + [("c", 1.0, 1.0, "city")], "location_hash string, lat double, lon double, kind string")
    assert sorted(r[0] for r in quality.training_nodes(n, 10).select("location_hash").collect()) == ["c", "g00", "g10", "g20"]


def test_too_few_rows_is_an_error(spark):
    df = spark.range(5).select(*[F.lit(1.0).alias(c) for c in ("temp_c", "humidity_pct", "wind_speed_ms", "aod")])
    with pytest.raises(Exception, match="fewer than 24"):
        quality.validate_ingestion(df).collect()
    with pytest.raises(ValueError, match="missing columns"):
        quality.validate_ingestion(df.drop("temp_c"))
    assert quality.validate_ingestion(df, 5).first()["coverage"] == 1.0


def test_density_needs_a_positive_height(spark):
    df = spark.createDataFrame([(1.0, 1000.0), (1.0, None)], "m double, h double")
    got = [r[0] for r in df.select(values.column_density_to_ug(F.col("m"), 46.0, F.col("h"))).collect()]
    assert got == [pytest.approx(46000.0), None]
    with pytest.raises(Exception, match="positive"):
        df.select(values.column_density_to_ug(F.col("m"), 46.0, F.lit(0.0))).collect()


def test_redact(spark):
    df = spark.range(1).select(F.create_map(F.lit("user"), F.lit("a"), F.lit("PASSWORD"), F.lit("b")).alias("m"))
    assert df.select(values.redact(F.col("m"))).first()[0] == {"user": "a", "PASSWORD": "***REDACTED***"}
