"""Embedding near-dedup by NN-descent.

Equal vectors are one node with a weight. Nodes are held as one byte a dimension while the neighbour graph is refined:

* the graph starts from `STARTS` rounds of buckets by random hyperplanes (as many as the label's size asks for; a bucket
  that is too large is dealt into parts at random);
* in each round every node brings its neighbours, and those it is a neighbour of, together; whichever of them are closer to
  each other than what their lists hold go into the lists (a neighbour's neighbours become neighbours);
* the rounds end when few lists change. Random vectors (see `audit`) are then held against all others; while too many of
  their links are missing, the lists are enlarged and the rounds go on. Where that does not do in `ENLARGED` turns, all
  vectors are compared in balls, which misses nothing.

Edges near the threshold are confirmed in double precision. A list whose entries are all over the threshold is saturated
and may hide links, to nodes of its own component and of others. Saturated nodes of different components are held against
each other in balls, of which the triangle inequality leaves out only what cannot be linked, and components with a link
are joined. Inside a component all pairs are compared, in tiles of blocks of a bounded number of nodes. So a group of any
size loses none of its links, and no task holds a whole group.

Defined results: a vector that is null, of no length, zero, or holds a null, NaN or infinite component, or that has no label, has
no links and is a component of its own, and so is a row without vec_id (component null, kept); vectors of unequal length
are never linked; rows with the same vec_id are one vector (the smallest by label and components) and get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as St
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vayuspark.llm.graph import components
from vayuspark.llm.tables import table, written

THRESHOLD = 0.93
#: What a cosine of the short form may be off.
SLACK = 0.03
NEIGHBOURS, STARTS, BUCKET, BEST = 12, 4, 48, 4
ROUNDS, CHANGED = 8, 0.01
AUDIT, RECALL, ENLARGED = 256, 0.99, 3
BLOCK, CENTRES = 128, 1024
_GROUP = ["label", "size"]


def _flat(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _codes(seed: int, rounds: int):
    """(node, label, size, code, signs): the short form, and for each round 24 signs against random hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, signs = [], []
            for vector in batch.column("vector"):
                v = np.array(vector.as_py())
                v = v / np.abs(v).max()
                v = v / np.sqrt(v @ v)
                codes.append(np.clip(np.rint(v * 127 / np.abs(v).max()), -127, 127).astype(np.int8).tobytes())
                planes = np.random.default_rng([seed, len(v)]).normal(size=(len(v), rounds * 24))
                bits = (v @ planes > 0).reshape(rounds, 24)
                signs.append((bits * (1 << np.arange(24))).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), batch.column("size"), pa.array(codes, pa.binary()), pa.array([s.tolist() for s in signs], pa.list_(pa.int32()))],
                names=["node", *_GROUP, "code", "signs"],
            )

    return run


def _unit(codes: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each group against each other: for each the `BEST` others that are closer than its list's last."""
    for batch in batches:
        one, two, sim = [], [], []
        for members in batch.column("members").to_pylist():
            if len(members) < 2:
                continue
            node = np.array([m["node"] for m in members])
            least = np.array([m["least"] for m in members], np.float32)
            v = _unit([m["code"] for m in members])
            s = v @ v.T
            np.fill_diagonal(s, -2)
            k = min(BEST, len(node) - 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            rows = np.repeat(np.arange(len(node)), k)
            top = top.ravel()
            # What is close enough to link is always passed on, however many there are.
            close = np.argwhere(s >= THRESHOLD - SLACK)
            rows, top = np.concatenate([rows, close[:, 0]]), np.concatenate([top, close[:, 1]])
            good = (s[rows, top] > least[rows]) & (node[rows] != node[top])
            one.append(node[rows[good]])
            two.append(node[top[good]])
            sim.append(s[rows, top][good])
        if one:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), pa.array(np.concatenate(sim))], names=["u", "v", "s"])


_EDGE = "u long, v long, s float"


def _gathered(groups: DataFrame, by: list[str]) -> DataFrame:
    """Groups of (node, code, least), of bounded size each, to better pairs."""
    packed = groups.groupBy(*by).agg(F.collect_list(F.struct("node", "code", "least")).alias("members"))
    return packed.select("members").mapInArrow(_meet, _EDGE)


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The k closest of each node."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("s", "v")), asc=False), 1, k)
    return edges.groupBy("u").agg(best.alias("near")).select("u", F.inline("near")).select("u", "v", "s")


def _start(codes: DataFrame, k: int, first: int, rounds: int) -> DataFrame:
    sizes = codes.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"))
    bits = F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(F.col("n") / BUCKET)))).cast("int")
    round_ = F.explode(F.sequence(F.lit(first), F.lit(first + rounds - 1))).alias("round")
    placed = codes.join(sizes.select(*_GROUP, bits.alias("bits")), _GROUP).select("node", *_GROUP, "code", "signs", "bits", round_)
    placed = placed.withColumn("bucket", F.expr("signs[round] & (shiftleft(1, bits) - 1)"))
    by = [*_GROUP, "round", "bucket"]
    parts = placed.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / (2 * BUCKET)).alias("parts"))
    dealt = placed.join(parts, by).withColumn("part", F.expr("pmod(xxhash64(node, round), parts)")).withColumn("least", F.lit(-2.0).cast("float"))
    return _lists(_gathered(dealt, [*by, "part"]), k)


def _refine(codes: DataFrame, graph: DataFrame, k: int, seed: int) -> DataFrame:
    """One round: each node brings its neighbours in both directions together."""
    both = graph.select(F.col("u").alias("centre"), F.col("v").alias("node")).unionAll(graph.select(F.col("v").alias("centre"), F.col("u").alias("node"))).distinct()
    # A node that very many lists hold brings them together in random parts of bounded size.
    degree = both.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / (4 * k)).alias("parts"))
    dealt = both.join(degree, "centre").withColumn("part", F.when(F.col("parts") > 1, F.expr(f"pmod(xxhash64(node, centre, {seed}), parts)")).otherwise(0))
    least = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low")).select(F.col("u").alias("node"), F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    known = codes.select("node", "code").join(least, "node", "left").withColumn("least", F.coalesce("least", F.lit(-2.0).cast("float")))
    better = _gathered(dealt.join(known, "node"), ["centre", "part"])
    return _lists(graph.unionAll(better), k)


def neighbour_graph(codes: DataFrame, k: int, first: int, graph: DataFrame | None = None) -> DataFrame:
    """(u, v, s): lists of k neighbours by NN-descent, from buckets of the rounds `first` and on, and from a graph if there is one."""
    start = _start(codes, k, first, STARTS)
    graph = written(start if graph is None else _lists(graph.unionAll(start), k), "graph")
    total = max(1, graph.count())
    for seed in range(ROUNDS):
        now = written(_refine(codes, graph, k, seed), "graph")
        new = now.join(graph, ["u", "v"], "left_anti").count()
        graph = now
        if new < CHANGED * total:
            break
    return graph


def _valid(embeddings: DataFrame) -> DataFrame:
    """(node, label, size, weight, vector) of each distinct usable vector, and its ids."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select("vec_id", "label", doubles.alias("vector")).where("vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & fine & some).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))


def _confirmed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose cosine in double precision is high enough."""
    one, two = (nodes.select(F.col("node").alias(k), F.col("vector").alias(f"x_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("x_a")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            a, b = _flat(batch.column("x_a"), float), _flat(batch.column("x_b"), float)
            total = lambda x: np.add.reduceat(x, ends - sizes) if len(ends) else x
            cosine = total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(cosine >= THRESHOLD))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x_a", "x_b").mapInArrow(run, "a long, b long")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of a tile the weight of those of the other block (or of its own, on the diagonal) it is linked with."""
    for batch in batches:
        nodes, links = [], []
        for row in batch.to_pylist():
            sides = [[m for m in row["members"] if m["block"] == b] for b in sorted({row["low"], row["high"]})]
            x = [np.array([m["vector"] for m in side], float) for side in sides]
            weight = [np.array([m["weight"] for m in side], np.int64) for side in sides]
            size = [np.sqrt((v * v).sum(axis=1)) for v in x if len(v)]
            if len(sides) == 1:
                linked = (x[0] @ x[0].T) / (size[0][:, None] * size[0]) >= THRESHOLD
                np.fill_diagonal(linked, False)
                found = [linked @ weight[0]]
            elif len(x[0]) and len(x[1]):
                linked = (x[0] @ x[1].T) / (size[0][:, None] * size[1]) >= THRESHOLD
                found = [linked @ weight[1], linked.T @ weight[0]]
            else:
                continue
            for side, counts in zip(sides, found, strict=True):
                nodes += [m["node"] for m in side]
                links += counts.tolist()
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64())], names=["node", "links"])


def count_links(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, links): the weight of all links of each node inside its component."""
    placed = found.join(nodes.select("node", "weight", "vector"), "node")
    blocks = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = placed.join(blocks, "component").withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    packed = each.groupBy("component", "low", "high").agg(F.collect_list(F.struct("node", "block", "weight", "vector")).alias("members"))
    return packed.select("low", "high", "members").mapInArrow(_tiles, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _blocked(batch: pa.RecordBatch, row: int, column: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The members of a group without their vectors, and the vectors as unit rows."""
    own = batch.column(column)[row].values
    x = _flat(own.field("vector"), float).reshape(len(own), -1)
    rest = [k.name for k in own.type if k.name != "vector"]
    return {k: own.field(k).to_numpy(zero_copy_only=False) for k in rest}, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ball, component, label, size, vector, radius): the mean direction of each ball's nodes and the largest angle to it."""
    for batch in batches:
        centres, radii = [], []
        for k in range(batch.num_rows):
            x = _blocked(batch, k, "members")[1]
            centre = x.sum(axis=0)
            if not np.abs(centre).max() > 1e-9:
                centre = x[0]
            centre = centre / np.sqrt(centre @ centre)
            centres.append(centre)
            radii.append(float(np.arccos(np.clip(x @ centre, -1, 1)).max()))
        same = ["ball", "component", *_GROUP]
        vectors = pa.array([c.tolist() for c in centres], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), vectors, pa.array(radii, pa.float64())], names=[*same, "vector", "radius"])


def _close_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of balls of different components, one of each block of a tile, that can hold a link by the triangle inequality."""
    reach = np.arccos(THRESHOLD) + 1e-6
    for batch in batches:
        one, two = [], []
        for k in range(batch.num_rows):
            have, x = _blocked(batch, k, "members")
            low, high = batch.column("low")[k].as_py(), batch.column("high")[k].as_py()
            a, b = np.flatnonzero(have["block"] == low), np.flatnonzero(have["block"] == high)
            angle = np.arccos(np.clip(x[a] @ x[b].T, -1, 1))
            radius, component, ball = have["radius"], have["component"], have["ball"]
            near = (angle <= reach + radius[a][:, None] + radius[b]) & (component[a][:, None] != component[b])
            i, j = np.nonzero(near)
            i, j = a[i], b[j]
            if low == high:
                i, j = i[ball[i] < ball[j]], j[ball[i] < ball[j]]
            one.append(ball[i])
            two.append(ball[j])
        if one:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one), pa.int64()), pa.array(np.concatenate(two), pa.int64())], names=["a", "b"])


def _bridges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two balls: each node of the one with the first of the other that it is linked with, and the reverse."""
    for batch in batches:
        one, two = [], []
        for k in range(batch.num_rows):
            (a, x), (b, y) = _blocked(batch, k, "members_a"), _blocked(batch, k, "members_b")
            linked = x @ y.T >= THRESHOLD
            i, j = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            one += [a["node"][i], a["node"][linked[:, j].argmax(axis=0)]]
            two += [b["node"][linked[i].argmax(axis=1)], b["node"][j]]
        if one:
            a, b = np.concatenate(one), np.concatenate(two)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def joined(nodes: DataFrame, found: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """The components, those joined between which nodes of `some` (else any nodes) have a link.

    Nothing is guessed: nodes of one component are dealt into balls of at most about `BLOCK`, pairs of balls of different
    components that can be close enough by the triangle inequality are compared whole, in double precision.
    """
    placed = nodes if some is None else nodes.join(some.select("node").distinct(), "node", "left_semi")
    placed = placed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).select("node", "component", *_GROUP, "vector")
    placed = written(placed, "placed")
    if placed.select("component").distinct().limit(2).count() < 2:
        return found
    blocks = placed.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = placed.join(blocks, "component").withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    balls = dealt.groupBy("component", "block").agg(F.min("node").alias("ball"), F.first("label").alias("label"), F.first("size").alias("size"), F.collect_list(F.struct("node", "vector")).alias("members"))
    balls = written(balls.select("ball", "component", *_GROUP, "members"), "balls")
    kept = [balls.schema[c] for c in ("ball", "component", *_GROUP)]
    schema = St.StructType([*kept, St.StructField("vector", St.ArrayType(St.DoubleType())), St.StructField("radius", St.DoubleType())])
    centres = written(balls.mapInArrow(_balls, schema), "centres")

    sizes = centres.groupBy(*_GROUP).agg(F.ceil(F.count(F.lit(1)) / CENTRES).alias("blocks"))
    each = centres.join(sizes, _GROUP).withColumn("block", F.expr("pmod(xxhash64(ball), blocks)"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    packed = each.groupBy(*_GROUP, "low", "high").agg(F.collect_list(F.struct("ball", "component", "block", "radius", "vector")).alias("members"))
    pairs = written(packed.select("low", "high", "members").mapInArrow(_close_balls, "a long, b long"), "near-balls")

    one, two = (balls.select(F.col("ball").alias(k), F.col("members").alias(f"members_{k}")) for k in "ab")
    bridges = pairs.join(one, "a").join(two, "b").select("members_a", "members_b").mapInArrow(_bridges, "a long, b long").distinct()
    return written(components(bridges.unionAll(found.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")


def saturated(graph: DataFrame, k: int) -> DataFrame:
    """Nodes whose whole list is as close as a link. Only between two of these can the lists have dropped a link: a node
    that is missing from a list stands behind k closer ones."""
    return graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low")).where((F.col("n") >= k) & (F.col("low") >= THRESHOLD - SLACK)).select(F.col("u").alias("node"))


def audit(nodes: DataFrame, found: DataFrame, most: int = AUDIT, seed: int = 11) -> float:
    """Share of the links of random nodes, by brute force over all nodes, that the components hold.

    Every audited node with links counts the same, however many it has. Nodes in components of more than `BLOCK` nodes are
    drawn and judged apart from the others (at most a quarter of `most`, as each has many links); the lower mean counts.
    """
    spark = nodes.sparkSession
    large = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("component")
    inside = written(found.join(large, "component", "left_semi").select("node"), "inside")
    drawn = []
    for how, n in (("left_anti", most), ("left_semi", max(1, most // 4))):
        drawn.append(nodes.join(inside, "node", how).select("node", "label", "size", "vector").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n).collect())
    crowd = {r["node"] for r in drawn[1]}
    shared = spark.sparkContext.broadcast(drawn[0] + drawn[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        for r in shared.value:
            groups.setdefault((r["label"], r["size"]), []).append(r)
        groups = {key: (np.array([r["node"] for r in own]), np.array([r["vector"] for r in own])) for key, own in groups.items()}
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist(), strict=True))
            node, a, b = batch.column("node").to_numpy(), [], []
            flat = _flat(batch.column("vector"), float)
            ends = np.cumsum([size for _, size in keys])
            for key, (ids, own) in groups.items():
                at = np.array([k for k, have in enumerate(keys) if have == key], np.int64)
                if len(at):
                    x = np.stack([flat[ends[k] - key[1] : ends[k]] for k in at.tolist()])
                    cosine = (own @ x.T) / (np.sqrt((own * own).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1)))
                    i, j = np.nonzero(cosine >= THRESHOLD)
                    a.append(ids[i])
                    b.append(node[at[j]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    pairs = nodes.mapInArrow(run, "a long, b long").where("a <> b")
    one, two = (found.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}")) for k in "ab")
    held = pairs.join(one, "a", "left").join(two, "b", "left").groupBy("a").agg(F.avg(F.when(F.col("c_a") == F.col("c_b"), 1.0).otherwise(0.0)).alias("share")).collect()
    shares: dict[bool, list[float]] = {}
    for r in held:  # as many rows as nodes were drawn
        shares.setdefault(r.a in crowd, []).append(r.share)
    return min((sum(own) / len(own) for own in shares.values()), default=1.0)


def near_duplicates(embeddings: DataFrame, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    usable = written(_valid(embeddings), "vectors")
    whole = ["label", "vector"]
    nodes = usable.groupBy(*whole).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    nodes = written(nodes.select("node", "label", F.size("vector").alias("size"), "weight", "vector"), "nodes")
    rounds = STARTS * (ENLARGED + 1)
    schema = St.StructType([nodes.schema["node"], nodes.schema["label"], nodes.schema["size"], St.StructField("code", St.BinaryType()), St.StructField("signs", St.ArrayType(St.IntegerType()))])
    codes = written(nodes.mapInArrow(_codes(seed, rounds), schema), "codes")
    graph, k = None, NEIGHBOURS
    for turn in range(ENLARGED + 1):
        graph = neighbour_graph(codes, k, turn * STARTS, graph)
        close = graph.where(F.col("s") >= THRESHOLD - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        found = written(components(_confirmed(close, nodes)), "components")
        found = joined(nodes, found, saturated(graph, k))
        if audit(nodes, found) >= RECALL:
            break
        k *= 2
    else:
        found = joined(nodes, found)  # the lists do not do: all nodes, exactly
    links = count_links(nodes, found)
    known = nodes.join(found, "node", "left").join(links, "node", "left").select(*whole, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    result = usable.join(known, whole).select(F.col("vec_id").alias("own"), "n_links", "component_id")
    out = embeddings.select("vec_id").join(result, F.col("vec_id") == F.col("own"), "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"))


def op7_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = r"""
with recursive v as (select vec_id, label, cast(embedding as double[]) x from embeddings),
u as (select * from v where label is not null and x is not null and len(x) > 0 and len(list_filter(x, lambda y: y is null or isnan(y) or isinf(y))) = 0 and len(list_filter(x, lambda y: y <> 0)) > 0),
p as (select a.vec_id a, b.vec_id b from u a join u b on a.label = b.label and a.vec_id < b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.93),
e as (select a u, b v from p union select b, a from p),
r as (select u node, u label from e union select e.v, r.label from r join e on e.u = r.node where r.label < e.v),
c as (select node, min(label) label from r group by node),
n as (select u, count(*) n from e group by u)
select v.vec_id, cast(coalesce(n.n, 0) as bigint) n_links, least(coalesce(c.label, v.vec_id), v.vec_id) component_id, least(coalesce(c.label, v.vec_id), v.vec_id) = v.vec_id kept
from v left join n on n.u = v.vec_id left join c on c.node = v.vec_id
"""
