"""MinHash near-dedup as a Hamming join of b-bit signatures.

A document's shingles (`words` consecutive lower-cased words) give `chunks` x `SYMBOLS` MinHash values of `BITS` bits. By the
pigeonhole principle two signatures that differ in at most chunks * (ERRORS + 1) - 1 values have a chunk with at most
`ERRORS` differing values; every way to leave out so many values of a chunk is a key, so such a pair always shares a key.
The number of chunks follows from the similarity: a pair at the threshold fails to share a key with a chance below `MISS`.
Links are confirmed on the full shingle sets (64-bit hashes of the shingles).

Groups of copies cost no pairs: equal sets are one node. Each node is first held against one hub alone, the node that meets most
others in its buckets (the text that copies were made from shares most keys with all of them). What remains are nodes of
different components, around one hub or with a common key. They are compared in tiles: the component that has most nodes of a
group is cut into blocks, and so are the other nodes; every two blocks of the others meet, and every block of the others meets
every block of the large component, which is not compared with itself. A tile returns what hangs together in it, not its pairs.

Nodes with a common key around different hubs are grouped by shingle: of two sets that are similar enough, with shingles from
rare to common, the first ones (as many as a set may lack of the other, and one more) have one in common. This holds for every
link, so it leaves none out; nodes whose rare shingles are all their own drop out without any comparison.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing; fewer words
than a shingle are one shingle, the whole sequence; a row without doc_id is its own class, component null, kept; rows
with the same doc_id count as one document, and what is similar to any of its texts is linked with it; further columns stay (the
operator's own replace columns of the same name).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as St
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vayuspark.llm import text as words_
from vayuspark.llm.graph import components
from vayuspark.llm.tables import table, written

SYMBOLS, ERRORS, BITS = 5, 1, 16
MISS = 1e-6
ROWS = 2048
#: Nodes and shingles of a block of a tile, columns of a product.
BLOCK, BLOCK_SHINGLES, COLUMNS = 128, 400_000, 8192


def chunks_for(percent: int) -> int:
    """Chunks so that a pair at the threshold misses every chunk with a chance below MISS."""
    differ = 1 - percent / 100
    good = sum(math.comb(SYMBOLS, k) * differ**k * (1 - differ) ** (SYMBOLS - k) for k in range(ERRORS + 1))
    return math.ceil(math.log(MISS) / math.log(1 - good))


def shingles(found: words_.Words, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, sorted."""
    wide = words_.window_hash(found.hash, words)
    for low, high in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if high - low >= words:
            yield np.unique(wide[low : high - words + 1])
        elif high > low:
            yield words_.window_hash(found.hash[low:high], high - low)
        else:
            yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    turn = words_.mix(np.arange(1, size + 1, dtype=np.uint64))
    factor = words_.mix(turn) | np.uint64(1)
    least = np.full(size, 2**64 - 1, np.uint64)
    for low in range(0, len(hashes), ROWS):
        least = np.minimum(least, ((hashes[low : low + ROWS, None] ^ turn) * factor).min(axis=0))
    return (words_.mix(least) >> np.uint64(64 - BITS)).astype(np.int32)


_SIGNED = [St.StructField("n_shingles", St.LongType()), St.StructField("s1", St.LongType()), St.StructField("s2", St.LongType()), St.StructField("sig", St.ArrayType(St.IntegerType()))]


def _signatures(words: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            n, s1, s2, sig = [], [], [], []
            for h in shingles(words_.words_of(piece.column("text"), lower=True), words):
                for column, value in zip((n, s1, s2), _sums(h), strict=True):
                    column.append(value)
                sig.append(signature(h, size))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(words_.signed(np.array(s1, np.uint64))), pa.array(words_.signed(np.array(s2, np.uint64))), words_.lists(np.concatenate(sig) if sig else np.zeros(0, np.int32), np.full(len(n), size), pa.int32())],
                names=["doc_id", "n_shingles", "s1", "s2", "sig"],
            )

    return run


_OTHER = np.uint64(0xA5A5A5A5A5A5A5A5)


def _sums(h: np.ndarray) -> tuple[int, np.uint64, np.uint64]:
    """Size and two sums that stand for a set."""
    return len(h), words_.mix(h).sum(dtype=np.uint64), words_.mix(h ^ _OTHER).sum(dtype=np.uint64)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            own = list(shingles(words_.words_of(piece.column("text"), lower=True), words))
            n, s1, s2 = zip(*map(_sums, own), strict=True)
            flat = np.concatenate(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), *(pa.array(words_.signed(np.array(x, np.uint64))) for x in (s1, s2)), words_.lists(words_.signed(flat), np.array(n, np.int64), pa.int64())], names=["n_shingles", "s1", "s2", "members"]
            )

    return run


def keys_of(nodes: DataFrame, chunks: int) -> DataFrame:
    """(key, at, node): for each chunk and each value left out, the hash of the values that remain; at: which of all values is left out."""
    keys = []
    for chunk in range(chunks):
        for out in range(SYMBOLS):
            kept = [F.col("sig")[chunk * SYMBOLS + k] for k in range(SYMBOLS) if k != out]
            keys.append(F.xxhash64(F.lit(chunk * SYMBOLS + out), *kept))
    return nodes.select("node", F.posexplode(F.array(*keys)).alias("at", "key"))


_WHOLE = ["n_shingles", "s1", "s2"]


class _Judge:
    """Confirms links on the full sets; only sizes and shingles that allow no link are left out before."""

    def __init__(self, docs: DataFrame, classes: DataFrame, nodes: DataFrame, involved: DataFrame, words: int, percent: int):
        """classes: n_shingles, s1, s2, node, least (the doc_id whose text is read for it)."""
        self.percent = percent
        self.nodes = nodes.select("node", "n_shingles")
        classes = classes.join(involved, "node", "left_semi")
        texts = docs.where("doc_id is not null").join(classes.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")
        if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
            texts = texts.dropDuplicates(["doc_id", "text"])
        found = texts.select("text").mapInArrow(_sets(words), St.StructType([*_SIGNED[:3], St.StructField("members", St.ArrayType(St.LongType()))]))
        self.sets = written(found.join(classes, _WHOLE).select("node", "members"), "sets")

    def to_hubs(self, hubs: DataFrame) -> DataFrame:
        """Links of nodes with their hubs."""
        pairs = hubs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        one, two = (self.nodes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}")) for k in "ab")
        near = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        left, right = (self.sets.select(F.col("node").alias(k), F.col("members").alias(f"m_{k}")) for k in "ab")
        full = near.select("a", "b").join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("m_a", "m_b")))
        union = F.size("m_a") + F.size("m_b") - F.col("shared")
        return written(full.where(F.col("shared") * 100 >= union * self.percent).select("a", "b"), "links")

    def inside(self, hubs: DataFrame, found: DataFrame) -> DataFrame:
        """Links among the nodes around one hub that are of different components."""
        groups = hubs.select(F.col("hub").alias("group"), "node").unionAll(hubs.select(F.col("hub").alias("group"), F.col("hub").alias("node"))).distinct()
        placed = groups.join(found, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component"))
        return self.links(written(placed, "around"))

    def across(self, members: DataFrame, hubs: DataFrame, found: DataFrame) -> DataFrame:
        """Links of nodes that share a key, are of different components and stand around different hubs."""
        placed = members.select("key", "node").join(found, "node", "left").join(hubs, "node", "left")
        placed = written(placed.select("key", "node", F.coalesce("component", "node").alias("component"), F.coalesce("hub", "node").alias("hub")), "placed")
        mixed = written(_mixed(placed, "key").select("key"), "several")
        nodes = written(placed.join(mixed, "key", "left_semi").select("node", "component", "hub").distinct(), "involved")
        first = written(self.first_shingles(nodes), "first")
        groups = written(_mixed(first, "group").select("group"), "several")
        return self.links(written(first.join(groups, "group", "left_semi").select("group", "node", "component"), "alike"))

    def first_shingles(self, nodes: DataFrame) -> DataFrame:
        """(group, node, component, hub): the shingles of each node, rare ones first, of which two similar nodes share one.

        Rare: in few of the given nodes. Shingles of one node alone come first and make no group.
        """
        each = written(self.sets.join(nodes, "node").select("node", F.explode("members").alias("group")), "shingles")
        common = written(each.groupBy("group").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "common")
        shared = each.join(common, "group").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "group"))).alias("common"))
        # A link has ceil(percent of either set) shingles in common: a set has so many others, and the next one is shared.
        others = F.col("n_shingles") - F.ceil(F.col("n_shingles") * self.percent / 100).cast("long") + 1
        left = (others - (F.col("n_shingles") - F.size("common"))).cast("int")
        known = shared.join(self.nodes, "node").withColumn("left", left).where("left > 0")
        return known.join(nodes, "node").select("node", "component", "hub", F.explode(F.slice("common", F.lit(1), F.col("left"))).alias("x")).select(F.col("x.group").alias("group"), "node", "component", "hub")

    def tiles(self, groups: DataFrame) -> DataFrame:
        """(group, kind, low, high, node): the blocks of nodes that meet, for stored rows (group, node, component)."""
        sized = groups.join(self.nodes, "node")
        parts = written(sized.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size")), "parts")
        whole = parts.groupBy("group").agg(F.max(F.struct("n", "size", "component")).alias("home"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("long")
        home = F.col("home")
        several = written(whole.select("group", home["component"].alias("home"), blocks(home["n"], home["size"]).alias("at_home"), blocks(F.col("n") - home["n"], F.col("size") - home["size"]).alias("strays")), "several")
        dealt = groups.join(several, "group").withColumn("is_home", F.col("component") == F.col("home"))
        dealt = dealt.withColumn("block", F.expr("pmod(xxhash64(node), if(is_home, at_home, strays))"))
        meets = F.when(F.col("is_home"), F.expr("transform(sequence(0L, strays - 1), i -> struct(true as home, i as low, block as high))")).otherwise(
            F.expr("concat(transform(sequence(0L, strays - 1), i -> struct(false as home, least(i, block) as low, greatest(i, block) as high)), transform(sequence(0L, at_home - 1), i -> struct(true as home, block as low, i as high)))")
        )
        return dealt.select("group", "node", F.explode(meets).alias("t")).select("group", "node", "t.home", "t.low", "t.high")

    def links(self, groups: DataFrame) -> DataFrame:
        """What hangs together in each tile, as pairs (a, b)."""
        tiles = self.tiles(groups).join(self.sets, "node").groupBy("group", "home", "low", "high").agg(F.collect_list(F.struct("node", "members")).alias("sets"))
        return written(tiles.select("sets").mapInArrow(_tile_links(self.percent), "a long, b long").distinct(), "links")


def _mixed(placed: DataFrame, key: str) -> DataFrame:
    """The keys that nodes of different components around different hubs have."""
    ends = placed.groupBy(key).agg(*(f(c).alias(f"{k}_{c}") for c in ("component", "hub") for k, f in (("low", F.min), ("high", F.max))))
    return ends.where("low_component < high_component and low_hub < high_hub")


def _tile_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column("sets"):
                node = row.values.field("node").to_numpy()
                members = row.values.field("members")
                label = hang_together(members.flatten().to_numpy(), pa.compute.list_value_length(members).to_numpy(zero_copy_only=False).astype(np.int64), percent)
                other = np.flatnonzero(label != np.arange(len(node)))
                a.append(node[other])
                b.append(node[label[other]])
            if a:
                one, two = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    return run


def hang_together(flat: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """For each of some sets the first one that it reaches by links, from the exact sizes of all intersections."""
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    common = counts[column] > 1
    row, column = row[common], column[common]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    inter = np.zeros((n, n))
    at = 0
    while at < len(column):
        to = int(np.searchsorted(column, column[at] + COLUMNS, "left"))
        part = np.zeros((n, COLUMNS), np.float32)
        part[row[at:to], column[at:to] - column[at]] = 1
        inter += part @ part.T
        at = to
    inter = np.rint(inter).astype(np.int64)
    np.fill_diagonal(inter, sizes)
    linked = inter * 100 >= (sizes[:, None] + sizes - inter) * percent
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        new = np.where(linked, label, n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; a doc_id is taken as a long."""
    chunks = chunks_for(percent)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = St.StructType([docs.schema["doc_id"], *_SIGNED])
    signed = written(docs.mapInArrow(_signatures(words, chunks * SYMBOLS), schema), "signatures")

    # Equal sets are one node. A doc_id with several texts has several nodes, which are linked.
    full = signed.where("n_shingles > 0 and doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    classes = written(full.groupBy(*_WHOLE).agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "classes")
    own = written(full.join(classes, _WHOLE).select("doc_id", "least", "node", "n_shingles", "sig"), "own")
    nodes = written(own.where("doc_id = least").dropDuplicates(["node"]).select("node", "n_shingles", "sig"), "nodes")
    whose = own.select("doc_id", "least", "node").distinct()
    ends = whose.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last")
    same = written(whose.join(ends, "doc_id").where("node > b").select(F.col("node").alias("a"), "b").distinct(), "same")

    # Keys that several nodes have, and in each bucket the node that meets most others.
    keys = keys_of(nodes, chunks)
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = written(keys.join(shared, "key"), "buckets")
    degrees = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
    members = written(members.drop("n").join(written(degrees, "degrees"), "node"), "buckets")
    heads = members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("less"))).alias("x"))
    heads = written(heads.select("key", (-F.col("x.less")).alias("head"), F.col("x.degree").alias("most")), "heads")
    stars = members.join(heads, "key").where("node <> head").groupBy("node", "head", "most").agg(F.count(F.lit(1)).alias("n"))
    best = stars.groupBy("node").agg(F.max(F.struct("n", "most", (-F.col("head")).alias("less"))).alias("x"))
    hubs = written(best.select("node", (-F.col("x.less")).alias("hub")), "hubs")

    judge = _Judge(docs.withColumn("doc_id", F.col("doc_id").cast("long")), classes, nodes, members.select("node").distinct(), words, percent)
    links = same.unionAll(judge.to_hubs(hubs))
    found = written(components(links), "components")
    links = links.unionAll(judge.inside(hubs, found))
    found = written(components(links), "components")
    links = links.unionAll(judge.across(members, hubs, found))
    found = written(components(links), "components")

    named = found.join(classes.select("node", "least"), "node")
    least = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    known = written(found.join(least, "component").select("node", "component_id"), "named")
    result = whose.join(known, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "least")).alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(result.withColumnRenamed("doc_id", "own"), F.col("doc_id").cast("long") == F.col("own"), "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id").cast("long"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id").cast("long") == component)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have a smaller near copy, directly or through others."""
    gone = near_duplicates(docs, words, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


OP1_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, g from (select doc_id, array_to_string(w[i : i + 2], ' ') g from (select doc_id, w, unnest(range(1, greatest(cast(len(w) as bigint) - 2, 1) + 1)) i from d where len(w) > 0))),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 85 * (na.n + nb.n - k)),
e as (select a u, b v from l union select b, a from l),
r as (select u node, u label from e union select e.v, r.label from r join e on e.u = r.node where r.label < e.v),
c as (select node, min(label) label from r group by node)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, coalesce(least(c.label, d.doc_id), d.doc_id) component_id, coalesce(least(c.label, d.doc_id), d.doc_id) = d.doc_id kept
from d left join n using (doc_id) left join c on c.node = d.doc_id
"""
