"""Benchmark decontamination: a broadcast hash set of the normalised test n-grams, whole texts scanned against it.

A window is `n` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Words are
runs of ASCII letters and digits and of non-ASCII characters, with A-Z lowered. Each word of a document inside any
occurrence of a window is hit. A hash that is found is verified by comparing the words themselves.

The benchmark is broadcast only if its texts have at most `broadcast_bytes`; a larger one is joined by hash instead,
with the same result.

Defined results: a null or empty text has no words, no hits and is kept; a null item text has no windows; an item
without item_id marks words but is not counted or listed; repeated rows are judged each for itself; further columns
of the documents stay as they are (the operator's own columns replace columns of the same name).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as St
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vayuspark.llm import text as words_
from vayuspark.llm.tables import prepared, table, with_text_key, written

N = 10
#: Text of a benchmark whose windows are sent to every task: some 350,000 windows, about 250 MB in a process.
BROADCAST_BYTES = 2 << 20
#: A check hash of windows with other factors, for the path that joins by hash.
CHECK = 0xC2B2AE3D27D4EB4F


class Grams:
    """Windows of the benchmark: by length the sorted hashes and for each hash the windows with their items."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.windows: dict[tuple[int, int], dict[bytes, set[str]]] = {}
        texts = pa.array([text for _, text in items], pa.string())
        found = words_.words_of(texts, words_.MARKS, lower=True)
        raw, _ = words_.buffer_of(texts)
        spaced = words_.LOWER[raw].tobytes()
        counts = np.diff(found.first)
        for k in sorted({min(n, int(c)) for c in counts if c}):
            at, h = words_.windows(found, k)
            for i, key in zip(at.tolist(), h.tolist(), strict=True):
                item = found.row[i]
                if min(n, counts[item]) != k:
                    continue
                ids = self.windows.setdefault((k, key), {}).setdefault(_words(spaced, found, i, k), set())
                if items[item][0] is not None:
                    ids.add(items[item][0])
        for k in {k for k, _ in self.windows}:
            keys = np.sort(np.array([key for size, key in self.windows if size == k], np.uint64))
            present = np.zeros(1 << 20, bool)
            present[keys >> np.uint64(44)] = True
            self.by_length[k] = keys, present

    def scan(self, found: words_.Words, spaced: bytes, rows: int) -> tuple[np.ndarray, list[set[str]]]:
        """Marks of the words that are hit, and the items found in each row."""
        hit, items = np.zeros(len(found.start), bool), [set() for _ in range(rows)]
        for k, (keys, present) in self.by_length.items():
            at, h = words_.windows(found, k)
            maybe = np.flatnonzero(present[h >> np.uint64(44)])
            slot = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            maybe = maybe[keys[slot] == h[maybe]]
            real = []
            for i, key in zip(at[maybe].tolist(), h[maybe].tolist(), strict=True):
                ids = self.windows[k, key].get(_words(spaced, found, i, k))
                if ids is not None:
                    real.append(i)
                    items[found.row[i]] |= ids
            if real:
                hit |= words_.covered(np.array(real), k, len(hit))
        return hit, items


def _words(lowered: bytes, found: words_.Words, i: int, k: int) -> bytes:
    return b" ".join(lowered[s:e] for s, e in zip(found.start[i : i + k].tolist(), found.end[i : i + k].tolist(), strict=True))


_FOUND = St.StructType([
    St.StructField("n_words", St.LongType()), St.StructField("n_hit", St.LongType()),
    St.StructField("items", St.ArrayType(St.StringType())), St.StructField("clean_text", St.StringType()),
    St.StructField("spans", St.ArrayType(St.LongType())),
])


def _result(piece: pa.RecordBatch, found: words_.Words, hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    """The piece with what was found: counts, items, the text without the hit words, their byte spans."""
    texts = piece.column("text")
    raw, at = words_.buffer_of(texts)
    n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), found.first[:-1]) if len(texts) else np.zeros(0, np.int64)
    n_words = np.diff(found.first)
    n_hit[n_words == 0] = 0
    clean, spans, counts = texts, [], np.zeros(len(texts), np.int64)
    if hit.any():
        changed = texts.to_pylist()
        for r in np.flatnonzero(n_hit).tolist():
            own = slice(found.first[r], found.first[r + 1])
            s, e, gone = found.start[own] - at[r], found.end[own] - at[r], hit[own]
            changed[r] = words_.without(raw[at[r] : at[r + 1]].tobytes(), s, e, gone).decode()
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            pairs = np.stack([s[edge[::2]], e[edge[1::2] - 1]], axis=1)
            spans.append(pairs.ravel())
            counts[r] = pairs.size
        clean = pa.array(changed, pa.string())
    values = {
        "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
        "items": pa.array(items, pa.list_(pa.string())), "clean_text": clean,
        "spans": words_.lists(np.concatenate(spans) if spans else np.zeros(0, np.int64), counts, pa.int64()),
    }
    columns = {name: piece.column(name) for name in piece.schema.names} | values
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns.values()], names=list(columns))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.drop(*_FOUND.names).withColumn("text", F.col("text").cast("string"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Documents with n_words, n_hit, items (sorted), clean_text (without the hit words) and spans (byte from, to, ...)."""
    prepared(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 64)).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(docs, items, n)
    spark = docs.sparkSession
    grams = spark.sparkContext.broadcast(Grams([(r.item_id, r.text) for r in items.collect()], n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            column = piece.column("text")
            found = words_.words_of(column, words_.MARKS, lower=True)
            lowered = words_.LOWER[words_.buffer_of(column)[0]].tobytes()
            hit, names = grams.value.scan(found, lowered, len(column))
            yield _result(piece, found, hit, [sorted(x) for x in names])

    plain = _plain(docs)
    return plain.mapInArrow(scan, St.StructType(plain.schema.fields + _FOUND.fields))


def _joined(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The same for a benchmark of any size: windows of both sides meet in a shuffle by two hashes."""
    counted = St.StructType([St.StructField("item_id", St.StringType()), St.StructField("k", St.IntegerType()), St.StructField("h", St.LongType()), St.StructField("c", St.LongType())])

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            found = words_.words_of(piece.column("text"), words_.MARKS, lower=True)
            counts = np.diff(found.first)
            for k in sorted({min(n, int(c)) for c in counts if c}):
                (at, h), (_, c) = words_.windows(found, k), words_.windows(found, k, CHECK)
                own = np.minimum(counts[found.row[at]], n) == k
                rows = found.row[at][own]
                yield pa.RecordBatch.from_arrays([piece.column("item_id").take(pa.array(rows)), pa.array(np.full(len(rows), k), pa.int32()), pa.array(words_.signed(h[own])), pa.array(words_.signed(c[own]))], names=counted.names)

    wanted = written(items.mapInArrow(item_windows, counted).distinct(), "grams")
    lengths = sorted(r.k for r in wanted.select("k").distinct().collect())  # n lengths at most
    placed = St.StructType([St.StructField("doc_id", St.LongType()), St.StructField("text_key", St.LongType()), St.StructField("at", St.IntegerType()), *counted.fields[1:]])

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            found = words_.words_of(piece.column("text"), words_.MARKS, lower=True)
            for k in lengths:
                (at, h), (_, c) = words_.windows(found, k), words_.windows(found, k, CHECK)
                rows = pa.array(found.row[at])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(rows), piece.column("text_key").take(rows), pa.array(at - found.first[found.row[at]], pa.int32()), pa.array(np.full(len(at), k), pa.int32()), pa.array(words_.signed(h)), pa.array(words_.signed(c))], names=placed.names)

    keys = ["k", "h", "c"]
    # Windows meet without their items first: one that many items and many documents have is a row for each place.
    hits = written(with_text_key(_plain(docs)).mapInArrow(doc_windows, placed).distinct().join(written(wanted.select(*keys).distinct(), "windows"), keys), "hits")
    of = ["doc_id", "text_key"]
    spots = hits.select(*of, F.struct("at", "k").alias("spot")).distinct().groupBy(*of).agg(F.collect_list("spot").alias("spots"))
    named = written(hits.select(*of, *keys).distinct(), "named").join(wanted.where("item_id is not null"), keys)
    names = named.select(*of, "item_id").distinct().groupBy(*of).agg(F.sort_array(F.collect_list("item_id")).alias("names"))
    here = spots.join(names, [spots.doc_id.eqNullSafe(names.doc_id), spots.text_key == names.text_key], "left")
    here = here.select(spots.doc_id.alias("_id"), spots.text_key.alias("_key"), F.col("spots").alias("_spots"), F.col("names").alias("_names"))
    plain = _plain(docs)
    both = plain.withColumn("_own", F.xxhash64("text")).join(here, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left").drop("_own", "_id", "_key")
    names_of = plain.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            found = words_.words_of(piece.column("text"), words_.MARKS, lower=True)
            hit, names = np.zeros(len(found.start), bool), []
            for r, (spots, own) in enumerate(zip(piece.column("_spots").to_pylist(), piece.column("_names").to_pylist(), strict=True)):
                if spots:
                    hit |= words_.covered(np.array([x["at"] for x in spots]) + found.first[r], np.array([x["k"] for x in spots]), len(hit))
                names.append(own or [])
            yield _result(piece.select(names_of), found, hit, names)

    return both.mapInArrow(mark, St.StructType(plain.schema.fields + _FOUND.fields))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, drop_share: float = 0.5) -> DataFrame:
    """The documents without benchmark passages: hit words are cut, a document with `drop_share` of them or more goes."""
    found = find_contamination(docs, benchmark, n)
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words") * drop_share))
    return kept.withColumn("text", F.col("clean_text")).select(*[c for c in docs.columns])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null),
g as (select distinct item_id, least(len(w), 10) k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') gram
      from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
s as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') gram
      from (select doc_id, w, k, unnest(range(1, cast(len(w) - k + 2 as bigint))) i from d, (select distinct k from g) where len(w) >= k)),
h as (select s.doc_id, s.i, s.k, g.item_id from s join g on s.k = g.k and s.gram = g.gram),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from h) group by doc_id),
n as (select doc_id, count(distinct item_id) n_items, sha256(string_agg(distinct item_id, ',' order by item_id)) items_sha256 from h group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(c.n_hit, 0) as bigint) n_hit, cast(coalesce(n.n_items, 0) as bigint) n_items,
       coalesce(n.items_sha256, sha256('')) items_sha256, c.n_hit is not null contaminated
from d left join c using (doc_id) left join n using (doc_id)
"""
