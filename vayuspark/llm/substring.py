"""Substring dedup: repeated windows of words, found by their halves.

A window of `window` consecutive words is removed from a document if it also starts in a document with a smaller doc_id.
Windows of half the length come first: only where such a half is repeated in another document can the whole be, so only
those are extended to the whole length and looked up again. This is one level, the last, of a doubling that starts at a
short length: the result is the same, as whatever repeats at the asked length repeats at its half, and levels below would
only find candidates that this one looks up by itself.

Not every half needs a look-up. A window holds several halves; the one with the smallest hash stands
for it, in every document alike, so a repeated window always has a repeated smallest half (nothing is missed, a quarter
of the positions are shuffled for 13 words). Hashes are summed up before the shuffle as (smallest, largest doc_id), so a
passage that a third of the documents share is one row for each task. Documents whose whole text is that of a smaller
doc_id are known from the start and keep out of the extended lengths.

Halves are matched by 64 bits, which only makes candidates; windows by 96 bits.

Defined results: a null or empty text has no words; a document of fewer words than a window keeps all; a document without
doc_id is neither source nor changed; repeated rows with one doc_id are not smaller than each other and both stay; further
columns stay (the operator's own columns replace columns of the same name).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as St
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vayuspark.llm import text as words_
from vayuspark.llm.tables import table, written

WINDOW = 13
CHECK = 0xC2B2AE3D27D4EB4F


def smallest(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive entries."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def halves(found: words_.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows in one row each, and for each the smallest hash of its halves."""
    half = (window + 1) // 2
    least = smallest(words_.window_hash(found.hash, half), window - half + 1)
    n = len(least)
    at = np.flatnonzero(found.row[:n] == found.row[window - 1 : window - 1 + n])
    return at, least[at]


def _per_row(rows: np.ndarray, values: list[np.ndarray], n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Values without repetition of the last one in the same row, and their number for each of n rows."""
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] != rows[:-1]
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    return [v[new] for v in values], np.bincount(rows[new], minlength=n)


def _half_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            found = words_.words_of(piece.column("text"))
            at, least = halves(found, window)
            (least,), counts = _per_row(found.row[at], [least], piece.num_rows)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), words_.lists(words_.signed(least), counts, pa.int64())], names=["doc_id", "text_key", "halves"])

    return run


def _wide_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            found = words_.words_of(piece.column("text"))
            at, least = halves(found, window)
            wanted = _member(found.row[at], words_.signed(least), piece.column("halves"))
            at = at[wanted]
            w, c = words_.window_hash(found.hash, window)[at], words_.window_hash(found.hash, window, CHECK)[at]
            (w, c), counts = _per_row(found.row[at], [w, c], piece.num_rows)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("text_key"), words_.lists(words_.signed(w), counts, pa.int64()), words_.lists((c >> np.uint64(32)).astype(np.uint32).view(np.int32), counts, pa.int32())],
                names=["doc_id", "text_key", "w", "c"],
            )

    return run


def _member(rows: np.ndarray, values: np.ndarray, wanted: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its row."""
    counts = np.array([n or 0 for n in pa.compute.list_value_length(wanted).to_pylist()], np.int64)
    flat = wanted.flatten().to_numpy(zero_copy_only=False)
    if not len(flat) or not len(rows):
        return np.zeros(len(rows), bool)
    # Both sides as one number of row and value; equal numbers of unequal pairs are told apart by the value itself.
    salt = words_.mix(np.arange(1, len(wanted) + 1, dtype=np.uint64))
    keys = flat.astype(np.int64).view(np.uint64) ^ salt[np.repeat(np.arange(len(wanted)), counts)]
    return np.isin(values.view(np.uint64) ^ salt[rows], keys)


_FOUND = St.StructType([St.StructField("n_words", St.LongType()), St.StructField("n_removed", St.LongType()), St.StructField("clean_text", St.StringType())])


def _mark(window: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text"):
            found = words_.words_of(piece.column("text"))
            raw, at = words_.buffer_of(piece.column("text"))
            n = np.diff(found.first)
            gone = np.zeros(len(found.start), bool)
            w = piece.column("_w")
            listed = pa.compute.fill_null(pa.compute.list_value_length(w), 0).to_numpy(zero_copy_only=False) > 0
            if listed.any():
                starts = np.flatnonzero(listed[found.row])
                starts = starts[(starts + window <= len(found.start))]
                starts = starts[found.row[starts] == found.row[starts + window - 1]]
                own = words_.window_hash(found.hash, window)[starts]
                check = (words_.window_hash(found.hash, window, CHECK)[starts] >> np.uint64(32)).astype(np.uint64)
                both = _fold(words_.signed(own), check)
                hit = _member(found.row[starts], both, _folded(w, piece.column("_c")))
                gone = words_.covered(starts[hit], window, len(gone))
            copy = piece.column("_copy").to_numpy(zero_copy_only=False).astype(bool)
            if copy.any():
                gone |= (copy & (n >= window))[found.row]
            removed = np.bincount(found.row[gone], minlength=piece.num_rows)
            clean = piece.column("text")
            if removed.any():
                changed = clean.to_pylist()
                for r in np.flatnonzero(removed).tolist():
                    if removed[r] == n[r]:
                        changed[r] = ""
                        continue
                    own = slice(found.first[r], found.first[r + 1])
                    changed[r] = words_.without(raw[at[r] : at[r + 1]].tobytes(), found.start[own] - at[r], found.end[own] - at[r], gone[own]).decode()
                clean = pa.array(changed, pa.string())
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), clean], names=[*keep, *_FOUND.names])

    return run


def _fold(w: np.ndarray, check: np.ndarray) -> np.ndarray:
    return words_.signed(words_.mix(w.view(np.uint64) + words_.mix(check)))


def _folded(w: pa.Array, c: pa.Array) -> pa.Array:
    """Lists of both hashes as lists of one."""
    counts = pa.compute.fill_null(pa.compute.list_value_length(w), 0).to_numpy(zero_copy_only=False)
    flat = w.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    check = c.flatten().to_numpy(zero_copy_only=False).astype(np.int32).view(np.uint32).astype(np.uint64)
    return words_.lists(_fold(flat, check), counts, pa.int64())


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with n_words, n_removed and clean_text, the text without the words of repeated windows."""
    docs = docs.drop(*_FOUND.names).withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    of = ["doc_id", "text_key"]

    # Whole texts of a smaller doc_id.
    whole = ["text_key", "text_md5"]
    plain = keyed.select("doc_id", "text_key", F.md5("text").alias("text_md5"))
    sources = plain.groupBy(*whole).agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    sources = written(sources, "sources")
    copies = written(plain.join(sources, whole).where("doc_id > source").select(*of).distinct(), "copies")

    # Halves that start in two documents.
    schema = St.StructType([St.StructField("doc_id", docs.schema["doc_id"].dataType), St.StructField("text_key", St.LongType()), St.StructField("halves", St.ArrayType(St.LongType()))])
    lists = keyed.mapInArrow(_half_hashes(window), schema)
    each = lists.select(*of, F.explode("halves").alias("half"))
    repeated = each.groupBy("half").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("half")
    repeated = written(repeated, "repeated")  # as a table, so that a half of very many documents can be split in the join
    candidates = each.join(repeated, "half").groupBy(*of).agg(F.collect_set("half").alias("halves"))
    candidates = written(candidates.join(copies, of, "left_anti"), "halves")

    # Their extension to the whole length, if any is left.
    wide = St.StructType([*schema.fields[:2], St.StructField("w", St.ArrayType(St.LongType())), St.StructField("c", St.ArrayType(St.IntegerType()))])
    extended = keyed.join(candidates, of).select("doc_id", "text_key", "text", "halves").mapInArrow(_wide_hashes(window), wide)
    spans = written(extended, "windows").select(*of, F.inline(F.arrays_zip("w", "c")))
    first = spans.groupBy("w", "c").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    first = written(first, "first")
    later = spans.join(first, ["w", "c"]).where("doc_id > source")
    gone = written(later.groupBy(*of).agg(F.collect_list("w").alias("w"), F.collect_list("c").alias("c")), "gone")

    marks = gone.select(*of, "w", "c", F.lit(False).alias("is_copy")).unionByName(copies.select(*of, F.lit(None).cast("array<bigint>").alias("w"), F.lit(None).cast("array<int>").alias("c"), F.lit(True).alias("is_copy")))
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("w").alias("_w"), F.col("c").alias("_c"), F.col("is_copy").alias("_copy"))
    joined = docs.withColumn("_own", F.xxhash64("text")).join(marks, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_key")), "left")
    joined = joined.select(*names, "_w", "_c", F.coalesce("_copy", F.lit(False)).alias("_copy"))
    return joined.mapInArrow(_mark(window, names), St.StructType(docs.schema.fields + _FOUND.fields))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeats cut out; a document of which no word is left goes."""
    found = remove_repeats(docs, window)
    kept = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.withColumn("text", F.col("clean_text")).select(*docs.columns)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("clean_text", F.lit("")), r"[\x09-\x0D ]+", " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


OP4_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, i, array_to_string(w[i : i + 12], ' ') g from (select doc_id, w, unnest(range(1, cast(len(w) - 11 as bigint))) i from d where len(w) >= 13)),
f as (select g, min(doc_id) first_id from s group by g),
h as (select distinct doc_id, p from (select s.doc_id, unnest(range(i, i + 13)) p from s join f on s.g = f.g where s.doc_id > f.first_id)),
k as (select doc_id, count(*) n_removed, list(p) gone from h group by doc_id),
x as (select d.doc_id, d.w, coalesce(k.n_removed, 0) n_removed from d left join k using (doc_id)),
kept as (select p.doc_id, string_agg(p.word, ' ' order by p.p) kept from (select doc_id, unnest(w) word, unnest(range(1, cast(len(w) + 1 as bigint))) p from d) p anti join h on h.doc_id = p.doc_id and h.p = p.p group by p.doc_id)
select x.doc_id, cast(len(x.w) as bigint) n_words, cast(x.n_removed as bigint) n_removed, sha256(coalesce(kept.kept, '')) kept_sha256
from x left join kept using (doc_id)
"""
