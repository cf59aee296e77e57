"""Collocations of consecutive words, mined in shards (SON partitioning).

1. Every document belongs to one of `SHARDS` shards by its number. Each shard is mined completely, level by level: words and
   pairs first, then phrases with one word more whose parts are candidates, counted by 64-bit hash and summed by chunk (a run
   of texts of one task) before the shuffle. A phrase is locally frequent if it reaches its shard's part of the support:
   support * bytes of the shard / bytes of all shards, rounded up. If a phrase misses its part in every shard it misses the
   support in the corpus, and what is locally frequent has locally frequent parts, so none is lost.
2. The locally frequent hashes of all shards together are the candidates, without those whose hash misses the support in
   all shards together (a hash has no fewer occurrences than any of its phrases). They go to every task as a bit field of fixed size
   (`BITS`): a bit set by another hash lets more phrases through, never fewer. With many more candidates than bits everything
   passes, and the next step is only slower.
3. All phrases that pass, and all of whose parts do, are counted over the whole corpus, by their words, exactly. What is
   below the support goes.

Scores, the drop of phrases inside longer ones and the ranks are joins and sums over the frequent phrases alone.

Defined results: a null text is empty; a null lang is `und`; texts without a piece of two words give nothing but their words'
share of n; repeated rows count each; an empty table gives no rows; columns other than doc_id, text and lang are not looked
at. Whole texts are read, however long; a word may be as long as its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vayuspark.llm import text as words_
from vayuspark.llm.tables import prepared, table, written

SHARDS = 4
#: Bits of the field of candidates, as a power of two: 16 MB.
BITS = 27
PIECE, CHUNK_WORDS = 2 << 20, 1_500_000
#: Of this many groups of a language the first phrases are taken before they are ranked together.
RANK_GROUPS = 32

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_SEPARATORS = _BREAKS + b"\x20\x09"


class _Chunk:
    """Words of some texts of one language: hashes, the piece and shard of each word, and the words themselves if asked."""

    def __init__(self):
        self.hash, self.piece, self.shard, self.word, self.pieces, self.n = [], [], [], [], 0, 0

    def add(self, texts: pa.Array, shards: np.ndarray, spelled: bool) -> None:
        found = words_.words_of(texts, _SEPARATORS, lower=True)
        raw, at = words_.buffer_of(texts)
        is_break = np.zeros(256, bool)
        is_break[list(_BREAKS)] = True
        cuts = np.cumsum(is_break[raw])
        self.piece.append(cuts[found.start] + found.row + self.pieces if len(found.start) else np.zeros(0, np.int64))
        self.pieces += (int(cuts[-1]) if len(raw) else 0) + len(texts)
        self.hash.append(found.hash)
        self.shard.append(shards[found.row])
        self.n += len(found.start)
        if spelled and len(found.start):
            size = found.end - found.start
            ends = np.cumsum(size)
            letters = words_.LOWER[raw][np.repeat(found.start - (ends - size), size) + np.arange(int(ends[-1]))]
            self.word.append(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(letters)]))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all k consecutive words of one piece."""
        hashes, piece = np.concatenate(self.hash), np.concatenate(self.piece)
        wide = words_.window_hash(hashes, k)
        at = np.flatnonzero(piece[: len(wide)] == piece[k - 1 : k - 1 + len(wide)])
        return at, words_.combine(wide[at], np.full(len(at), k, np.uint64))


def _chunks(batches: Iterator[pa.RecordBatch], spelled: bool) -> Iterator[tuple[str, _Chunk]]:
    """Chunks of the texts of a task, by language; the open ones have CHUNK_WORDS words together, or a piece more."""
    open_: dict[str, _Chunk] = {}
    for batch in words_.pieces(batches, "text", PIECE):
        langs = batch.column("lang").dictionary_encode()
        code, shards = langs.indices.to_numpy(zero_copy_only=False), batch.column("shard").to_numpy(zero_copy_only=False)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(code == i)
            chunk = open_.setdefault(lang, _Chunk())
            chunk.add(batch.column("text").take(pa.array(own)), shards[own], spelled)
        while sum(c.n for c in open_.values()) > CHUNK_WORDS:
            largest = max(open_, key=lambda x: open_[x].n)
            yield largest, open_.pop(largest)
    yield from open_.items()


def _seed(lang: str) -> np.uint64:
    return words_.words_of(pa.array([lang.encode()], pa.binary()), b"").hash[0] if lang else np.uint64(1)


def _keys(wide: np.ndarray, seed: np.uint64) -> np.ndarray:
    return (words_.mix(wide ^ seed) >> np.uint64(1)).astype(np.int64)


def _set(field: np.ndarray, key: np.ndarray, shards: int) -> np.ndarray:
    """Whether the field has the bits of these keys."""
    place = (key // shards) & ((1 << BITS) - 1)
    return (field[place >> 3] >> (place & 7)) & 1 == 1


def _mined(sizes: range, shards: int, field):
    """(hash, part): phrases of a chunk and how often one shard has them there, n * shards + shard.

    From the third word on only phrases whose parts without the last and without the first word are candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, chunk in _chunks(batches, False):
            seed, of_word = _seed(lang), np.concatenate(chunk.shard)
            for k in sizes:
                at, wide = chunk.windows(k)
                if field is not None:
                    passed = np.zeros(chunk.n + 1, bool)
                    before, parts = chunk.windows(k - 1)
                    passed[before] = _set(field.value, _keys(parts, seed), shards)
                    good = passed[at] & passed[at + 1]
                    at, wide = at[good], wide[good]
                key = _keys(wide, seed)
                key, n = np.unique(key - key % shards + of_word[at], return_counts=True)
                hashes, part = key // shards, n * shards + key % shards
                for low in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[low : low + (1 << 16)]), pa.array(part[low : low + (1 << 16)])], names=["hash", "part"])

    return run


def _counted(most: int, shards: int, field):
    """(lang, size, phrase, n) of the candidates of a chunk, by their words; size 0: all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = field.value
        for lang, chunk in _chunks(batches, True):
            yield _phrases(lang, 0, [""], [chunk.n])
            if not chunk.n:
                continue
            seed = _seed(lang)
            words = pa.chunked_array(chunk.word).combine_chunks().dictionary_encode()
            spelled, code = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            width, passed, number = len(spelled), np.ones(chunk.n, bool), np.zeros(chunk.n, np.int64)
            for k in range(1, most + 1):
                at, wide = chunk.windows(k)
                good = _set(bits, _keys(wide, seed), shards)
                if k > 1:  # the parts without the last and without the first word
                    good &= passed[at] & passed[at + 1]
                at = at[good]
                # Phrases of k words are numbered by those of k - 1 words and the last word, so that equal numbers are equal words.
                both, first, place, n = np.unique(number[at] * width + code[at + k - 1], return_index=True, return_inverse=True, return_counts=True)
                passed, number = np.zeros(chunk.n, bool), np.zeros(chunk.n, np.int64)
                passed[at], number[at] = True, place
                for low in range(0, len(both), 1 << 14):
                    starts = at[first[low : low + (1 << 14)]]
                    yield _phrases(lang, k, [b" ".join(spelled[c] for c in code[s : s + k].tolist()).decode() for s in starts.tolist()], n[low : low + (1 << 14)])

    return run


def _phrases(lang: str, size: int, phrases: list[str], n) -> pa.RecordBatch:
    rows = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang] * rows, pa.string()), pa.array(np.full(rows, size, np.int32)), pa.array(phrases, pa.string()), pa.array(n, pa.int64())], names=["lang", "size", "phrase", "n"])


def shares(texts: DataFrame, support: int) -> dict[int, int]:
    """The part of the support that a phrase must reach in each shard that has any text: one of them, if it reaches the whole."""
    weights = {r["shard"]: r["weight"] for r in texts.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("weight")).collect()}
    return {shard: max(1, -(-support * weight // sum(weights.values()))) for shard, weight in weights.items()}


def candidates(texts: DataFrame, sizes: range, support: int, least: dict[int, int], shards: int, field=None) -> DataFrame:
    """(hash): of every phrase of these sizes that is frequent in a shard at that shard's part of the support.

    A hash that misses the support in all shards together stands for no frequent phrase and is left out.
    """
    mined = texts.select("lang", "text", "shard").mapInArrow(_mined(sizes, shards, field), "hash long, part long")
    n, shard = F.expr(f"part div {shards}"), F.expr(f"part % {shards}")
    # Chunks have summed up already: rows go straight to their hash's partition, without a second table of sums on the way.
    sums = mined.repartition("hash").groupBy("hash").agg(F.sum(n).alias("n"), *[F.sum(F.when(shard == k, n).otherwise(0)).alias(f"n{k}") for k in least])
    enough = F.lit(False)
    for k, part in least.items():
        enough = enough | (F.col(f"n{k}") >= part)
    return sums.where(enough & (F.col("n") >= support)).select("hash")


def bit_field(hashes: DataFrame) -> np.ndarray:
    """Bytes of a field of 2^BITS bits with those of the hashes set: summed by words of 64 bits, so its size is all that travels."""
    place = F.col("hash").bitwiseAND((1 << BITS) - 1)
    bit = F.expr("shiftleft(1L, int(place & 63))")
    rows = hashes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    field = np.zeros(1 << (BITS - 6), np.int64)
    field[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return field.view(np.uint8)


def frequent(docs: DataFrame, most: int = 3, support: int = 10, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of the phrases of up to `most` words that occur `support` times or more, and (lang, n) of all words."""
    spark = prepared(docs.sparkSession)
    shard = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(shards)).cast("int")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), shard.alias("shard"))
    least, field = shares(texts, support), None
    # Level by level: words and pairs together, then a word more each time.
    for sizes in [range(1, min(most, 2) + 1), *(range(k, k + 1) for k in range(3, most + 1))]:
        more = bit_field(candidates(texts, sizes, support, least, shards, field))
        field = spark.sparkContext.broadcast(more if field is None else more | field.value)
    counted = texts.mapInArrow(_counted(most, shards, field), "lang string, size int, phrase string, n long")
    summed = written(counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where((F.col("size") == 0) | (F.col("f") >= support)), "phrases")
    return summed.where("size > 0"), summed.where("size = 0").select("lang", F.col("f").alias("n"))


def _part(low: Column, high: Column) -> Column:
    """Words low to high (from 1) of a phrase."""
    return F.array_join(F.slice("words", low, high - low + 1), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words or more: the cut with the lowest score, the first of equal ones."""
    parts = phrases.select("lang", "phrase", "f")
    longer = phrases.where("size >= 2").withColumn("words", F.split("phrase", " "))
    k = F.col("k")
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), k).alias("first"), _part(k + 1, F.col("size")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # 15 digits each: the products have 36 at most and stay exact.
    wide = {c: f"cast({c} as decimal(15,0))" for c in "alr"}
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide['a']} * {wide['a']})) div ({wide['l']} * {wide['r']})").cast("long")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def inside_longer(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of those whose words lie inside a longer phrase that has at least so many percent of their occurrences."""
    longer = phrases.where("size >= 3").withColumn("words", F.split("phrase", " "))
    k, low = F.col("k"), F.col("low")
    parts = longer.select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    parts = parts.select("lang", "f", "words", "k", F.explode(F.sequence(F.lit(1), F.col("size") - k + 1)).alias("low"))
    most = written(parts.select("lang", "f", _part(low, low + k - 1).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most")), "longer")
    return phrases.join(most, ["lang", "phrase"]).where(F.col("most") * 100 >= F.col("f") * percent).select("lang", "phrase")


def first_of_each(ranked: DataFrame, group: str, order: list, limit: int, by: str) -> DataFrame:
    """`rank` of the first rows of each group; those of some parts of a group are taken first, so that a group is no one task."""
    parts = ranked.withColumn("part", F.pmod(F.xxhash64(by), F.lit(RANK_GROUPS)))
    in_part = Window.partitionBy(group, "part").orderBy(*order)
    some = parts.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= limit).drop("part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= limit)


def collocations(docs: DataFrame, most: int = 3, support: int = 10, percent: int = 50, limit: int = 2000, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two to `most` words."""
    phrases, totals = frequent(docs, most, support, shards)
    kept = written(scored(phrases).join(inside_longer(phrases, percent), ["lang", "phrase"], "left_anti"), "scored")
    ranked = first_of_each(kept, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], limit, "phrase")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


OP12_SQL = r"""
with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) t from documents),
w as (select lang, regexp_extract_all(t, '[^\x20\x09]+') w from p),
n as (select lang, cast(sum(len(w)) as bigint) n from w group by lang),
g as (select lang, k, array_to_string(w[i : i + k - 1], ' ') phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w, (values (1), (2), (3)) x(k) where len(w) >= k)),
f as (select lang, k, phrase, cast(count(*) as bigint) f from g group by all having count(*) >= 10),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') w from f where k >= 2),
u as (select lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') x, array_to_string(w[cut + 1 : k], ' ') y from (select *, unnest(range(1, k)) cut from c)),
s as (select u.lang, u.phrase, u.a, u.cut, fx.f l, fy.f r, cast((1000000::hugeint * u.a * u.a) // (fx.f::hugeint * fy.f) as bigint) score from u join f fx on fx.lang = u.lang and fx.phrase = u.x join f fy on fy.lang = u.lang and fy.phrase = u.y),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
m as (select lang, phrase, max(a) a from (select lang, a, array_to_string(w[i : i + 1], ' ') phrase from (select *, unnest([1, 2]) i from c where k = 3)) group by all)
select b.lang, cast(row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as bigint) rank, b.phrase, b.a, b.l, b.r, n.n, b.score
from b join n using (lang) left join m on m.lang = b.lang and m.phrase = b.phrase where m.a is null or 100 * m.a < 50 * b.a
qualify rank <= 2000
"""
