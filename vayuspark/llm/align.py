"""Alignment of two tokenizers by token-byte incidence matrices.

A matrix A has a row for each token of the first tokenizer and a column for each byte of the texts, B the same for the second
one. Both are kept as compressed rows (row ends, column numbers, values), put together here. The product A·Bᵀ, row by row as
Gustavson does it, has an entry for each pair of tokens that overlap: the links, with the number of bytes that they share.
Bytes where tokens of both end cut a text into groups; the product of the token-group incidence matrices has an entry for each
pair of tokens of one group. Texts of a piece form one block-diagonal matrix, so a task holds the matrices of a piece at a time.

How often an id pair is linked in the corpus (`pair_counts`) is summed by chunk, a run of texts of one task, before the
shuffle; the sums come back to the texts by chunk, so a pair that every text has costs a row for each chunk.

Defined results: texts that are null or empty, or whose tokens of either side do not spell them (with a space in front), have
no tokens, groups or links; repeated rows are aligned each for itself; a null doc_id is a value like others; further columns
stay (the operator's own columns replace columns of the same name). A text is one row of a piece however long it is; its
matrices take some 100 bytes for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as St
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vayuspark.llm import text as words_
from vayuspark.llm.bpe import gather, pack, unpack
from vayuspark.llm.tables import prepared, table, written
from vayuspark.llm.units import ByteBpe, Pieces, Tokens

PIECE = 1 << 19
CHUNK_BYTES = 16 << 20


@dataclass
class Rows:
    """A sparse matrix as compressed rows."""

    ends: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def transposed(self) -> Rows:
        row = np.repeat(np.arange(len(self.ends)), self.sizes())
        order = np.argsort(self.columns, kind="stable")
        return Rows(np.cumsum(np.bincount(self.columns, minlength=self.width)), row[order], self.values[order], len(self.ends))


def product(a: Rows, b: Rows) -> Rows:
    """a·b: each row of the result adds up the rows of b that the row of a names, entries with equal columns together."""
    sizes = b.sizes()
    each = sizes[a.columns]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    taken = np.repeat(b.ends[a.columns] - sizes[a.columns] - (ends - each), each) + np.arange(total)
    row = np.repeat(np.repeat(np.arange(len(a.ends)), a.sizes()), each)
    column, value = b.columns[taken], np.repeat(a.values, each) * b.values[taken]
    key = row * b.width + column
    if total and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, row, column, value = key[order], row[order], column[order], value[order]
    new = np.append(True, key[1:] != key[:-1])[:total]
    at = np.flatnonzero(new)
    return Rows(np.cumsum(np.bincount(row[at], minlength=len(a.ends))), column[at], np.add.reduceat(value, at) if total else value, b.width)


def incidence(ends: np.ndarray) -> Rows:
    """Tokens that follow each other without gaps, by the bytes that each one has."""
    total = int(ends[-1]) if len(ends) else 0
    return Rows(ends, np.arange(total), np.ones(total, np.int64), total)


def membership(group: np.ndarray, groups: int) -> Rows:
    """Tokens by the one group that each is in."""
    return Rows(np.arange(1, len(group) + 1), group, np.ones(len(group), np.int64), groups)


def _spelled(texts: pa.Array, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, their row, their size in bytes, and for each row whether the bytes of its tokens are the text's."""
    ids, counts = tokens.ids(texts)
    at, size, data = tokens.token_bytes()
    row = np.repeat(np.arange(len(texts)), counts)
    raw, starts = words_.buffer_of(texts)
    own = np.diff(starts)
    good = (np.bincount(row, weights=size[ids], minlength=len(texts)) == own) & (np.bincount(row, weights=size[ids] == 0, minlength=len(texts)) == 0) & (own > 0)
    same = gather(at, size, data, ids[good[row]])[0] == raw[np.repeat(good, own)]
    if not same.all():
        wrong = np.repeat(np.arange(len(texts)), np.where(good, own, 0))[~same]
        good[wrong] = False
    return ids, row, size[ids], good


@dataclass
class Aligned:
    """Tokens, links and groups of the texts of a piece that both tokenizers spell; rows of texts rise along the tokens."""

    ids: tuple[np.ndarray, np.ndarray]
    row: tuple[np.ndarray, np.ndarray]
    links: Rows
    #: For each token the number of its group, counted through the piece; and the row of each group.
    group: tuple[np.ndarray, np.ndarray]
    group_row: np.ndarray


def aligned(texts: pa.Array, a: Tokens, b: Tokens) -> Aligned:
    spaced = pc.if_else(pc.equal(pc.binary_length(pc.fill_null(texts, "")), 0), "", pc.binary_join_element_wise("", pc.fill_null(texts, ""), " "))
    one, two = _spelled(spaced, a), _spelled(spaced, b)
    good = one[3] & two[3]
    (ids_a, row_a, size_a), (ids_b, row_b, size_b) = ([x[good[side[1]]] for x in side[:3]] for side in (one, two))
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    links = product(incidence(ends_a), incidence(ends_b).transposed())
    cut = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cut, ends_a, "left"), np.searchsorted(cut, ends_b, "left")
    last = np.searchsorted(ends_a, cut, "left")
    return Aligned((ids_a, ids_b), (row_a, row_b), links, (group_a, group_b), row_a[last])


def shared_groups(x: Aligned) -> Rows:
    """The links between tokens of one group: all of a group's tokens with each other."""
    groups = len(x.group_row)
    return product(membership(x.group[0], groups), membership(x.group[1], groups).transposed())


_LISTS = ("a_ids", "b_ids", "a_groups", "b_groups", "link_counts", "links", "link_bytes")


def align(docs: DataFrame, a: Tokens, b: Tokens, with_shared: bool = False) -> DataFrame:
    """The columns of docs but `text`, with

    a_ids, b_ids: the tokens; a_groups, b_groups: how many of them each group has; link_counts: for each token of a how many
    links it has; links: the positions of the linked tokens of b (from 0), token of a by token of a; link_bytes: the bytes shared;
    with_shared: also shared_counts and shared, the same for links between all tokens of a group (in one large group these are many).
    """
    prepared(docs.sparkSession)
    both = docs.sparkSession.sparkContext.broadcast((a, b))
    lists = [*_LISTS, *(("shared_counts", "shared") if with_shared else ())]
    docs = docs.drop(*lists).withColumn("text", F.col("text").cast("string"))
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text", PIECE):
            x, n = aligned(piece.column("text"), *both.value), piece.num_rows
            counted = [np.bincount(r, minlength=n) for r in x.row]
            per_group = [np.bincount(g, minlength=len(x.group_row)) for g in x.group]
            groups = np.bincount(x.group_row, minlength=n)
            first_b = (np.cumsum(counted[1]) - counted[1])[x.row[0]]

            def linked(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
                return np.bincount(x.row[0], weights=rows.sizes(), minlength=n).astype(np.int64), rows.columns - np.repeat(first_b, rows.sizes())

            of_row, position = linked(x.links)
            columns = [(x.ids[0], counted[0]), (x.ids[1], counted[1]), (per_group[0], groups), (per_group[1], groups), (x.links.sizes(), counted[0]), (position, of_row), (x.links.values, of_row)]
            if with_shared:
                shared = shared_groups(x)
                of_row, position = linked(shared)
                columns += [(shared.sizes(), counted[0]), (position, of_row)]
            yield pa.RecordBatch.from_arrays([*piece.drop_columns(["text"]).columns, *(words_.lists(v.astype(np.int32), c, pa.int32()) for v, c in columns)], names=[*(f.name for f in rest), *lists])

    return docs.mapInArrow(run, St.StructType([*rest, *(St.StructField(c, St.ArrayType(St.IntegerType())) for c in lists)]))


_SEPARATORS = b",|;"


def _digits(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For id * 4 + k its decimal digits and the k-th separator (3: none), for ids of so many bits."""
    if bits not in _SPELLED:
        spelled = [str(i).encode() + _SEPARATORS[k : k + 1] for i in range(1 << bits) for k in range(4)]
        size = np.array([len(s) for s in spelled], np.int64)
        _SPELLED[bits] = np.cumsum(size) - size, size, np.frombuffer(b"".join(spelled), np.uint8)
    return _SPELLED[bits]


_SPELLED: dict[int, tuple] = {}


def group_texts(ids: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], group_row: np.ndarray, n: int) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each of n rows."""
    groups = len(group_row)
    in_a, in_b = (np.bincount(g, minlength=groups) for g in group)
    place_a = np.arange(len(ids[0])) + (np.cumsum(in_b) - in_b)[group[0]]
    place_b = np.arange(len(ids[1])) + np.cumsum(in_a)[group[1]]
    picks = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
    picks[place_a], picks[place_b] = ids[0] * 4, ids[1] * 4
    ends = np.cumsum(in_a + in_b)
    picks[ends - in_b - 1] += 1
    last = np.append(group_row[1:] != group_row[:-1], True)[:groups]
    picks[ends - 1] += np.where(last, 3, 2)
    largest = int(picks.max()) >> 2 if len(picks) else 0
    data, sizes = gather(*_digits(max(16, largest.bit_length())), picks)
    row_ends = np.cumsum(np.bincount(np.repeat(group_row, in_a + in_b), weights=sizes, minlength=n)).astype(np.int64)
    whole = data.tobytes()
    return [whole[low:high] for low, high in zip(np.append(0, row_ends[:-1]).tolist(), row_ends.tolist(), strict=True)]


_COUNTED = ("n_a", "n_b", "n_groups", "n_links")
_OWN = (*_COUNTED, "n_best", "count_sum", "groups_sha256")


def _summed(both, rest: list[str]):
    """Texts to their counts and digests, with the distinct id pairs as numbers in a list that each chunk has once.

    A row is a text (codes null) or the list of a chunk: codes (id of a * 2^32 + id of b) and how often each one is linked there.
    """
    names = ["chunk", *rest, *_COUNTED, "groups_sha256", "numbers", "times", "codes", "linked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, chunk, size, kept = TaskContext.get().partitionId() << 32, 0, 0, []

        def full() -> Iterator[pa.RecordBatch]:
            known, number = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
            weights, at = np.zeros(len(known), np.int64), 0
            for codes, times, counts, columns in kept:
                own, ends = number[at : at + len(codes)], np.cumsum(counts).tolist()
                at += len(codes)
                np.add.at(weights, own, times)
                parts = list(zip([0, *ends[:-1]], ends, strict=True))
                packed = [[pack(np.diff(own[x:y], prepend=0)) for x, y in parts], [pack(times[x:y]) for x, y in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), base + chunk)), *columns, *(pa.array(p, pa.binary()) for p in packed), *[pa.nulls(len(parts), pa.list_(pa.int64()))] * 2], names=names)
            if len(known):
                gone = [pa.nulls(1, c.type) for c in [*kept[0][3], pa.array([], pa.binary()), pa.array([], pa.binary())]]
                yield pa.RecordBatch.from_arrays([pa.array([base + chunk]), *gone, *(words_.lists(v, np.array([len(v)]), pa.int64()) for v in (known, weights))], names=names)

        for piece in words_.pieces(batches, "text", PIECE):
            x, n = aligned(piece.column("text"), *both.value), piece.num_rows
            texts = group_texts(x.ids, x.group, x.group_row, n)
            per_token = x.links.sizes()
            of_row = np.repeat(x.row[0], per_token)
            known, place = np.unique((np.repeat(x.ids[0], per_token) << 32) | x.ids[1][x.links.columns], return_inverse=True)
            width = max(1, len(known))
            pairs, times = np.unique(of_row * width + place, return_counts=True)
            counted = [np.bincount(r, minlength=n) for r in (*x.row, x.group_row, of_row)]
            columns = [piece.column(c) for c in rest] + [pa.array(v, pa.int64()) for v in counted] + [pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())]
            kept.append((known[pairs % width] if len(known) else pairs, times, np.bincount(pairs // width, minlength=n), columns))
            size += int(words_.buffer_of(piece.column("text"))[1][-1])
            if size > CHUNK_BYTES:
                yield from full()
                chunk, size, kept = chunk + 1, 0, []
        if kept:
            yield from full()

    return run


def link_counts(links: DataFrame) -> DataFrame:
    """(code, count, is_best): how many links hold an id pair in the corpus, and whether no other pair with its id of b has more.

    links: code, n; a code is the id of a * 2^32 + the id of b. Sums and maxima combine before the shuffle and are tables
    before they are joined, so that an id of b with many partners can be split.
    """
    pairs = written(links.groupBy("code").agg(F.sum("n").alias("count")).withColumn("b", F.col("code").bitwiseAND(0xFFFFFFFF)), "pairs")
    best = written(pairs.groupBy("b").agg(F.max("count").alias("most")), "best")
    return written(pairs.join(best, "b").select("code", "count", (F.col("count") == F.col("most")).alias("is_best")), "counts")


def summaries(docs: DataFrame, a: Tokens, b: Tokens) -> DataFrame:
    """The columns of docs but `text`, with counts and a digest of what `align` gives for each text, and `n_best`, `count_sum`.

    n_best: links whose id pair is the most frequent one of its id of b; count_sum: the sum of all links' pair counts.
    """
    both = prepared(docs.sparkSession).sparkContext.broadcast((a, b))
    docs = docs.drop(*_OWN).withColumn("text", F.col("text").cast("string"))
    rest = [f for f in docs.schema.fields if f.name != "text"]
    hidden = [St.StructField(f"own_{i}", f.dataType) for i, f in enumerate(rest)]
    docs = docs.select(*(F.col(f"`{f.name}`").alias(h.name) for f, h in zip(rest, hidden, strict=True)), "text")
    longs, binary = St.ArrayType(St.LongType()), St.BinaryType()
    counted = [St.StructField(c, St.LongType()) for c in _COUNTED]
    digest = St.StructField("groups_sha256", St.StringType())
    schema = St.StructType([St.StructField("chunk", St.LongType()), *hidden, *counted, digest, St.StructField("numbers", binary), St.StructField("times", binary), St.StructField("codes", longs), St.StructField("linked", longs)])
    stored = written(docs.mapInArrow(_summed(both, [h.name for h in hidden]), schema), "aligned")

    lists = stored.where("codes is not null").select(F.col("chunk").alias("home"), F.posexplode(F.arrays_zip("codes", "linked")).alias("number", "x"))
    local = lists.select("home", "number", F.col("x.codes").alias("code"), F.col("x.linked").alias("n"))
    judged = local.join(link_counts(local), "code").select("home", "number", "count", "is_best")
    out = St.StructType([*hidden, *counted, St.StructField("n_best", St.LongType()), St.StructField("count_sum", St.LongType()), digest])
    names = [f.name for f in [*hidden, *counted]]

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = right.column("count").to_numpy(), right.column("is_best").to_numpy(zero_copy_only=False)
        sums = []
        for numbers, times in zip(left.column("numbers").to_pylist(), left.column("times").to_pylist(), strict=True):
            own, often = np.cumsum(unpack(numbers).astype(np.int64)), unpack(times).astype(np.int64)
            sums.append((int(often @ best[own]), int(often @ count[own])))
        columns = [left.column(c) for c in names] + [pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)] + [left.column("groups_sha256")]
        return pa.Table.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(out.fields, columns, strict=True)]))

    texts = stored.where("codes is null").select("chunk", *names, "groups_sha256", "numbers", "times")
    done = texts.groupBy("chunk").cogroup(judged.groupBy("home")).applyInArrow(assemble, out)
    return done.select(*(F.col(h.name).alias(f.name) for f, h in zip(rest, hidden, strict=True)), *_OWN)


def tokenizers(a: str | None = None, b: str | None = None) -> tuple[Tokens, Tokens]:
    """Byte-level BPE and pieces; the files are parameters."""
    import public_tokenizers

    return ByteBpe(a or public_tokenizers.path("byte_bpe_50k.json")), Pieces(b or public_tokenizers.path("piece_bpe_32k.model"))


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return summaries(docs, *tokenizers()).select("doc_id", *_OWN)
