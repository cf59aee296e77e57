"""Packing of documents into sequences: dominance reduction after Martello and Toth, then best fit.

Documents become token ids with an end mark; only those that are longer than a sequence are cut, into whole sequences and a
last piece. What is packed are lengths, so the plan is made from the histogram of lengths, which has one row for each length
up to the capacity however many documents there are. In it

* sets of a length and at most two others are fixed for good where they dominate: where every other set that could share a
  sequence with that length can be exchanged, part by part, for something at least as long in the fixed set. A length and its
  exact complement always do. Fixing such a set never costs a sequence;
* what remains is packed longest first, each into the sequence with the least room that still takes it. Sequences with equal
  room are handled together, as runs of consecutive numbers.

The plan says for a run of ranks within a length where they go: capacity * 4 runs of sequences at most, each extended less
often than its room can be halved, so it has a bounded number of rows (some ten thousand in practice) and goes to every task.
The n-th piece of a length takes the n-th place; ranks are counted in blocks of rows of a stored table, so that a length that a
third of all pieces have is no group in one task.

Defined results: null and empty texts are the end mark alone, a piece of length 1; a null doc_id is a value like others;
repeated rows are packed each for itself; an empty table gives no rows; further columns stay (the operator's own columns
replace columns of the same name). A row of `pack` without a length, or with one below 1, has no place (null); one longer than the capacity
is an error.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as St
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vayuspark.llm import text as words_
from vayuspark.llm.tables import prepared, table, written
from vayuspark.llm.units import Tokens, WordBpe
from vayuspark.operators.blocks import running_before

CAPACITY, END = 4096, 1
PIECE = 2 << 20
#: Rows of a block in which ranks are counted, as a power of two; pieces of a batch.
BLOCK_BITS, ROWS = 12, 2048

_PIECE = [St.StructField("piece", St.IntegerType()), St.StructField("start", St.LongType()), St.StructField("length", St.LongType()), St.StructField("ids", St.BinaryType())]


def token_pieces(docs: DataFrame, tokens: Tokens, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The columns of docs but `text`, a row for each piece: piece, start, length, ids (little-endian unsigned 32-bit)."""
    shared = prepared(docs.sparkSession).sparkContext.broadcast(tokens)
    docs = docs.drop(*(f.name for f in _PIECE)).withColumn("text", F.col("text").cast("string"))
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words_.pieces(batches, "text", PIECE):
            ids, counts = shared.value.ids(batch.column("text"))
            ids, counts = np.insert(ids, np.cumsum(counts), end).astype("<u4"), counts + 1
            parts = -(-counts // capacity)
            row = np.repeat(np.arange(batch.num_rows), parts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            length = np.minimum(capacity, counts[row] - number * capacity)
            offset = np.append(0, np.cumsum(length))
            others = batch.drop_columns(["text"])
            for low in range(0, len(row), ROWS):
                high = min(len(row), low + ROWS)
                at = (4 * (offset[low : high + 1] - offset[low])).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(at), pa.py_buffer(ids[offset[low] : offset[high]])])
                own = [pa.array(number[low:high].astype(np.int32)), pa.array(number[low:high] * capacity), pa.array(length[low:high]), blob]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row[low:high])) for c in others.columns), *own], names=[f.name for f in [*rest, *_PIECE]])

    return docs.mapInArrow(run, St.StructType([*rest, *_PIECE]))


class Plan:
    """Places for counted lengths. rows: (length, low, high, first, each, offset): of the pieces of a length those of rank low
    to high - 1 go to the sequences from `first` on, `each` to a sequence, from `offset` on."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {x: n for x, n in counts.items() if n}
        self.lengths = sorted(self.left)
        if self.lengths and not 1 <= self.lengths[0] <= self.lengths[-1] <= capacity:
            raise ValueError(f"lengths from 1 to {capacity} can be packed")
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.used: Counter = Counter()
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def _place(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        low = self.used[length]
        self.rows.append((length, low, low + n, first, each, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def _least(self, without: Counter, above: int = 0, n: int = 3) -> list[int]:
        """The n smallest pieces longer than `above`."""
        found: list[int] = []
        for x in self.lengths[bisect_right(self.lengths, above) :]:
            found += [x] * min(n, self.left[x] - without[x])
            if len(found) >= n:
                break
        return found[:n]

    def _most(self, room: int, without: Counter) -> int | None:
        """The longest piece that fits."""
        for at in range(bisect_right(self.lengths, room) - 1, -1, -1):
            if self.left[self.lengths[at]] > without[self.lengths[at]]:
                return self.lengths[at]
        return None

    def _longest_pair(self, room: int, without: Counter) -> int:
        """The most that two pieces have which fit together."""
        there = {x: self.left[x] - without[x] for x in self.lengths if self.left[x] > without[x]}
        best = max((2 * x for x, n in there.items() if n >= 2 and 2 * x <= room), default=0)
        lengths = list(there)
        low, high = 0, len(lengths) - 1
        while low < high:
            both = lengths[low] + lengths[high]
            if both > room:
                high -= 1
            else:
                best, low = max(best, both), low + 1
        return best

    def dominating(self, length: int) -> tuple[int, ...] | None:
        """Lengths that together with this one dominate every set that it could share a sequence with, if such are found."""
        room, own = self.capacity - length, Counter([length])
        longest = self._most(room, own)
        if longest is None:
            return ()
        least = self._least(own)
        if longest == room or sum(least[:2]) > room or len(least) < 2:
            return (longest,)  # nothing else fits better, or nothing fits beside it
        if len(least) == 3 and sum(least) <= room:
            return None
        # Two others fit at most.
        if self._longest_pair(room, own) <= longest:
            return (longest,)
        second = self._most(room - longest, own + Counter([longest]))
        if second is None:
            return None
        above = self._least(own, second, 2)
        # Unless two pieces longer than the second one fit, every pair is no longer than these two, piece by piece.
        return (longest, second) if len(above) < 2 or sum(above) > room else None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for length in self.lengths[::-1]:
                while length in self.left and (others := self.dominating(length)) is not None:
                    parts = Counter((length, *others))
                    times, offset, first = min(self.left[x] // k for x, k in parts.items()), 0, self.sequences
                    for x, k in parts.items():
                        self._place(x, times * k, first, k, offset)
                        offset += x * k
                    self.sequences += times
                    changed = True

    def best_fit(self) -> None:
        rooms: list[int] = []
        runs: dict[int, list[tuple[int, int]]] = {}

        def keep(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in runs:
                    insort(rooms, room)
                    runs[room] = []
                runs[room].append((first, n))

        for length in self.lengths[::-1]:
            while length in self.left:
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, n = runs[room].pop()
                    if not runs[room]:
                        del runs[room], rooms[at]
                else:
                    room, first, n = self.capacity, self.sequences, -(-self.left[length] // (self.capacity // length))
                    self.sequences += n
                each = room // length
                full, more = min(n, self.left[length] // each), 0
                if full:
                    self._place(length, full * each, first, each, self.capacity - room)
                    keep(room - each * length, first, full)
                if full < n and length in self.left:
                    more = self.left[length]
                    self._place(length, more, first + full, more, self.capacity - room)
                    keep(room - more * length, first + full, 1)
                keep(room, first + full + (more > 0), n - full - (more > 0))


def _places(rows: list[tuple]):
    """Looks up the place of (length, rank) in the plan."""
    plan = np.array(sorted(rows), np.int64).reshape(-1, 6)
    key = (plan[:, 0] << 48) | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            missing = batch.column("_rank").is_null().to_numpy(zero_copy_only=False)
            rank = pa.compute.fill_null(batch.column("_rank"), 0).to_numpy()
            length = np.where(missing, 0, pa.compute.fill_null(batch.column("length"), 0).cast(pa.int64()).to_numpy())
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            if len(plan):
                own = plan[np.maximum(0, np.searchsorted(key, (length << 48) | rank, "right") - 1)]
                turn = rank - own[:, 1]
                sequence, offset = own[:, 3] + turn // own[:, 4], own[:, 5] + turn % own[:, 4] * length
            columns = batch.drop_columns(["_rank"])
            yield pa.RecordBatch.from_arrays([*columns.columns, pa.array(sequence, mask=missing), pa.array(offset, mask=missing)], names=[*columns.schema.names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows with sequence_id (from 0) and offset. pieces: `length`, and whatever else."""
    prepared(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset", "_number", "_rank")
    stored = written(pieces.withColumn("_number", F.monotonically_increasing_id()), "pieces")
    placed = F.col("length") >= 1
    counts = stored.where(placed).groupBy(F.least("length", F.lit(capacity + 1)).alias("length")).count().collect()  # capacity + 1 rows at most
    plan = Plan({int(r["length"]): r["count"] for r in counts}, capacity)
    ranked = running_before(stored.where(placed), ["length"], F.shiftright("_number", BLOCK_BITS), ["_number"], out="_rank").unionByName(stored.where(~F.coalesce(placed, F.lit(False))).withColumn("_rank", F.lit(None).cast("long")))
    out = St.StructType([*pieces.schema.fields, St.StructField("sequence_id", St.LongType()), St.StructField("offset", St.LongType())])
    return ranked.select(*(F.col(f"`{c}`") for c in pieces.columns), "_rank").mapInArrow(_places(plan.rows), out)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of each sequence, from the pieces' `ids`; a sequence has no more than its capacity."""
    parts = packed.where("sequence_id is not null").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (x, p) -> x || p.ids)").alias("ids"))


def word_tokens(path: str | None = None) -> Tokens:
    import public_tokenizers

    return WordBpe(path or public_tokenizers.path("word_bpe_49k.json"))


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = token_pieces(docs, word_tokens()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
