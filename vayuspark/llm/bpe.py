"""Byte-level BPE: each distinct pre-token of the corpus is encoded once, in a shuffle by word.

1. Texts are cut into pre-tokens by the pattern. A chunk is a run of texts of one task, bounded by `CHUNK_BYTES` of text and
   `CHUNK_WORDS` distinct words (or one text). Its positions are stored as numbers of its distinct words, in order; the words
   themselves leave it once each, in packets by word hash. The stored table is the only copy of the positions.
2. Packets meet by word hash. A word is encoded when it first comes up; packets go back to their chunk with ids.
3. Packets of ids and the positions of a chunk are joined by chunk number, and ids are put together by position.

A packet holds a word once for each chunk, however often the chunk repeats it, so common words are no hot keys: what a
bucket reads is at most a word's chunks. Decoding joins the table of token bytes, which is as large as the vocabulary
file (checked) and goes to every task; ids that it lacks are an error.

Defined results: null and empty texts have no tokens and decode to nothing; special tokens are ordinary text; repeated
rows are encoded each for itself; further columns stay (the operator's own columns replace columns of the same name).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as St
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vayuspark.llm import text as words_
from vayuspark.llm.tables import table, written_by

CHUNK_BYTES = 16 << 20
CHUNK_WORDS = 250_000
MOST_BUCKETS = 4096
#: Words of a bucket that a task remembers; past that it starts anew, so a word may be encoded again.
KNOWN_WORDS = 1_000_000
MAX_VOCABULARY_BYTES = 32 << 20
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class Vocabulary:
    """A rank file and the pattern that splits texts; sent to tasks as the file's bytes, built once in each worker."""

    _built: dict[int, object] = {}

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers

        path = path or public_tokenizers.path(VOCABULARY)
        if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes, too large to send to every task")
        with open(path, "rb") as file:
            self.data = file.read()
        self.pattern = pattern or public_tokenizers.PATTERN

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.data.splitlines()) if token}

    def _once(self, kind: str, build):
        key = hash((kind, self.data, self.pattern))
        if key not in self._built:
            self._built[key] = build()
        return self._built[key]

    def encoder(self):
        import tiktoken

        return self._once("encoder", lambda: tiktoken.Encoding("file", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={}))

    def splitter(self):
        import regex

        return self._once("splitter", lambda: regex.compile(self.pattern))

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The table of token bytes: for each id where its bytes start, how many there are (-1: no such id), and all bytes."""

        def build():
            ranks = sorted((rank, token) for token, rank in self.ranks().items())
            at, size = np.zeros(ranks[-1][0] + 1, np.int64), np.full(ranks[-1][0] + 1, -1, np.int64)
            data = b"".join(token for _, token in ranks)
            ids, sizes = np.array([r for r, _ in ranks]), np.array([len(t) for _, t in ranks])
            size[ids], at[ids] = sizes, np.cumsum(sizes) - sizes
            return at, size, np.frombuffer(data, np.uint8)

        return self._once("bytes", build)


def _press(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte of equal weight, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return _press(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


#: A row is either texts of a chunk (rows, counts, positions) or a packet of its words (bucket, numbers, words).
_CUT = St.StructType([
    St.StructField("chunk", St.LongType()), St.StructField("bucket", St.IntegerType()), St.StructField("keys", St.BinaryType()),
    St.StructField("counts", St.BinaryType()), St.StructField("positions", St.BinaryType()), St.StructField("numbers", St.BinaryType()),
    St.StructField("sizes", St.BinaryType()), St.StructField("words", St.BinaryType()),
])
_CUT_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in _CUT.names[2:]])
_CODED = St.StructType([St.StructField("chunk", St.LongType()), St.StructField("numbers", St.BinaryType()), St.StructField("sizes", St.BinaryType()), St.StructField("ids", St.BinaryType())])


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _cut(vocabulary, buckets: int):
    """Pre-tokens of texts as rows of `_CUT`; keys are the other columns of the texts as an Arrow stream."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = vocabulary.value.splitter().findall
        base, chunk, size, numbers = TaskContext.get().partitionId() << 32, 0, 0, _Numbers()

        def packets() -> Iterator[pa.RecordBatch]:
            spelled = [w.encode() for w in numbers]
            if not spelled:
                return
            hashes = words_.words_of(pa.array(spelled, pa.binary()), b"").hash  # a word is never empty
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((np.arange(len(spelled)), bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[edges[b] : edges[b + 1]]
                if len(own):
                    parts = [spelled[i] for i in own.tolist()]
                    yield _rows([{"chunk": base + chunk, "bucket": b, "numbers": pack(own), "sizes": pack(np.array([len(p) for p in parts])), "words": _press(b"".join(parts))}], _CUT_ARROW)

        for piece in words_.pieces(batches, "text"):
            own = int(words_.buffer_of(piece.column("text"))[1][-1])
            if size and (size + own > CHUNK_BYTES or len(numbers) > CHUNK_WORDS):
                yield from packets()
                chunk, size, numbers = chunk + 1, 0, _Numbers()
            size += own
            counts, found = [], []
            get = numbers.__getitem__
            for value in piece.column("text"):
                tokens = split(value.as_py() or "")
                counts.append(len(tokens))
                found.append(np.fromiter(map(get, tokens), np.uint32, len(tokens)))
            rest = piece.drop_columns(["text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as stream:
                stream.write_batch(rest)
            positions = np.concatenate(found) if found else np.zeros(0, np.uint32)
            yield _rows([{"chunk": base + chunk, "keys": sink.getvalue().to_pybytes(), "counts": pack(np.array(counts, np.uint32)), "positions": pack(positions)}], _CUT_ARROW)
        yield from packets()

    return cut


def _encode_words(vocabulary):
    """Packets of words to packets of ids; rows of one bucket come together, a word is encoded when first seen."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_ids = vocabulary.value.encoder()._encode_single_piece
        bucket, known = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                ends = np.cumsum(unpack(row["sizes"]).astype(np.int64)).tolist()
                words, at, out = zstandard.ZstdDecompressor().decompress(row["words"]), 0, []
                for end in ends:
                    word = words[at:end]
                    at = end
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN_WORDS:
                            known = {}
                        ids = known[word] = piece_ids(word)
                    out.append(ids)
                sizes = np.array([len(x) for x in out], np.uint32)
                ids = np.fromiter((i for x in out for i in x), np.uint32, int(sizes.sum()))
                yield _rows([{"chunk": row["chunk"], "numbers": row["numbers"], "sizes": pack(sizes), "ids": pack(ids)}], _CODED_ARROW)

    return encode


_CODED_ARROW = pa.schema([("chunk", pa.int64()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])


def gather(at: np.ndarray, size: np.ndarray, data: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs data[at[p] : at[p] + size[p]] of the picks one after another, and their sizes."""
    sizes = size[picks]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(at[picks] - (ends - sizes), sizes)
    return data[shift + np.arange(total)], sizes


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The columns of docs but `text`, with ids (array of int) and n_tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary or Vocabulary())
    docs = docs.drop("ids", "n_tokens").withColumn("text", F.col("text").cast("string"))
    rest = [f for f in docs.schema.fields if f.name != "text"]
    inputs = docs.rdd.getNumPartitions()
    buckets = min(MOST_BUCKETS, max(32, inputs))  # a chunk has a packet for each
    # As many parts as an exchange would have, so that the join by chunk leaves the positions where they are.
    parts = min(100_000, max(inputs, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cut = written_by(docs.mapInArrow(_cut(shared, buckets), _CUT), "chunk", parts, "cut")
    packets = cut.where("bucket is not null").select("chunk", "bucket", "numbers", "sizes", "words")
    coded = packets.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(shared), _CODED)
    texts = cut.where("positions is not null").select("chunk", "keys", "counts", "positions")
    out = St.StructType([*rest, St.StructField("ids", St.ArrayType(St.IntegerType())), St.StructField("n_tokens", St.LongType())])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, sizes, ids, done = [], [], [], []
        for row in right.to_pylist():
            numbers.append(unpack(row["numbers"]))
            sizes.append(unpack(row["sizes"]))
            ids.append(unpack(row["ids"]))
        if numbers:
            number, counted, flat = np.concatenate(numbers).astype(np.int64), np.concatenate(sizes).astype(np.int64), np.concatenate(ids).astype(np.int32)
            at, size = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
            at[number], size[number] = np.cumsum(counted) - counted, counted
        else:
            at, size, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for row in left.to_pylist():
            keys = pa.ipc.open_stream(row["keys"]).read_all().combine_chunks()
            counts = unpack(row["counts"]).astype(np.int64)
            found, widths = gather(at, size, flat, unpack(row["positions"]).astype(np.int64))
            edges = np.concatenate([[0], np.cumsum(widths)])
            lengths = np.diff(edges[np.concatenate([[0], np.cumsum(counts)])])
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in keys.columns]
            columns += [words_.lists(found, lengths, pa.int32()), pa.array(lengths, pa.int64())]
            done.append(pa.RecordBatch.from_arrays(columns, names=out.names))
        return pa.Table.from_batches(done)

    return texts.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(assemble, out)


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The same rows with the bytes of their ids in `decoded`."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary())
    encoded = encoded.drop("decoded")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, data = shared.value.token_bytes()
        for batch in batches:
            step = 256
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                ids = part.column("ids")
                flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.array([0 if n is None else n for n in pa.compute.list_value_length(ids).to_pylist()], np.int64)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(size) or (size[flat] < 0).any()):
                    raise ValueError("an id has no token in this vocabulary")
                found, widths = gather(at, size, data, flat)
                edges = np.concatenate([[0], np.cumsum(widths)])
                ends = edges[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(found.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(join, St.StructType([*encoded.schema.fields, St.StructField("decoded", St.BinaryType())]))


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary()
    tokens = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    return tokens.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
