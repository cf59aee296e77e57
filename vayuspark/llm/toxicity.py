"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel of two words sums over the letter triples both hold in order, within `SPAN` letters, each gap weighing `DECAY`;
it is divided by the words' own sizes. So an insult still resembles itself with letters put in or left out, or with another
ending. Letters are lower-cased, marks inside a word are skipped, digits read as the letters they look like, and single
letters that follow each other are one word.

Landmarks are the words that set toxic documents apart most, and common words of clean ones. The machine is trained on
labelled sentences, each standing for its worst word, chosen anew in each round: clean are those of clean documents, toxic
those of a toxic document that hold a landmark of the first kind (without any landmark, each toxic document is one sentence). As the kernel has explicit features, the trained machine is one weight
for each triple, and scoring a text takes one look-up for each of its triples. A document is judged by its worst words and
how many there are (one look-alike in a long text is no insult), weighed by a logistic regression over decisions of
machines that had not seen the document, and made a chance by isotonic calibration on all labelled rows.

The fit reads about `FIT_DOCS` labelled documents of each class, drawn at random by their number, and all sentences of these,
those of more than `FIT_CHARS` characters in pieces; scoring reads all texts whole.

Defined results: null and empty texts and texts without words of three letters score lowest; without toxic labels in the
fit every score is the share of label 1; labels that are neither 0 nor 1 are not used; a doc_id with several labels is
toxic if one says so; repeated rows are scored each for itself.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as St
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vayuspark.llm import text as words_
from vayuspark.llm.calibrate import isotonic, remainder
from vayuspark.llm.tables import table, written

FIT_DOCS, FIT_CHARS = 600, 1000
LANDMARKS, PLAIN_LANDMARKS = 160, 40
#: Standard errors by which a word must be commoner in toxic documents to be a landmark of the first kind.
SURE = 4.0
DECAY, SPAN = 0.7, 5
ROUNDS, PENALTY = 4, 1e-3
LOWEST, HIGHEST = -3.0, 3.0
#: Ends of the decision for a whole text.
LOW, HIGH = -20.0, 20.0

#: Letters as numbers from 1 to 26, second bytes of other letters (alike in upper and lower case) from 32; 0 is skipped.
_LETTER = np.zeros(256, np.int64)
for _k in range(26):
    _LETTER[[ord("a") + _k, ord("A") + _k]] = _k + 1
for _digit, _alike in zip("013457", "oieast", strict=True):
    _LETTER[ord(_digit)] = ord(_alike) - ord("a") + 1
_LETTER[0x80:0xC0] = 32 + (np.arange(0x80, 0xC0) & 0x1F)
TRIPLES = 64**3
#: Places of the second and third letter after the first, and the weight.
_OFFSETS = [(i, j, DECAY ** (j - 2)) for j in range(2, SPAN) for i in range(1, j)]


class Letters:
    """Letters of the words of a piece, word by word; row: of each word, rising."""

    def __init__(self, column: pa.Array):
        raw, _ = words_.buffer_of(column)
        found = words_.words_of(column, hashed=False)
        inside = np.ones(256, bool)
        inside[list(words_.SPACES)] = False
        letters = _LETTER[raw[inside[raw]]]
        word = np.repeat(np.arange(len(found.start)), found.end - found.start)
        self.letter, word = letters[letters > 0], word[letters > 0]
        counts = np.bincount(word, minlength=len(found.start))
        real = np.flatnonzero(counts)
        single = counts[real] == 1
        joined = np.zeros(len(real), bool)
        joined[1:] = single[1:] & single[:-1] & (found.row[real][1:] == found.row[real][:-1])
        group = np.cumsum(~joined) - 1
        self.row = found.row[real][~joined]
        self.first = real[~joined]
        self.word = np.repeat(group, counts[real])

    def triples(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(word, triple, weight) for each place of the letters."""
        for i, j, weight in _OFFSETS:
            ok = np.flatnonzero(self.word[j:] == self.word[:-j]) if len(self.word) > j else np.zeros(0, np.int64)
            yield self.word[ok], (self.letter[ok] << 12) | (self.letter[ok + i] << 6) | self.letter[ok + j], weight

    def scores(self, weights: np.ndarray, bias: float = 0.0) -> np.ndarray:
        """The weighted triples of each word over the word's size, and whether it has any."""
        n = len(self.row)
        total, size = np.zeros(n), np.zeros(n)
        for word, triple, weight in self.triples():
            total += np.bincount(word, weights=weights[triple] * weight, minlength=n)
            size += np.bincount(word, minlength=n) * weight**2
        return np.where(size > 0, total / np.sqrt(np.maximum(size, 1e-12)) + bias, LOWEST)


def own_weights(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The triples that some word has, and for each word their weights over its size: its kernel is their product with another word's."""
    parts = []
    for k, word in enumerate(words):
        found = [(np.full(len(triple), k), triple, np.full(len(triple), weight)) for _, triple, weight in Letters(pa.array([word])).triples()]
        row, triple, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        parts.append((row, triple, weight / np.sqrt(max((weight**2).sum(), 1e-12))))
    row, triple, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    used, place = np.unique(triple, return_inverse=True)
    out = np.zeros((len(words), len(used)), np.float32)
    np.add.at(out, (row, place), weight)
    return used, out


def _kernel(words: list[str], used: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Of every word with every landmark."""
    own, n = Letters(pa.array(words)), len(words)
    place = np.full(TRIPLES, -1, np.int32)
    place[used] = np.arange(len(used))
    size, parts = np.zeros(n), []
    for word, triple, weight in own.triples():
        word = own.row[word]  # a word is one row here, but may have lost all letters
        size += np.bincount(word, minlength=n) * weight**2
        at = place[triple]
        parts.append((word[at >= 0].astype(np.int32), at[at >= 0], np.full(int((at >= 0).sum()), weight, np.float32)))
    word, at, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    out = np.empty((n, len(tables)), np.float32)
    for k, table_ in enumerate(tables):
        out[:, k] = np.bincount(word, weights=table_[at] * weight, minlength=n)
    return out / np.sqrt(np.maximum(size, 1e-12))[:, None].astype(np.float32)


def train(sentences: list[tuple[int, int, str]]) -> tuple[np.ndarray, float]:
    """Weights of the triples and the bias, from (document, label, sentence)."""
    spelled = [(doc, y, [w for w in sentence.lower().split() if sum(c.isalnum() for c in w) >= 3]) for doc, y, sentence in sentences]
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for y in (0, 1):
        for _, word in {(doc, w) for doc, label, words in spelled if label == y for w in words}:
            seen[y][word] += 1
    docs = [max(1, len({doc for doc, label, _ in spelled if label == y})) for y in (0, 1)]
    if not seen[1]:
        return np.zeros(TRIPLES, np.float32), 0.0
    apart = {w: n / docs[1] - 3 * seen[0][w] / docs[0] for w, n in seen[1].items()}

    def surely(word: str) -> bool:
        both = (seen[0][word] + seen[1][word]) / (docs[0] + docs[1])
        gap = seen[1][word] / docs[1] - seen[0][word] / docs[0]
        return gap >= SURE * np.sqrt(both * (1 - both) * (1 / docs[0] + 1 / docs[1]))

    insults = sorted((w for w in apart if apart[w] > 0 and surely(w)), key=lambda w: (-apart[w], w))[: LANDMARKS - PLAIN_LANDMARKS]
    telling = set(insults)
    plain = [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0])) if w not in insults][:PLAIN_LANDMARKS]
    landmarks = insults + plain
    if not landmarks:
        return np.zeros(TRIPLES, np.float32), 0.0
    used, tables = own_weights(landmarks)
    names = sorted({w for _, _, words in spelled for w in words})
    number = {w: k for k, w in enumerate(names)}
    kernel = _kernel(names, used, tables)
    among = kernel[[number[w] for w in landmarks]]
    value, vector = np.linalg.eigh((among + among.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) * (value > 1e-6)  # Nystroem: kernel @ root are the features
    x = np.column_stack([kernel @ root.astype(np.float32), np.ones(len(names), np.float32)])
    del kernel
    whole: dict[int, list[int]] = {}
    marked: dict[int, list[list[int]]] = {}
    plain_bags = []
    for doc, y, words in spelled:
        if y:
            whole.setdefault(doc, []).extend(number[w] for w in words)
            if any(w in telling for w in words):
                marked.setdefault(doc, []).append([number[w] for w in words])
        elif words:
            plain_bags.append([number[w] for w in words])
    bags = [(bag, 1 / len(marked.get(doc, [0]))) for doc, every in whole.items() for bag in marked.get(doc, [] if marked else [every]) if bag]
    score = np.array([apart.get(w, -1.0) for w in names])
    weights = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        worst = lambda bag: max(bag, key=score.__getitem__)  # noqa: E731, B023
        yes: Counter = Counter()
        for bag, share in bags:
            yes[worst(bag)] += share
        no = Counter(worst(b) for b in plain_bags)
        rows = np.array([*yes, *no])
        y = np.array([1.0] * len(yes) + [-1.0] * len(no))
        n = np.array([*yes.values(), *no.values()], float)
        n[y > 0] /= n[y > 0].sum()
        n[y < 0] /= max(n[y < 0].sum(), 1)
        weights = _squared_hinge(x[rows].astype(float), y, n)
        score = x @ weights
    alpha = root @ weights[:-1]
    out = np.zeros(TRIPLES, np.float32)
    out[used] = alpha @ tables
    return out, float(weights[-1])


def _squared_hinge(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps."""
    ridge = PENALTY * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        margin = y * (x @ w)
        active = margin < 1
        a = x[active] * n[active, None]
        step = np.linalg.solve(a.T @ x[active] + ridge, a.T @ y[active])
        if np.abs(step - w).max() < 1e-8:
            break
        w = step
    return w


EVIDENCE = 7


def evidence(found: Letters, scores: np.ndarray, rows: int) -> np.ndarray:
    """What each row's words say together: the worst words' decisions, and how many are on the toxic side."""
    out = np.zeros((rows, EVIDENCE))
    out[:, 0] = LOWEST
    np.maximum.at(out[:, 0], found.row, np.clip(scores, LOWEST, HIGHEST))
    bad = np.flatnonzero(scores > 0)
    bad = bad[np.lexsort((-scores[bad], found.row[bad]))]
    row = found.row[bad]
    rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
    for column, place in ((1, 1), (2, 2), (3, 4)):
        at = rank == place
        out[row[at], column] = np.minimum(scores[bad][at], HIGHEST)
    words, count = np.bincount(found.row, minlength=rows), np.bincount(row, minlength=rows)
    out[:, 4] = np.log1p(count)
    out[:, 5] = np.sqrt(count / np.maximum(words, 1))
    out[:, 6] = np.log1p(words) / 4
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias (last) of a logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * slope[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Machine:
    """Weights of the triples, and of the evidence of a whole text."""

    def __init__(self, sentences: list[tuple[int, int, str]]):
        """Learn from (document, label, sentence). The evidence is weighed by machines that had not seen the document."""
        docs = sorted({doc: y for doc, y, _ in sentences}.items())
        place = {doc: k for k, (doc, _) in enumerate(docs)}
        labels = np.array([y for _, y in docs], float)
        apart = np.zeros((len(docs), EVIDENCE))
        # Half of each class.
        half = np.where(labels > 0, np.cumsum(labels > 0), np.cumsum(labels <= 0)) % 2
        for fold in (0, 1):
            theirs = [x for x in sentences if half[place[x[0]]] != fold]
            own = [x for x in sentences if half[place[x[0]]] == fold]
            if own:
                weights, bias = train(theirs)
                found = Letters(pa.array([sentence for _, _, sentence in own], pa.string()))
                found.row = np.array([place[doc] for doc, _, _ in own])[found.row]
                order = np.argsort(found.row, kind="stable")
                scores = found.scores(weights.astype(float), bias)[order]
                found.row = found.row[order]
                seen = evidence(found, scores, len(docs))
                mine = half == fold
                apart[mine] = seen[mine]
        self.weights, self.bias = train(sentences)
        self.weights = self.weights.astype(float)
        self.blend = _logistic(apart, labels) if len(docs) else np.zeros(EVIDENCE + 1)
        #: Decisions for the documents of the fit by machines that had not seen them.
        self.apart = dict(zip([doc for doc, _ in docs], self._raw(apart).tolist(), strict=True))

    def _raw(self, seen: np.ndarray) -> np.ndarray:
        return np.clip(seen @ self.blend[:-1] + self.blend[-1], LOW, HIGH)

    def raw(self, column: pa.Array) -> np.ndarray:
        found = Letters(column)
        return self._raw(evidence(found, found.scores(self.weights, self.bias), len(column)))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(r["doc_id"], r["y"], r["sentence"]) for batch in batches for r in batch.to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Machine(sorted(rows)))], pa.binary())], names=["machine"])


def raw_scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """The columns of docs but `text`, with `raw`: the decision for the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop("raw").withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in words_.pieces(batches, "text", words_.PIECE // 4):
            rest = piece.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(shared.value.raw(piece.column("text")))], names=[*rest.schema.names, "raw"])

    return docs.mapInArrow(run, St.StructType([*(f for f in docs.schema.fields if f.name != "text"), St.StructField("raw", St.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: int | None = 2) -> DataFrame:
    """(doc_id, held_out, raw, score) for each row; learnt from labels of rows whose remainder by 4 is not `held_out` (None: from all)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("own")).agg(F.max("toxic").cast("int").alias("y"))
    if held_out is not None:
        known = known.where(remainder("own", 4) != held_out)
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("own"), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, FIT_DOCS / max(1, counts.get(1, 0)))).otherwise(min(1.0, FIT_DOCS / max(1, counts.get(0, 0))))
    drawn = F.broadcast(known.where(draw < share))  # 2 x FIT_DOCS rows in the mean
    ended = docs.join(drawn, F.col("doc_id") == F.col("own")).select("doc_id", "y", F.explode(F.split("text", r"[.!?\n]+")).alias("sentence"))
    # A longer sentence is cut after a word, and a longer word anywhere.
    pieces = F.regexp_extract_all("sentence", F.lit(r"(?s).{1,%d}(?=\s|$)|.{1,%d}" % (FIT_CHARS, FIT_CHARS)), F.lit(0))
    sentences = ended.select("doc_id", "y", F.explode(pieces).alias("sentence")).where(F.length("sentence") >= 3)
    learnt = sentences.repartition(1).mapInArrow(_learn, "machine binary").first()  # a bounded sample
    machine = pickle.loads(learnt[0]) if learnt else Machine([])
    apart = spark.createDataFrame(list(machine.apart.items()) or [(0, 0.0)], "fitted long, apart double").where(F.lit(bool(machine.apart)))
    machine.apart = {}
    scored = written(raw_scores(docs, machine), "raw")
    seen = scored.join(known, F.col("doc_id") == F.col("own")).join(F.broadcast(apart), F.col("own") == F.col("fitted"), "left")
    knots = isotonic(seen.select(F.coalesce("apart", "raw").alias("raw"), "y"), LOW, HIGH)
    shared = spark.sparkContext.broadcast(knots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.clip(np.interp(batch.column("raw").to_numpy(zero_copy_only=False), *shared.value), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"])

    out = scored.mapInArrow(run, St.StructType([*scored.schema.fields, St.StructField("score", St.DoubleType())]))
    return out.select("doc_id", (remainder("doc_id", 4) == (2 if held_out is None else held_out)).alias("held_out"), "raw", "score")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
