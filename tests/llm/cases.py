"""Small tables with everything awkward in them, and what the operators should give, worked out plainly."""

import hashlib
import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Names that the operators use themselves.
EXTRA = ["n_words", "n_removed", "clean_text", "ids", "n_tokens", "decoded", "items", "spans", "n_hit", "statistics", "raw", "score", "w", "c", "is_copy", "own", "size", "key", "node", "label"]
DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())] + [T.StructField(x, T.StringType()) for x in EXTRA])


def documents(seed=1):
    rnd = random.Random(seed)
    vocabulary = ["Word%d" % i for i in range(400)] + ["é%d" % i for i in range(50)] + ["x", "I'm", "42", "...", "　wide", "naïve", "日本語", "a\x1cb", "\xa0nbsp"]
    gaps = [" ", " ", " ", "\n", "\t", "  ", "\r\n", "\x0b"]
    make = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice(gaps) for _ in range(n))
    base = [make(n) for n in (0, 1, 2, 3, 5, 12, 13, 14, 40, 80, 120, 200, 300)]
    texts = list(base) + ["", "   \n", None, None]
    texts += [base[9], base[9], base[10].upper(), base[10] + " more"]  # copies, and near ones
    for _ in range(6):  # copies with a few changes
        words = base[11].split(" ")
        for _ in range(rnd.randint(1, 14)):
            words[rnd.randrange(len(words))] = "new%d" % rnd.randrange(10**6)
        texts.append(" ".join(words))
    passage = make(60)
    texts += [make(20) + passage + make(10), passage, make(3) + passage]
    texts += ["same word " * 300, "same word " * 20, make(6000)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows += [rows[4], rows[4], (None, base[9]), (None, "no number " * 9), (None, None)]
    return [(i, t, rnd.choice(["en", None]), "s", None, *["7"] * len(EXTRA)) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCUMENTS).repartition(5)


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def grouped(pairs, nodes):
    """The smallest node that each one reaches."""
    over = {n: n for n in nodes}

    def top(n):
        while over[n] != n:
            n = over[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        over[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
