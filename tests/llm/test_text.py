"""Words, hashes and windows against regular expressions and lists."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import cases  # noqa: E402

from vayuspark.llm import text as T  # noqa: E402


@pytest.mark.parametrize("marks", [False, True])
@pytest.mark.parametrize("lower", [False, True])
def test_words(marks, lower):
    texts = [r[1] for r in cases.documents()]
    column = pa.array(["pad", *texts]).slice(1)
    found = T.words_of(column, T.MARKS if marks else T.SPACES, lower)
    raw, _ = T.buffer_of(column)
    got = [[] for _ in texts]
    for r, s, e in zip(found.row, found.start, found.end, strict=True):
        got[r].append(raw[s:e].tobytes().decode())
    pattern = cases.MARKED if marks else cases.WORD
    if marks and not lower:
        return
    want = [pattern.findall((t or "").translate(cases.LOWER) if lower else t or "") for t in texts]
    assert [[w.translate(cases.LOWER) for w in g] if lower else g for g in got] == want
    spelled = [w.encode() for g in want for w in g]
    by = {}
    for w, h in zip(spelled, found.hash.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    for k in (1, 2, 3, 7, 10, 13):
        at, h = T.windows(found, k)
        assert len(at) == sum(max(0, len(g) - k + 1) for g in want)
        seen = {}
        for i, x in zip(at.tolist(), h.tolist(), strict=True):
            assert seen.setdefault(x, spelled[i : i + k]) == spelled[i : i + k]


def test_long_words_and_pieces():
    rnd = random.Random(2)
    texts = ["a" * (3 * T.BLOCK), "b " * 10, "a" * (3 * T.BLOCK), "", None, "c" * 5]
    found = T.words_of(pa.array(texts))
    assert found.hash[0] == found.hash[11] and len(found.hash) == 13
    batch = pa.RecordBatch.from_arrays([pa.array([("x" * rnd.randint(0, 50)) for _ in range(200)] + [None, "y" * 1000])], names=["text"])
    parts = list(T.pieces(iter([batch]), "text", 100))
    assert sum(p.num_rows for p in parts) == batch.num_rows
    assert all(p.num_rows == 1 or len(T.buffer_of(p.column("text"))[0]) <= 100 for p in parts)


def test_covered_and_without():
    marks = T.covered(np.array([1, 3]), 2, 7)
    assert marks.tolist() == [False, True, True, True, True, False, False]
    raw = b"one  two\nthree four "
    found = T.words_of(pa.array([raw.decode()]))
    assert T.without(raw, found.start, found.end, np.array([False, True, False, False])) == b"one  three four "
