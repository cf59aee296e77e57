"""Queries against their SQL twins, the pipeline against plain versions of its stages."""

import itertools
import os
import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))

import cases  # noqa: E402
from check import TABLES, rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from vayuspark.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@pytest.mark.parametrize("name", list(ORACLES))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert [n for n in entry.queries() if n.startswith("op")] == sorted((n for n in entry.queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))


def test_pipeline(spark):
    from vayuspark.llm.bpe import Vocabulary

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        steps[name] = {r.doc_id: r.text for r in now.collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = steps["quality"]
    assert all(before[i] == t for i, t in good.items()) and sum((i in good) == bool(q) for i, q in labels.items()) >= 0.97 * len(labels)

    def shingles(text):
        own = cases.words((text or "").translate(cases.LOWER))
        return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()

    sets = {i: shingles(t) for i, t in good.items()}
    top = cases.grouped([(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    assert steps["near_duplicates"] == {i: t for i, t in good.items() if top[i] == i}

    size, first, left = corpus_pipeline.PASSAGE, {}, {}
    for i, t in sorted(steps["near_duplicates"].items()):
        own = cases.words(t)
        for k in range(len(own) - size + 1):
            first.setdefault(tuple(own[k : k + size]), i)
    for i, t in steps["near_duplicates"].items():
        own = cases.words(t)
        gone = {j for k in range(len(own) - size + 1) if first[tuple(own[k : k + size])] < i for j in range(k, k + size)}
        if len(gone) < len(own) or not own:
            left[i] = [w for j, w in enumerate(own) if j not in gone]
    assert {i: cases.words(t) for i, t in steps["repeated_passages"].items()} == left

    items = [cases.MARKED.findall((r.text or "").translate(cases.LOWER)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(own[i : i + min(10, len(own))]) for own in items for i in range(len(own) - min(10, len(own)) + 1) if own}
    clean = {}
    for i, t in steps["repeated_passages"].items():
        own = cases.MARKED.findall((t or "").translate(cases.LOWER))
        hit = {j for k in {len(g) for g in grams} for at in range(len(own) - k + 1) if tuple(own[at : at + k]) in grams for j in range(at, at + k)}
        if not hit or len(hit) < len(own) * 0.5:
            clean[i] = [w for j, w in enumerate(own) if j not in hit]
    assert {i: cases.MARKED.findall((t or "").translate(cases.LOWER)) for i, t in steps["benchmarks"].items()} == clean
    assert all(r.n_chars == len(r.text) for r in now.collect())

    encoder = Vocabulary().encoder()
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    texts = steps["benchmarks"]
    assert {r.doc_id: (list(r.ids), r.decoded_sha256) for r in out} == {i: (encoder.encode_ordinary(t or ""), cases.sha(t or "")) for i, t in texts.items()}


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
