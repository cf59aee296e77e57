"""Each operator against a plain version, on tables with nulls, empty, long and repeated rows, and on empty tables."""

import hashlib
import itertools
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import cases  # noqa: E402

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    from vayuspark.llm.tables import prepared

    prepared(spark)
    return cases.frame(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return spark.createDataFrame([], cases.DOCUMENTS)


def test_components(spark):
    from vayuspark.llm.graph import components

    rnd = random.Random(4)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(400, x) for x in range(401, 450)] + [(9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == cases.grouped([p for p in pairs if p[0] != p[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_minhash(spark, docs, words, percent):
    from vayuspark.llm.minhash import near_duplicates

    def shingles(text):
        own = cases.words((text or "").translate(cases.LOWER))
        return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()

    rows = [(r[0], r[1]) for r in cases.documents()]
    sets = {i: shingles(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top = cases.grouped(links, sets)
    want = Counter((i, len(shingles(t)), None if i is None else top[i], i is None or top[i] == i) for i, t in rows)
    assert len(links) > 5
    got = Counter(tuple(r) for r in near_duplicates(docs, words, percent).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == want


def test_minhash_around_a_hub(spark):
    """Copies of one text of which many are too far from it and from each other, so that pairs are tried in tiles."""
    from vayuspark.llm import minhash

    rnd = random.Random(5)
    base = ["w%d" % i for i in range(150)]
    rows = [(1, " ".join(base))]
    for i in range(2, 200):
        own = list(base)
        for at in rnd.sample(range(150), rnd.choice([2, 5, 9, 12])):
            own[at] = "n%d" % rnd.randrange(10**7)
        rows.append((i, " ".join(own)))
        if i % 9 == 0:
            rows.append((1000 + i, " ".join([*own[:-1], "end"])))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    top = cases.grouped(links, sets)
    assert len(set(top.values())) > 20 and got == top


def test_minhash_pairs_with_unequal_signatures(spark):
    """Pairs at the threshold around different hubs that share a key, though more than 15 of their 40 values differ."""
    from vayuspark.llm import minhash

    rows = []
    for k, seed in enumerate([18126, 19413, 23490, 37942, 38136, 40105, 41915, 60696, 75643, 76351, 78664, 104339, 106729, 110744, 114998, 116887]):
        rnd = random.Random(seed)
        a = ["w%d" % rnd.randrange(10**9) for _ in range(26)]
        # The first two are linked; around each stand longer copies, linked with that one only, the first of which is its hub.
        more = [["y%d.%d" % (k, j), *a[:21]] for j in range(3)] + [[*a[2:26], "z%d.%d" % (k, j)] for j in range(3)]
        rows += [(10 * k + i, " ".join(own)) for i, own in enumerate([a[2:21], a[2:24], a[:21], a[2:26], *more])]
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert sum((10 * k, 10 * k + 1) in links for k in range(16)) == 16 and not any(a % 10 in (0, 2, 4, 5, 6) and b % 10 in (1, 3, 7, 8, 9) for a, b in links if (a % 10, b % 10) != (0, 1))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == cases.grouped(links, sets)


def test_tile_columns(monkeypatch):
    from vayuspark.llm import minhash

    monkeypatch.setattr(minhash, "COLUMNS", 3)
    rnd = random.Random(6)
    sets = [set(rnd.sample(range(30), rnd.randint(1, 12))) for _ in range(25)]
    flat = np.array([x for s in sets for x in sorted(s)])
    label = minhash.hang_together(flat, np.array([len(s) for s in sets]), 60)
    links = [(a, b) for a, b in itertools.combinations(range(25), 2) if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])]
    assert dict(enumerate(label.tolist())) == cases.grouped(links, range(25))


@pytest.mark.parametrize("window", [13, 4])
def test_substring(docs, window):
    from vayuspark.llm.substring import remove_repeats

    rows = [(r[0], r[1]) for r in cases.documents()]
    first = {}
    for i, t in rows:
        own = cases.words(t)
        for k in range(len(own) - window + 1):
            if i is not None:
                first[tuple(own[k : k + window])] = min(i, first.get(tuple(own[k : k + window]), i))
    want = Counter()
    for i, t in rows:
        own = cases.words(t)
        gone = {j for k in range(len(own) - window + 1) if i is not None and first[tuple(own[k : k + window])] < i for j in range(k, k + window)}
        want[(i, len(own), len(gone), " ".join(w for j, w in enumerate(own) if j not in gone))] += 1
    assert sum(x[2] > 0 for x in want) > 5
    found = remove_repeats(docs, window)
    assert set(docs.columns) <= set(found.columns)
    got = Counter((r.doc_id, r.n_words, r.n_removed, " ".join(cases.words(r.clean_text))) for r in found.collect())
    assert got == want


def test_bpe(spark, docs):
    from vayuspark.llm.bpe import Vocabulary, decode, encode

    vocabulary = Vocabulary()
    encoder = vocabulary.encoder()
    got = decode(encode(docs, vocabulary), vocabulary)
    rows = [(r.doc_id, r.lang, r.n_tokens, tuple(r.ids), bytes(r.decoded)) for r in got.collect()]
    want = []
    for r in cases.documents():
        ids = encoder.encode_ordinary(r[1] or "")
        want.append((r[0], r[2], len(ids), tuple(ids), (r[1] or "").encode()))
    assert Counter(rows) == Counter(want)
    with pytest.raises(Exception, match="no token"):
        decode(spark.createDataFrame([([10**6],)], "ids array<int>"), vocabulary).collect()


def test_bpe_small_chunks(monkeypatch):
    """Several chunks of one task, through the functions themselves."""
    import pyarrow as pa

    from vayuspark.llm import bpe

    class Shared:
        value = bpe.Vocabulary()

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(bpe, "CHUNK_BYTES", 500)
    monkeypatch.setattr(bpe, "TaskContext", Context)
    monkeypatch.setattr(bpe.words_, "PIECE", 100)
    texts = [r[1] for r in cases.documents()]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part))), pa.array(part, pa.string())], names=["n", "text"]) for k, part in ((i, texts[i : i + 4]) for i in range(0, len(texts), 4))]
    rows = [r for b in bpe._cut(Shared, 5)(iter(batches)) for r in b.to_pylist()]
    assert len({r["chunk"] for r in rows}) > 2 and {r["bucket"] for r in rows} == {None, 0, 1, 2, 3, 4}


def test_shards(spark, docs):
    from vayuspark.llm import shard

    one, two = shard.slot_map(16), shard.slot_map(17)
    assert two == shard.grown(one) and all(a == b or b == 16 for a, b in zip(one, two, strict=True))
    sizes = Counter(two)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    rnd = random.Random(7)
    load = {k: rnd.choice([1, 5, 1000]) for k in range(4096)}
    better = shard.rebalanced(one, load)
    total = lambda m: Counter({s: sum(load[k] for k in range(4096) if m[k] == s) for s in range(16)})
    assert max(total(better).values()) <= max(total(one).values()) and max(total(better).values()) < 1.03 * sum(load.values()) / 16
    placed = shard.numbered(shard.with_slot(docs.select("doc_id", "text")).withColumn("shard", F.col("virtual_slot") % 3)).collect()
    by = defaultdict(list)
    for r in placed:
        by[r.shard].append(r.slot)
    assert len(placed) == docs.count() and all(sorted(x) == list(range(len(x))) for x in by.values())
    store = shard.MapStore(spark, shard.run_dir(spark, "maps"))
    store.save(16, one)
    with pytest.raises(Exception):
        store.save(16, two)
    assert [r.shard for r in store.load(16).orderBy("virtual_slot").collect()] == one


@needs_tables
def test_shard_query(spark):
    from vayuspark.llm.shard import op6_virtual_slots

    rows = op6_virtual_slots(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key") and r.grown_shard in (r.shard, 16)


def test_embeddings(spark):
    from vayuspark.llm import embeddings

    rnd = np.random.default_rng(8)
    rows, k = [], 0
    for label in (1, 2):
        for group in range(60):
            base = rnd.normal(size=16)
            for _ in range(1 + group % 4):
                rows.append((k, (base + rnd.normal(size=16) * 0.08).tolist(), label))
                k += 1
    hot = rnd.normal(size=16)
    rows += [(k + i, hot.tolist(), 1) for i in range(200)]
    k += 200
    rows += [(k + i, (hot + rnd.normal(size=16) * 0.05).tolist(), 1) for i in range(300)]
    k += 300
    rows += [(k, None, 1), (k + 1, [], 1), (k + 2, [0.0] * 16, 1), (k + 3, [float("nan")] * 16, 1), (k + 4, [None, *[1.0] * 15], 1), (k + 5, [float("inf"), *[1.0] * 15], 1), (k + 6, hot.tolist(), None), (k + 7, hot.tolist()[:8], 1), (None, hot.tolist(), 1), rows[5], rows[5]]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    own = {i: (np.array(v, np.float32).astype(float), g) for i, v, g in rows if i is not None and v and g is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = set()
    for size, label in {(len(v), g) for v, g in own.values()}:
        ids = [i for i in own if (len(own[i][0]), own[i][1]) == (size, label)]
        x = np.stack([own[i][0] for i in ids])
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        links |= {(ids[a], ids[b]) for a, b in np.argwhere(x @ x.T >= 0.93) if a < b}
    top = cases.grouped(links, {r[0] for r in rows if r[0] is not None})
    counts = Counter(n for p in links for n in p)
    want = Counter((r[0], counts[r[0]] if r[0] is not None else 0, top.get(r[0]), r[0] is None or top[r[0]] == r[0]) for r in rows)
    got = Counter(tuple(r) for r in embeddings.near_duplicates(table).collect())
    assert len(links) > 40_000 and got == want
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def _directed(x):
    """Links of each row by brute force."""
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    return linked


def test_embeddings_between_full_lists(spark):
    """Two groups, each tighter inside than the other is away, so that no list of the closest holds a link between them."""
    from vayuspark.llm import embeddings

    rnd = np.random.default_rng(12)
    one, turn = np.linalg.qr(rnd.normal(size=(64, 2)))[0].T
    two = 0.945 * one + (1 - 0.945**2) ** 0.5 * turn
    x = np.concatenate([c + rnd.normal(size=(300, 64)) * 0.004 for c in (one, two)] + [rnd.normal(size=(40, 64))])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    linked = _directed(x)
    top = cases.grouped(np.argwhere(linked).tolist(), range(len(x)))
    assert linked[:300, 300:600].sum() > 80_000
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table).collect()}
    assert got == {i: (int(linked[i].sum()), top[i]) for i in range(len(x))}


def test_embeddings_joined_whole(spark):
    """Balls of several blocks and tiles, single nodes, unequal labels, no components yet: the same as brute force."""
    from vayuspark.llm import embeddings

    rnd = np.random.default_rng(13)
    base = rnd.normal(size=(60, 8))
    x = np.concatenate([b + rnd.normal(size=(12, 8)) * rnd.choice([0.1, 0.3]) for b in base])
    rows = [(i, i % 2, 8, 1, v.tolist()) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "node long, label int, size int, weight long, vector array<double>")
    linked = _directed(x) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    top = cases.grouped(np.argwhere(linked).tolist(), range(len(x)))
    some = {i: c for i, c in top.items() if c % 3 == 0 and linked[i].any()}
    for found in ({}, some):
        got = embeddings.joined(nodes, spark.createDataFrame(list(found.items()), "node long, component long"))
        assert {r.node: r.component for r in got.collect()} == {i: top[i] for i in top if linked[i].any()}


def test_embeddings_audit(spark, monkeypatch):
    """Lists without the links of all small groups beside a hot group: the audit tells, and the result is whole all the same."""
    from vayuspark.llm import embeddings

    rnd = np.random.default_rng(14)
    hot = rnd.normal(size=16)
    x = np.concatenate([hot + rnd.normal(size=(300, 16)) * 0.03] + [b + rnd.normal(size=(3, 16)) * 0.05 for b in rnd.normal(size=(200, 16))])
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    linked = _directed(x)
    top = cases.grouped(np.argwhere(linked).tolist(), range(len(x)))
    assert linked[300:, 300:].sum() > 1000
    nodes = table.select(F.col("vec_id").alias("node"), "label", F.lit(16).alias("size"), F.lit(1).alias("weight"), F.col("embedding").alias("vector"))
    held = lambda keep: spark.createDataFrame([(i, c) for i, c in top.items() if linked[i].any() and keep(i)], "node long, component long")
    assert embeddings.audit(nodes, held(lambda i: True)) == 1
    assert embeddings.audit(nodes, held(lambda i: i < 300)) < 0.1
    # A few nodes of small groups missing weigh as much as if there were no hot group.
    assert embeddings.audit(nodes, held(lambda i: i < 300 or i % 9)) < 0.99

    graph = embeddings.neighbour_graph
    monkeypatch.setattr(embeddings, "ENLARGED", 1)
    monkeypatch.setattr(embeddings, "neighbour_graph", lambda *args: graph(*args).where("u < 300 and v < 300"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(table).collect()}
    assert got == {i: (int(linked[i].sum()), top[i]) for i in range(len(x))}


def test_chat(spark):
    from vayuspark.llm.chat import documents_of, rotate

    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["ann", "bob x", "system", None, " "]), rnd.choice(["hi", "", None, "é\nlong " * 30])) for c in (1, 2, None) for t in range(150)]
    rows += [(3, 0, "system", "alone"), (4, None, "user", "q"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a"), (4, 1, "user", "b")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, at string").repartition(4)
    kept = lambda ch: ch.isascii() and (ch.isalnum() or ch in "_-")
    name = lambda role: "".join(ch if kept(ch) else f"_x{ord(ch):x}_" for ch in role.strip().replace("_x", "_x5f_x")) if (role or "").strip() else "_x_"
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], name(r[2]), r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        for view in {s for _, s, _ in own} - {"system"}:
            text, spans = "", []
            for _, speaker, said in own:
                seen = "system" if speaker == "system" else "assistant" if speaker == view else "user name=" + speaker
                text += f"<|im_start|>{seen}\n"
                if seen == "assistant":
                    spans.append(said + "<|im_end|>")
                text += said + "<|im_end|>\n"
            want[conv, view] = (text, spans)
    rotated = rotate(table)
    plan = rotated._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = defaultdict(list)
    for r in rotated.collect():
        got[r.conv_id, r.perspective].append(r)
    whole = {}
    for key, own in got.items():
        own.sort(key=lambda r: r["at"])
        text = "".join(r.segment for r in own)
        assert [r["at"] for r in own] == list(range(len(own))) and all(text[r.start : r.stop] == r.segment for r in own)
        whole[key] = (text, [text[r.mask_start : r.mask_stop] for r in own if r.mask_start is not None])
    assert whole == want
    parts = defaultdict(list)
    for r in documents_of(rotated).collect():
        parts[r.conv_id, r.perspective].append((r.part, r.text, [r.text[m.start : m.stop] for m in r["mask"]]))
    for key, own in parts.items():
        own.sort()
        assert ("".join(x[1] for x in own), [s for x in own for s in x[2]]) == want[key]
    assert rotate(table.limit(0)).count() == 0


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_decontaminate(spark, docs, most):
    from vayuspark.llm.decontaminate import find_contamination

    texts = [r[1] for r in cases.documents()]
    long = max((t for t in texts if t), key=len)
    cut = cases.MARKED.findall(long.translate(cases.LOWER))
    bench = [("a", " ".join(cut[50:75]).upper()), ("b", " ".join(cut[70:76])), ("b", "zz zz"), ("c", None), ("d", ""), ("e", "same WORD!"), (None, " ".join(cut[200:215])), ("f", "never there at all"), ("f2", " ".join(cut[60:72]))]
    items = spark.createDataFrame([(*b, "x") for b in bench], "item_id string, text string, n_words string")
    windows = []
    for item, text in bench:
        own = cases.MARKED.findall((text or "").translate(cases.LOWER))
        k = min(10, len(own))
        windows += [(item, own[i : i + k]) for i in range(len(own) - k + 1) if k]
    want = Counter()
    for r in cases.documents():
        own = cases.MARKED.findall((r[1] or "").translate(cases.LOWER))
        hit, names = set(), set()
        for item, window in windows:
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    names |= {item} - {None}
        want[(r[0], len(own), len(hit), tuple(sorted(names)), " ".join(w for i, w in enumerate(own) if i not in hit))] += 1
    assert sum(x[2] > 0 for x in want) >= 3
    found = find_contamination(docs, items, broadcast_bytes=most)
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), " ".join(cases.MARKED.findall(r.clean_text.translate(cases.LOWER) if r.clean_text else ""))) for r in found.collect())
    assert got == want
    none = find_contamination(docs, items.limit(0), broadcast_bytes=most if most else -1)
    assert none.where("n_hit > 0").count() == 0 and none.count() == docs.count()


def test_licenses(spark):
    from vayuspark.llm.licenses import scan

    files = [
        ("r/LICENSE", "MIT License\n\nReleased under the MIT License.\nmore words here"), ("r/a/x.py", "import os"), ("r/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        ("r/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("r/a/b/c/z.py", None), ("r/a/b/c/z.py", None), ("q/one.txt", "plain"), ("top.txt", ""), (None, "Released under the MIT License."), ("r/a/long.txt", "word " * 50_000),
    ]
    table = spark.createDataFrame([(*f, "x") for f in files], "path string, text string, license string")
    got = Counter((r.path, r.license, r.how) for r in scan(table).collect())
    want = Counter([
        ("r/LICENSE", "MIT", "file"), ("r/a/x.py", "MIT", "inherited"), ("r/a/b/y.py", "Apache-2.0", "header"), ("r/a/b/COPYING.txt", "GPL-3.0", "file"), ("r/a/b/c/z.py", "GPL-3.0", "inherited"),
        ("r/a/b/c/z.py", "GPL-3.0", "inherited"), ("q/one.txt", None, "none"), ("top.txt", None, "none"), (None, None, "none"), ("r/a/long.txt", "MIT", "inherited"),
    ])
    assert got == want
    assert scan(table.limit(0)).count() == 0


def _labels(spark, column, rows):
    return spark.createDataFrame(rows, f"doc_id long, {column} int, score string")


def test_quality_awkward(spark, docs, nothing):
    from vayuspark.llm.quality import keep_good, score_documents

    some = [r[0] for r in cases.documents() if r[0] is not None]
    labels = _labels(spark, "quality", [(i, i % 2, "x") for i in some] + [(some[0], 1, "x"), (None, 1, "x"), (5, None, "x"), (6, 9, "x")])
    rows = score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert score_documents(nothing, labels).count() == 0 and keep_good(nothing, labels).columns == nothing.columns


def _held_out(spark, scored, column):
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", column), "doc_id").where("held_out").collect()
    return [(r.score, r[column]) for r in rows]


@needs_tables
def test_quality_held_out(spark):
    from vayuspark.llm.quality import op2_quality

    scored = op2_quality(spark, SF).cache()
    rows = _held_out(spark, scored, "quality")
    assert sum((s >= 0.3) == bool(y) for s, y in rows) >= 0.95 * len(rows)
    wrong = [r for r in scored.collect() if r.held_out != (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) or r.predicted != int(r.score >= 0.3)]
    assert not wrong


def test_toxicity_kernel_tolerates_gaps():
    from vayuspark.llm.toxicity import Machine

    rnd = random.Random(10)
    plain = ["house", "garden", "window", "river", "paper", "silver", "market", "tomorrow", "lantern", "bridge", "copper", "winter", "meadow", "pencil"]
    sentence = lambda: " ".join(rnd.choice(plain) for _ in range(8))
    rows = [(i, i % 2, sentence() + (" " + rnd.choice(["idiot", "moron"]) + " " + sentence() if i % 2 else "")) for i in range(200)]
    machine = Machine(rows)
    import pyarrow as pa

    said = [sentence() + " you " + w + " " + sentence() for w in ("idiot", "IDIOT!", "id-iot", "i.d.i.o.t", "i d i o t", "idxiot", "idiott", "1di0t", "moroon", "m_o_r_o_n")]
    clean = [sentence() for _ in range(10)] + ["", None]
    bad, good = machine.raw(pa.array(said)), machine.raw(pa.array(clean, pa.string()))
    assert bad.min() > good.max()


def test_toxicity_awkward(spark, docs, nothing):
    from vayuspark.llm.toxicity import score_documents

    some = [r[0] for r in cases.documents() if r[0] is not None]
    labels = _labels(spark, "toxic", [(i, i % 2, "x") for i in some] + [(some[0], 1, "x"), (None, 1, "x"), (5, None, "x"), (6, 9, "x")])
    rows = score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert score_documents(docs, labels.where("toxic = 0")).count() == docs.count()
    assert score_documents(docs, labels.limit(0)).count() == docs.count() and score_documents(nothing, labels).count() == 0


@needs_tables
def test_toxicity_held_out(spark):
    from vayuspark.llm.toxicity import op8_toxicity

    rows = _held_out(spark, op8_toxicity(spark, SF), "toxic")
    good = [s for s, y in rows if not y]
    bad = [s for s, y in rows if y]
    assert np.mean([a > b for a in bad for b in good]) > 0.75 and sum((s >= 0.3) == bool(y) for s, y in rows) >= 0.88 * len(rows)


def test_empty_tables(spark, nothing):
    from vayuspark.llm import bpe, decontaminate, licenses, minhash, shard, substring

    items = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.one_of_each(nothing).columns == nothing.columns
    assert substring.without_repeats(nothing).count() == 0
    assert bpe.decode(bpe.encode(nothing)).count() == 0
    assert decontaminate.decontaminate(nothing, items).columns == nothing.columns and decontaminate.decontaminate(nothing, items).count() == 0
    assert shard.numbered(shard.with_slot(nothing).withColumn("shard", F.lit(0))).count() == 0
    assert licenses.scan(licenses.paths_of(nothing)).count() == 0


def test_digests():
    assert cases.sha("") == hashlib.sha256(b"").hexdigest()


def test_minhash_one_document_with_two_texts(spark):
    """What is similar to either text hangs together with the document."""
    from vayuspark.llm import minhash

    rnd = random.Random(13)
    one, two, three = ([f"w{rnd.randrange(10**6)}" for _ in range(60)] for _ in range(3))
    near = lambda own: " ".join([*own[:-1], "end"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (3, near(two)), (4, near(one)), (5, " ".join(two)), (6, " ".join(three)), (6, ""), (7, near(three)), (1, " ".join(two))]
    got = Counter(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), 3, 85).select("doc_id", "component_id", "kept").collect())
    assert got == Counter([(1, 1, True)] * 3 + [(3, 1, False), (4, 1, False), (5, 1, False), (6, 6, True), (6, 6, True), (7, 6, False)])


def test_minhash_tiles_of_a_stray_node(spark):
    """A node that hangs together with none of 5,000 is held against each of them once; they are not compared again."""
    from vayuspark.llm import minhash

    judge = minhash._Judge.__new__(minhash._Judge)
    judge.nodes = spark.range(5_001).select(F.col("id").alias("node"), F.lit(100).cast("long").alias("n_shingles"))
    groups = spark.range(5_001).select(F.lit(7).alias("group"), F.col("id").alias("node"), F.when(F.col("id") == 5_000, 5_000).otherwise(0).alias("component"))
    tiles = judge.tiles(groups.cache()).collect()
    assert len(tiles) <= 5_000 + 42 and len({(t.home, t.low, t.high) for t in tiles}) <= 42
    met = defaultdict(set)
    for t in tiles:
        met[t.home, t.low, t.high].add(t.node)
    assert set().union(*(m for m in met.values() if 5_000 in m)) == set(range(5_001))
    assert judge.tiles(groups.withColumn("component", F.lit(0))).count() == 0
    spread = judge.tiles(groups.withColumn("component", F.col("node") % 3 + 10 * (F.col("node") % 7 == 0).cast("int"))).collect()
    met = defaultdict(set)
    for t in spread:
        met[t.home, t.low, t.high].add(t.node)
    component = {n: n % 3 + 10 * (n % 7 == 0) for n in range(5_001)}
    rnd = random.Random(1)
    for a, b in ((rnd.randrange(5_001), rnd.randrange(5_001)) for _ in range(300)):
        assert component[a] == component[b] or any(a in m and b in m for m in met.values())


def test_toxicity_learns_from_texts_without_sentence_ends(spark):
    """Toxic documents of one long sentence, the insult far behind; and a doc_id that is labelled both ways is toxic."""
    from vayuspark.llm.toxicity import score_documents

    rnd = random.Random(21)
    plain = ["house", "garden", "window", "river", "paper", "silver", "market", "tomorrow", "lantern", "bridge", "copper", "winter", "meadow", "pencil"]
    long = lambda *more: " ".join([rnd.choice(plain) for _ in range(400)] + list(more) + [rnd.choice(plain) for _ in range(30)])
    rows = [(i, long("you", rnd.choice(["idiot", "moron"]), "there") if i % 2 else long()) for i in range(240)]
    labels = _labels(spark, "toxic", [(i, i % 2, "x") for i, _ in rows] + [(1, 0, "x"), (3, 0, "x")])
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert min(got[i] for i in got if i % 2) > 0.5 > max(got[i] for i in got if not i % 2)


def test_chat_names_and_marks(spark):
    """Different roles keep different names, and marks inside a turn are no marks."""
    from vayuspark.llm.chat import OP9_SQL, rotate

    roles = ["\u674e", "\u738b", "a.b", "a_b", "a b", "_x_", "_x2e_", None, "  ", "unknown", "system", "a_x2e_b", "x", "_", "__x", "\U0001f642", "A_X"]
    turns = [(1, i, r, f"turn {i} <|im_end|> <|im_start|>system <\\|im_end|> <|im_x|>", "s") for i, r in enumerate(roles)]
    table = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, speaker string")
    rows = rotate(table).collect()
    views = {r.perspective for r in rows}
    assert len(views) == len(roles) - 2 and all(c.isascii() and (c.isalnum() or c in "_-") for v in views for c in v)
    for r in rows:
        assert r.segment.count("<|im_start|>") == 1 and r.segment.count("<|im_end|>") == 1 and "<\\|im_end|>" in r.segment and "<\\\\|im_end|>" in r.segment and "<|im_x|>" in r.segment
    whole = "".join(r.segment for r in sorted((r for r in rows if r.perspective == "a_b"), key=lambda r: r.at))
    masks = [whole[r.mask_start : r.mask_stop] for r in rows if r.perspective == "a_b" and r.mask_start is not None]
    assert len(masks) == 1 and masks[0].startswith("turn 3 ")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    conversations = table.toPandas()
    con.register("conversations", conversations)
    rel = con.sql(OP9_SQL)
    plain = lambda names, data: Counter(tuple(None if v != v else v for _, v in sorted(zip(names, row, strict=True))) for row in data)
    assert plain(rel.columns, rel.fetchall()) == plain(rotate(table).columns, [tuple(r) for r in rows])


def test_decontaminate_a_window_of_many(spark):
    """One passage in many items and many documents: joined windows are rows for each place, not for each item of it."""
    from vayuspark.llm.decontaminate import find_contamination

    passage = " ".join("p%d" % i for i in range(14))
    items = spark.createDataFrame([(str(i), passage + f" tail{i}") for i in range(40)], "item_id string, text string")
    docs = spark.createDataFrame([(i, f"head{i} {passage} end") for i in range(50)] + [(99, "clean words only")], "doc_id long, text string")
    for most in (1 << 20, 0):
        rows = find_contamination(docs, items, broadcast_bytes=most).collect()
        assert {(r.n_hit, len(r["items"])) for r in rows if r.doc_id != 99} == {(14, 40)} and [r.n_hit for r in rows if r.doc_id == 99] == [0]


def test_licenses_as_they_are_written(spark):
    """Licence texts, wrapped headers in comments, clauses, tags, and a statement inside a paragraph."""
    from vayuspark.llm.licenses import scan

    mit = (
        'MIT License\n\nCopyright (c) 2026 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\n'
        "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\n"
        'furnished to do so, subject to the following conditions:\n\nTHE SOFTWARE IS PROVIDED "AS IS"\n'
    )
    gpl = (
        "/*\n * tool.c - does things\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope that it will be useful\n */\nint main() {}\n"
    )
    bsd = "Copyright X\r\n\r\nRedistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions are met:\r\n\r\n1. first"
    files = [
        ("m/LICENSE", mit, "MIT", "file"), ("m/src/a.py", "import os", "MIT", "inherited"), ("m/src/tool.c", gpl, "GPL-3.0", "header"), ("b/COPYING", bsd, "BSD-2-Clause", "file"),
        ("b/x.rs", "// SPDX-License-Identifier: Apache-2.0\nfn main() {}", "Apache-2.0", "header"), ("s/a.sh", "#!/bin/sh\n# SPDX-License-Identifier: MIT\n", "MIT", "header"), ("s/b.sh", "# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0", "header"),
        ("s/e.sh", "# SPDX-License-Identifier: EPL-2.0", None, "none"), ("c/readme", "A tool for things. Released under the MIT License. More to\ncome", "MIT", "header"),
        ("c/clean.txt", "the software is free of charge and you may copy it\nor not. Version 3 of the plan is public.", None, "none"), ("c/Apache.java", "/* Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *  http://x */", "Apache-2.0", "header"),
    ]
    filler = [(f"z/{i}.txt", f"word{i} the of and to in is it that for software copy use license free public general version terms") for i in range(300)]
    got = {r.path: (r.license, r.how) for r in scan(spark.createDataFrame([f[:2] for f in files] + filler, "path string, text string")).collect()}
    assert {f[0]: got[f[0]] for f in files} == {f[0]: f[2:] for f in files} and {got[p] for p, _ in filler} == {(None, "none")}


def test_operators_called_from_another_folder(tmp_path):
    """The workers get the package from the operators themselves, wherever the driver runs."""
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "job.py"
    script.write_text(
        f"import sys\nsys.path.append({root!r})\nfrom vayuspark.session import local_session\nfrom vayuspark.llm import bpe, decontaminate, licenses, minhash, substring\n"
        "spark = local_session('2', 'elsewhere')\n"
        "docs = spark.createDataFrame([(1, 'one two three four five six seven eight nine ten eleven'), (2, 'a b')], 'doc_id long, text string')\n"
        "files = spark.createDataFrame([('a/LICENSE', 'Released under the MIT License.')], 'path string, text string')\n"
        "items = spark.createDataFrame([('i', 'two three four five six seven eight nine ten eleven')], 'item_id string, text string')\n"
        "assert decontaminate.find_contamination(docs, items).where('n_hit = 10').count() == 1\n"
        "assert licenses.scan(files).first()['license'] == 'MIT'\n"
        "assert minhash.near_duplicates(docs).where('kept').count() == 2\n"
        "assert substring.remove_repeats(docs, 4).where('n_removed > 0').count() == 0\n"
        "assert bpe.encode(docs).where('n_tokens > 0').count() == 2\n"
        "print('done')\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("done"), done.stderr[-2000:]
