"""Alignment, phrases and packing against plain versions."""

import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import cases  # noqa: E402
import plain  # noqa: E402
import public_tokenizers  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")

#: Everything at which a tokenizer could be cut wrongly.
ODD = [
    "it's I'M 'tis don''t", "a  b  c   d", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "a\n\n b\n\nc  \n d\t\te  ", "   lead", "É É ÉCOLE école ÀÑ×÷ß ẞ İI", "\x1c\x1f x\x1cy \x85 z", "🙂🙂 a🙂b !—! —x",
    "12 34a5 a1b2 ½ ²", "ﬁne Å", "x▁y ▁", "日本語 テスト。次", "a" * 3000, "...!!!??? ,;:", "<0x41> <unk> <s>", "\r\n\r\n x \x0b\x0c y", "ΣΑΣ σας ς", "<|", "a<|b |> <", " em　space 　", "x\xa0 y\xa0  z \xa0w", "x    y   z", "", " ", " \n ", "tab\tend\t", "nul\x00l",
]


def odd_texts(n=1500):
    rnd = random.Random(3)
    letters = list("aZ é É'.,!1 2\t\n  <|>") + ["ñ", "Ü", "—", "\xa0", "\u0301", "\u2003", "▁", "日", "×"]
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


def test_ids_are_the_libraries():
    from tokenizers import Tokenizer

    from vayuspark.llm.units import ByteBpe, Pieces, WordBpe

    a, b = plain.libraries()
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r[1] or "" for r in cases.documents()] + odd_texts()
    spaced = [" " + t for t in texts]
    pieces = [t for t in spaced if "▁" not in t and t != " "]  # such texts are never aligned
    for tokens, given, want in (
        (ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), spaced, lambda t: a.encode(t, add_special_tokens=False).ids),
        (WordBpe(public_tokenizers.path("word_bpe_49k.json")), texts, lambda t: words.encode(t, add_special_tokens=False).ids),
        (Pieces(public_tokenizers.path("piece_bpe_32k.model")), pieces, lambda t: b.encode(t[1:])),
    ):
        for some in (given, given[::-1]):
            ids, counts = tokens.ids(pa.array(some))
            ends = np.cumsum(counts)
            assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [want(t) for t in some]
        assert tokens.ids(pa.array([], pa.string()))[0].tolist() == [] and tokens.ids(pa.array(["", None]))[1].tolist() == [0, 0]


def test_sparse_products():
    from vayuspark.llm.align import Rows, product

    rng = np.random.default_rng(1)

    def sparse(m):
        at = [np.flatnonzero(r) for r in m]
        return Rows(np.cumsum([len(x) for x in at]), np.concatenate(at), np.concatenate([r[x] for r, x in zip(m, at, strict=True)]), m.shape[1])

    def dense(r, n):
        out = np.zeros((n, r.width), np.int64)
        for i, (low, high) in enumerate(zip(np.append(0, r.ends[:-1]), r.ends, strict=True)):
            assert (np.diff(r.columns[low:high]) > 0).all()
            out[i, r.columns[low:high]] = r.values[low:high]
        return out

    for _ in range(30):
        x, y = rng.integers(0, 4, (7, 5)) * rng.integers(0, 2, (7, 5)), rng.integers(0, 4, (6, 5)) * rng.integers(0, 2, (6, 5))
        assert (dense(product(sparse(x), sparse(y).transposed()), 7) == x @ y.T).all()


@pytest.fixture(scope="module")
def docs(spark):
    rows = cases.documents()
    extra = [(10_000 + i, t, "en", "s", None, *["7"] * len(cases.EXTRA)) for i, t in enumerate(odd_texts(100))]
    return cases.frame(spark, rows + extra).cache()


def test_alignment(spark, docs):
    from vayuspark.llm.align import align, summaries, tokenizers

    found = align(docs, *tokenizers(), with_shared=True)
    rows = found.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    want, inside = plain.alignments([t for _, t in given])
    assert sum(w[3] > 0 for w in want) > 60 and sum(w[3] == 0 for w in want) > 5
    once = Counter(i for i, _ in given)
    for (i, _), (one, two, links, groups, n) in zip(given, inside, strict=True):
        if once[i] > 1:
            continue
        r = by[i][0]
        assert r.a_ids == [x[0] for x in one] and r.b_ids == [x[0] for x in two]
        row = np.repeat(np.arange(len(one)), r.link_counts)
        assert list(zip(row.tolist(), r.links, r.link_bytes, strict=True)) == links
        assert np.repeat(np.arange(n), r.a_groups).tolist() == groups[0] and np.repeat(np.arange(n), r.b_groups).tolist() == groups[1]
        row = np.repeat(np.arange(len(one)), r.shared_counts)
        assert list(zip(row.tolist(), r.shared, strict=True)) == [(x, y) for x, g in enumerate(groups[0]) for y, h in enumerate(groups[1]) if g == h]
    out = summaries(docs, *tokenizers())
    assert set(out.columns) >= {"doc_id", "lang", "n_chars"} and "text" not in out.columns
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in out.collect()) == Counter((i, *w) for (i, _), w in zip(given, want, strict=True))
    assert summaries(docs.limit(0), *tokenizers()).count() == 0 and align(docs.limit(0), *tokenizers()).count() == 0


@needs_tables
def test_alignment_of_the_table(spark):
    from vayuspark.llm.align import op11_token_alignment

    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, _ = plain.alignments([t for _, t in given])
    got = {tuple(r) for r in op11_token_alignment(spark, SF).collect()}
    assert got == {(i, *w) for (i, _), w in zip(given, want, strict=True)}


def _fewest(lengths, capacity):
    """The fewest sequences, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for at in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [*rooms[:at], rooms[at] - lengths[i], *rooms[at + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0] if lengths else 0


def _check_plan(plan, counts, capacity):
    taken = defaultdict(list)
    ranks = Counter()
    for length, low, high, first, each, offset in sorted(plan.rows):
        assert ranks[length] == low < high
        ranks[length] = high
        for r in range(high - low):
            taken[first + r // each].append((offset + r % each * length, length))
    assert ranks == Counter(counts) and set(taken) == set(range(plan.sequences))
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_reduction_keeps_the_optimum():
    from vayuspark.llm.packing import Plan

    rnd, reduced, exact = random.Random(7), 0, 0
    for _ in range(1500):
        capacity = rnd.choice([10, 20, 50])
        lengths = [rnd.randint(rnd.choice([1, capacity // 5, capacity // 4]), capacity) for _ in range(rnd.randint(0, 11))]
        plan = Plan(Counter(lengths), capacity)
        _check_plan(plan, Counter(lengths), capacity)
        rest = Counter(lengths)
        for length, low, high, first, *_ in plan.rows:
            if first < plan.fixed:
                rest[length] -= high - low
        best = _fewest(lengths, capacity)
        assert plan.fixed + _fewest(list(rest.elements()), capacity) == best
        reduced += plan.fixed
        exact += plan.sequences == best
        assert plain.lower_bound(lengths, capacity) <= best or not lengths
    assert reduced > 2000 and exact > 1450


def test_plan_of_many():
    from vayuspark.llm.packing import Plan

    rnd = random.Random(8)
    for shape in (lambda: min(4096, int(rnd.lognormvariate(6, 1.2)) + 1), lambda: rnd.choice([4096, 4096, 1500, 700, 699, 3]), lambda: rnd.randint(1400, 2700)):
        counts = Counter(shape() for _ in range(30_000))
        plan = Plan(counts, 4096)
        _check_plan(plan, counts, 4096)
        bound = plain.lower_bound(list(counts.elements()), 4096) if len(counts) < 10 else -(-sum(x * n for x, n in counts.items()) // 4096)
        assert plan.sequences <= (1.001 * bound + 1 if len(counts) > 3000 else 1.2 * bound)
        assert len(plan.rows) < 60_000
    huge = Plan({3: 10**12, 4096: 10**12, 1000: 10**12, 3096: 10**12 + 1}, 4096)
    assert len(huge.rows) < 100 and huge.sequences >= 2 * 10**12


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    from vayuspark.llm.packing import pack, sequences, token_pieces, word_tokens

    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    capacity = 64
    rows = docs.collect()
    want = Counter()
    for r in rows:
        ids = words.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, low in enumerate(range(0, len(ids), capacity)):
            want[(r.doc_id, k, low, tuple(ids[low : low + capacity]))] += 1
    packed = pack(token_pieces(docs, word_tokens(), capacity), capacity).cache()
    got = packed.collect()
    ids = lambda r: tuple(np.frombuffer(bytes(r), "<u4").tolist())
    assert Counter((r.doc_id, r.piece, r.start, ids(r.ids)) for r in got) == want and all(len(ids(r.ids)) == r.length for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    whole = {r.sequence_id: ids(r.ids) for r in sequences(packed).collect()}
    assert set(whole) == set(by)
    for k, parts in by.items():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        assert whole[k] == sum((ids(p.ids) for p in parts), ()) and len(whole[k]) <= capacity
    assert len(by) <= 1.02 * plain.lower_bound([r.length for r in got], capacity) + 1
    assert set(docs.columns) - {"text"} <= set(packed.columns)
    assert pack(token_pieces(docs.limit(0), word_tokens())).count() == 0


def test_packing_of_given_lengths(spark):
    from vayuspark.llm.packing import pack

    rows = [(i, x) for i, x in enumerate([5, 5, None, 0, -1, 3, 2, 8, 8, 10, 1, 1, 1])]
    got = pack(spark.createDataFrame(rows, "doc_id long, length int").repartition(3), 10).collect()
    assert {r.doc_id for r in got if r.sequence_id is None} == {2, 3, 4} and len({r.sequence_id for r in got} - {None}) == 5
    many = spark.range(20_000).select(F_length())
    got = pack(many, 10).groupBy("sequence_id").sum("length").collect()
    assert len(got) == 12_000 and max(r[1] for r in got) <= 10
    with pytest.raises(ValueError):
        pack(spark.createDataFrame(rows, "doc_id long, length int"), 9)


def F_length():
    from pyspark.sql import functions as F

    return F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, 10).otherwise(3).alias("length")


@needs_tables
def test_packing_of_the_table(spark):
    from tokenizers import Tokenizer

    from vayuspark.llm.packing import op13_best_fit_packing

    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = op13_best_fit_packing(spark, SF).collect()
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = words.encode(r.text or "", add_special_tokens=False).ids + [1]
        want |= {(r.doc_id, k, low, len(ids[low : low + 4096]), zlib.crc32(np.array(ids[low : low + 4096], "<u4").tobytes())) for k, low in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert len({r.sequence_id for r in got}) <= plain.lower_bound([r.length for r in got], 4096) + 1


def _phrase_rows(seed=9):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "delta", "naïve", "日本", "x-y", "it's", "(b)", "nul\x00l", "thin sp"] + ["w%d" % i for i in range(30)]
    gaps = [" "] * 12 + ["  ", "\t", ", ", ".", "!\n", "\r\n", " ; ", "?"]
    rows = [("".join(rnd.choice(words[: rnd.choice([4, 12, 41])]) + rnd.choice(gaps) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "de", None, "und", ""])) for _ in range(250)]
    return rows + [(None, "en"), ("", "fr"), (".,;", "fr"), ("alone", "it"), ("same " * 500, "en"), ("same. " * 50, "en"), ("New York City. " * 30 + "New York. " * 5, "de")] + [rows[0]] * 20


@pytest.mark.parametrize("most,support,limit,shards", [(3, 10, 2000, 4), (3, 3, 7, 1), (4, 5, 2000, 7), (2, 10, 50, 3)])
def test_phrases(spark, monkeypatch, most, support, limit, shards):
    from vayuspark.llm import phrases

    rows = _phrase_rows()
    docs = spark.createDataFrame([(i if i % 5 else None, t, x, "7") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(6)
    want = plain.phrases(rows, most, support, 50, limit)
    assert len(want) > 20
    assert sorted(map(tuple, phrases.collocations(docs, most, support, 50, limit, shards).collect())) == sorted(want)
    assert phrases.collocations(docs.limit(0), most, support, 50, limit, shards).count() == 0


def test_phrases_pass_a_full_field(spark, monkeypatch):
    """With far more candidates than bits all phrases are counted, and none comes out wrong."""
    from vayuspark.llm import phrases

    monkeypatch.setattr(phrases, "bit_field", lambda hashes: np.full(1 << (phrases.BITS - 3), 255, np.uint8))
    rows = _phrase_rows(11)
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == sorted(plain.phrases(rows, 3, 10, 50, 2000))


def test_shards_lose_no_phrase(spark):
    """Each phrase that is frequent in all is a candidate, and few others are."""
    from pyspark.sql import functions as F

    from vayuspark.llm import phrases

    rows = _phrase_rows(12)
    texts = spark.createDataFrame([(x or "und", t or "", i * i % 5 % 4) for i, (t, x) in enumerate(rows)], "lang string, text string, shard int")
    least = phrases.shares(texts, 10)
    assert sum(least.values()) >= 10 and max(least.values()) < 10
    found = {r.hash for r in phrases.candidates(texts, range(1, 4), 10, least, 4).collect()}
    whole = {r.hash for r in phrases.candidates(texts.withColumn("shard", F.lit(0)), range(1, 4), 10, {0: 10}, 4).collect()}
    assert whole <= found and len(found) <= len(whole)


def test_scores_beyond_64_bits(spark):
    from vayuspark.llm import phrases

    f = {"a": 10**13, "b": 10**13 + 7, "a b": 10**13 - 1, "c": 3 * 10**12 + 1, "b c": 10**12 + 1, "a b c": 10**12}
    table = spark.createDataFrame([("en", len(p.split()), p, n) for p, n in f.items()], "lang string, size int, phrase string, f long")
    got = {r.phrase: (r.score, r.l, r.r) for r in phrases.scored(table).collect()}
    cut = lambda a, x, y: (1000000 * f[a] ** 2 // (f[x] * f[y]), f[x], f[y])
    assert got == {"a b": cut("a b", "a", "b"), "b c": cut("b c", "b", "c"), "a b c": min(cut("a b c", "a", "b c"), cut("a b c", "a b", "c"), key=lambda x: x[0])}


@needs_tables
def test_phrases_of_the_table(spark):
    duckdb = pytest.importorskip("duckdb")
    from vayuspark.llm.phrases import OP12_SQL, op12_collocations

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, op12_collocations(spark, SF).collect())) == sorted(con.sql(OP12_SQL).fetchall())
