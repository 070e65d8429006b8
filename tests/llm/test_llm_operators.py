"""Small fixtures against brute force: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import os
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spanwright.llm import ann, common, decontaminate, language_id, licenses, line_dedup, mixing, simhash, suffix_dedup, url_filter, warc
from spanwright.llm.components import components

DOCS = "doc_id long, text string"


def docs(spark, texts, extra=""):
    return spark.createDataFrame([(i, t) for i, t in texts], DOCS)


# line dedup


def brute_lines(texts, min_docs, min_chars=1, first=False):
    blanks = b" \t\n\x0b\x0c\r"
    seen = {}
    for i, t in texts:
        for k in {x.strip(blanks).lower() for x in (t or "").encode().split(b"\n")}:
            seen.setdefault(k, []).append(i)
    bad = {k: min((i for i in v if i is not None), default=None) for k, v in seen.items() if len(v) >= min_docs and len(k.decode()) >= min_chars}
    out = []
    for i, t in texts:
        used, kept, lines = set(), [], (t or "").encode().split(b"\n")
        for line in lines:
            k = line.strip(blanks).lower()
            if k not in bad or (first and bad[k] == i and k not in used):
                kept.append(line)
            used.add(k)
        out.append((i, b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("bits", [1 << 16, 1 << 27])
def test_lines_against_brute_force(spark, first, bits):
    rnd = random.Random(3)
    pool = ["Common Line", " common line\t", "Été", "été", "", "x", *(f"line {i}" for i in range(30))]
    texts = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(6)))) for i in range(60)]
    texts += [(100, None), (101, ""), (None, "Common line\nown"), (5, "Common Line"), (102, "tail\n" * 3000 + "x")]
    got = line_dedup.drop_repeated_lines(docs(spark, texts).repartition(5), min_docs=4, keep_first=first, max_filter_bits=bits)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(texts, 4, first=first)


def test_lines_keep_columns_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a\nb", 7, "k"), (2, "a", 8, "l")], "doc_id long, text string, n_lines int, key string")
    got = line_dedup.drop_repeated_lines(d, min_docs=2).orderBy("doc_id")
    assert got.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    assert [tuple(r) for r in got.collect()] == [(1, "b", "k", 2, 1), (2, "", "l", 1, 1)]
    assert line_dedup.drop_repeated_lines(d.limit(0), min_docs=2).count() == 0


# SimHash


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_use_the_engines_hash(spark):
    t = "Ein  Haus\tam\x0bSee ÄÖ"
    assert simhash.simhash64(t) % (1 << 64) == brute_simhash(t)
    assert simhash.simhash64("one two three") == spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert simhash.simhash64(None) == simhash.simhash64(" \n") == 0


def near_components(fps, bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("paired", [0, 3, 64])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, bits, paired):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)
    rnd = random.Random(bits)
    base = [rnd.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(3))) for b in base for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits)).collect()}
    want = near_components(fps, bits)
    mine = [got.get(f, f) for f in signed]
    assert len(set(zip(want, mine))) == len(set(want)) == len(set(mine))


def test_near_duplicates_and_keep_one(spark):
    text = "one two three four five six seven"
    d = docs(spark, [(3, text), (1, text.upper()), (2, None), (5, " "), (None, text), (7, "other words entirely here"), (7, "other words entirely here"), (8, "x" * 200_000)])
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert got == {(3, 1), (1, 1), (2, 2), (5, 2), (None, 1), (7, 7), (8, 8)}
    assert simhash.near_duplicates(d).count() == 8
    assert sorted(r.doc_id for r in simhash.keep_one(d).collect()) == [1, 2, 7, 8]
    assert simhash.near_duplicates(d.limit(0)).count() == 0
    assert [r.doc_id for r in simhash.keep_one(docs(spark, [(None, "a"), (None, "a")])).collect()] == [None]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


# suffix dedup


def brute_repeats(texts, length):
    data = [(i, (t or "").encode()) for i, t in texts]
    out = []
    for i, b in data:
        less = {x[p : p + length] for j, x in data if i is not None and j is not None and j < i for p in range(len(x) - length + 1)}
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in less:
                gone[p : p + length] = [True] * length
        out.append((i, len(b), sum(gone), sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1])), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("cuts", [suffix_dedup.CUTS, ()])
@pytest.mark.parametrize("length", [8, 10, 11, 50, 131])
def test_repeats_against_brute_force(spark, length, cuts):
    rnd = random.Random(length)
    parts = ["".join(rnd.choice("abé \n") for _ in range(rnd.randrange(1, 70))) for _ in range(12)]
    texts = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(5)))) for i in range(30)]
    texts += [(40, None), (None, parts[0] * 3), (3, "".join(parts[:3])), (41, texts[2][1]), (41, texts[2][1]), (42, "a" * 500), (43, "a" * 130)]
    got = suffix_dedup.drop_repeats(docs(spark, texts).withColumn("kept", F.lit(1)), length=length, cuts=cuts)
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()]
    assert sorted(rows, key=repr) == brute_repeats(texts, length)


@pytest.mark.parametrize("length", [8, 9, 10, 17, 50, 100, 131])
def test_suffixes_are_sorted(length):
    """The merged order is that of the first ``length`` bytes of every suffix, and neighbours that agree are found."""
    rnd = random.Random(length)
    cover = suffix_dedup.Cover(length)
    text = b"".join(rnd.choice([b"ab", b"a", b"ba", b"abcabc"]) for _ in range(400))
    sampled = [q for q in range(len(text) - cover.reach + 1) if q % 3]
    ranked = {x: i for i, x in enumerate(sorted({text[q : q + cover.reach] for q in sampled}))}
    rank = np.zeros(len(text) + 4, np.uint64)
    rank[sampled] = [ranked[text[q : q + cover.reach]] for q in sampled]
    p = np.arange(len(text) - length + 1)
    kind = (p % 3).astype(np.uint8)
    head = np.array([text[i] << 8 | text[i + 1] for i in p], np.uint16)
    tail = np.array([int.from_bytes(text[i + cover.reach : i + length], "big") for i in p], np.uint32)
    order, same = suffix_dedup.merged_order(cover, kind, head, tail, np.where(kind == 0, rank[p + 1], rank[p]), np.where(kind == 1, rank[p + 1], rank[p + 2]))
    got = [text[i : i + length] for i in order]
    assert got == sorted(text[i : i + length] for i in p)
    assert same.tolist() == [i > 0 and got[i] == got[i - 1] for i in range(len(got))]


@pytest.mark.parametrize("sparse", [True, False])
def test_fingerprints_are_hashed_within_the_cache(monkeypatch, sparse):
    """Many short rows are hashed 64 KB at a time, and no chunk's limit shows in what is found."""
    rnd = random.Random(7)
    rows = [bytes(rnd.choice(b"ab\0 ") for _ in range(rnd.choice([0, 7, 8, 49, 50, 51, 300]))) for _ in range(4000)] + [b"x" * 200_000, b"a" * 50]
    whole, sizes = suffix_dedup._hashes, []
    monkeypatch.setattr(suffix_dedup, "_hashes", lambda data, width: sizes.append(len(data)) or whole(data, width))
    got = [(m, r) for marks, row in suffix_dedup._marks_by_row(pa.array(rows), 50, sparse) for m, r in zip(marks.tolist(), row.tolist())]
    assert [n for n in sizes if n > 1 << 16] == [200_000]
    want = []
    for i, row in enumerate(rows):
        marks = suffix_dedup._marks(np.frombuffer(row, np.uint8), 50, sparse).tolist()
        want += [(m, i) for k, m in enumerate(marks) if not k or m != marks[k - 1]]
    assert got == want


@pytest.mark.parametrize("width", [4, 6, 8, 12, 37, 50])
def test_hashes_are_of_the_string_alone(width):
    data = np.frombuffer(bytes(random.Random(width).choice(b"ab") for _ in range(3000)), np.uint8)
    hashes, text = suffix_dedup._hashes(data, width).tolist(), data.tobytes()
    strings = [text[i : i + width] for i in range(len(text) - width + 1)]
    assert len(hashes) == len(strings) and len(set(zip(strings, hashes))) == len(set(strings)) == len({h >> 24 for h in hashes})


@pytest.mark.parametrize("width", [6, 9, 24])
def test_numbers_are_in_the_order_of_their_strings(width):
    rnd = random.Random(width)
    strings = [bytes(rnd.choice(b"\0a\xff") for _ in range(3)) + b"b" * (width - 5) + bytes(rnd.choice(b"\0a\xff") for _ in range(2)) for _ in range(2000)]
    for some in (strings, strings[:1], []):
        order, begins = suffix_dedup._ordered(*suffix_dedup._words(np.array(some, f"S{width}")), np.arange(len(some)))
        assert order.tolist() == sorted(range(len(some)), key=lambda i: some[i])
        order, begins = suffix_dedup._ordered(*suffix_dedup._words(np.array(some, f"S{width}")))
        got = [some[i] for i in order]
        assert got == sorted(some) and begins.tolist() == [not i or got[i] != got[i - 1] for i in range(len(got))]


@pytest.mark.parametrize("most", [3, 1 << 20, (1 << 33) - 1])
def test_order_by_place(most):
    """Also of numbers that do not fit one integer with their positions."""
    rnd = random.Random(most)
    places = list({(rnd.randrange(9) << 33 | rnd.randrange(most), rnd.choice([rnd.randrange(40), (1 << 31) - 1])) for _ in range(1000)})
    number, pos = np.array([p[0] for p in places], np.int64), np.array([p[1] for p in places], np.int32)
    assert [places[i] for i in suffix_dedup._by_place(number, pos)] == sorted(places)
    assert suffix_dedup._by_place(number[:0], pos[:0]).tolist() == []


def test_stretches_that_touch_are_one():
    assert suffix_dedup._spans([9, 0, 2, 5, 20], [12, 5, 3, 6, 21]) == ([0, 9, 20], [6, 12, 21])
    assert suffix_dedup._spans([], []) == ([], [])


def test_repeats_with_many_ranges_and_a_hot_beginning(spark, monkeypatch):
    """Texts that all begin with one pad longer than a triple, under clashing names, sorted in ranges of a few suffixes."""
    monkeypatch.setattr(suffix_dedup, "RANGE_ROWS", 64)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_BYTES", 16)
    rnd = random.Random(3)
    pad = "=" * 60
    texts = [(i, pad + "".join(rnd.choice(["alpha beta ", "gamma ", "é" * 9, pad]) for _ in range(8))) for i in range(25)]
    table = spark.createDataFrame([(i, t, "own", i, b"x") for i, t in texts], "doc_id long, text string, owner string, number long, data binary")
    for cuts in (suffix_dedup.CUTS, ()):
        got = suffix_dedup.drop_repeats(table, length=30, cuts=cuts).collect()
        assert {(r.owner, r.number, bytes(r.data)) for r in got} == {("own", i, b"x") for i in range(25)}
        rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got]
        assert sorted(rows, key=repr) == brute_repeats(texts, 30)


def test_texts_without_repeats_stay_where_they_are(spark, monkeypatch):
    """Lists too large to be broadcast draw the texts that may be in them, not all."""
    monkeypatch.setattr(suffix_dedup, "MAX_BROADCAST", 0)
    rnd = random.Random(6)
    texts = [(i, "".join(f"{rnd.getrandbits(64):x}" for _ in range(2000))) for i in range(60)]
    want = dict.fromkeys(range(60), 0) | {100: 90, 101: len(texts[1][1])}
    texts += [(100, texts[0][1][500:590] + " end"), (101, texts[1][1]), (None, texts[2][1])]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = {r.doc_id: r.n_removed for r in suffix_dedup.drop_repeats(docs(spark, texts)).collect()}
    assert got == want | {None: 0}
    assert written() - before < 1.5 * sum(len(t) for _, t in texts)


@pytest.mark.parametrize("length", [8, 50])
def test_repeats_brought_by_filters(spark, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "MAX_BROADCAST", 0)
    test_repeats_against_brute_force(spark, length, suffix_dedup.CUTS)


def test_spent_pieces_and_filters_go_before_the_sort(spark, monkeypatch):
    """While the sort has its exchanges on disk, neither the texts of the first level nor the filters lie beside them."""
    filters, beside = [], []
    marks, by_cover = suffix_dedup._repeated_marks, suffix_dedup._by_cover
    folder = Path(common.shared_path(spark, "any").removeprefix("file:")).parent
    before = set(folder.glob("*"))

    def keeping(*args):
        filters.append(marks(*args))
        return filters[-1]

    def looking(*args):
        beside.extend(p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before)
        beside.extend(f._path for f in filters if os.path.exists(f._path))
        return by_cover(*args)

    monkeypatch.setattr(suffix_dedup, "_repeated_marks", keeping)
    monkeypatch.setattr(suffix_dedup, "_by_cover", looking)
    rnd = random.Random(8)
    parts = ["".join(rnd.choice("abc ") for _ in range(200)) for _ in range(6)]
    texts = [(i, "".join(rnd.choice(parts) for _ in range(6))) for i in range(20)]
    got = suffix_dedup.drop_repeats(docs(spark, texts)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr) == brute_repeats(texts, 50)
    assert len(filters) == 2 and sorted(beside) == ["copies", "groups-32", "keys-64", "places-32", "places-64"]


def test_exchange_cleanup_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(suffix_dedup.CLEANUP, None)
    assert suffix_dedup.stored(spark.range(10).repartition(3), "kept").count() == 10
    assert spark.conf.get(suffix_dedup.CLEANUP, None) == before


def test_repeats_empty_table_and_short_length(spark):
    d = docs(spark, [(1, "abc")])
    assert suffix_dedup.drop_repeats(d.limit(0)).count() == 0
    assert suffix_dedup.drop_repeats(d).first().n_removed == 0
    with pytest.raises(ValueError):
        suffix_dedup.drop_repeats(d, length=7)


# mixing


def test_mix_reaches_targets_and_agrees(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 80, 900])), rnd.choice(["a", "a", "a", "b", "Z", None])) for i in range(1500)] + [(9000, None, "a"), (9001, "w " * 30_000, "b"), (None, "w w", "b"), (7, "w", "b"), (7, "w", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix(d).collect()
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(first) == len(rows)
    by = {}
    for r in first:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        by.setdefault((r.source, r.target, r.source_size), []).append(r)
    total = sum(r.size for r in first)
    assert sum(t for _, t, _ in by) == pytest.approx(total)
    for (_, target, size), own in by.items():
        assert sum(r.size for r in own) == size
        assert abs(sum(r.taken for r in own) - target) <= 5


def test_targets_cap_and_reshare(spark):
    s = spark.createDataFrame([("a", 10), ("b", 500), (None, 490), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    assert got["a"] == 30 and got["c"] == 0
    assert got["b"] == pytest.approx(970 * 2 / 7) and got[None] == pytest.approx(970 * 5 / 7)


@pytest.mark.parametrize("p", [1 / 2, 1 / 3, 1 / 4])
def test_pairs_keep_the_sum_and_are_unbiased(p):
    size, taken = np.full(300, 10.0), []
    for seed in range(200):
        got = mixing.pair_up(np.full(300, p), size, np.random.default_rng(seed), 0)
        assert (got * size).sum() == pytest.approx(3000 * p, abs=1e-6)
        assert np.isin(got, (0, 1)).sum() >= 299
        taken.append(got[:20])
    assert np.mean(taken) == pytest.approx(p, abs=0.03)


def test_mix_of_equal_rows_ends_at_the_target(spark):
    d = spark.range(20_000).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    got = mixing.mix(d, weights=(3, 1)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 5 for r in got)


def test_mix_spreads_rows_without_an_id(spark):
    d = spark.range(300_000).selectExpr("CAST(null AS long) AS doc_id", "'one two three' AS text", "'a' AS source", "0 AS size", "0 AS copies", "id AS target")
    d = d.unionByName(spark.range(1000).selectExpr("id AS doc_id", "'one two three' AS text", "'b' AS source", "0 AS size", "0 AS copies", "id AS target"))
    mixed = mixing.mix(d, weights=(1, 1))
    assert mixed.columns.count("size") == 1 and mixed.count() == 301_000
    by = {r.source: r for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(r.taken - r.target) <= 2 for r in by.values())
    counted = spark.createDataFrame([("x", 200_001)], "k string, n long")
    assert [tuple(r) for r in mixing.numbered(counted).agg(F.count("nth"), F.min("nth"), F.max("nth"), F.countDistinct("nth")).collect()] == [(200_001, 0, 200_000, 200_001)]


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# language


def test_language_mixture(spark):
    rnd = random.Random(0)
    make = lambda syl, n: " ".join("".join(rnd.choice(syl) for _ in range(3)) for _ in range(n))
    x, y = ["ka", "lo", "mi"], ["stré", "ung", "öch"]
    rows = [(i, make(x, 40), "x") for i in range(40)] + [(100 + i, make(y, 40), "y") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = docs(spark, [(1, make(x, 30)), (2, make(y, 30)), (3, make(x, 60) + " " + make(y, 30)), (4, None), (5, "12 !?"), (6, ""), (7, make(y, 60_000))])
    got = {r.doc_id: r for r in language_id.identify(test.withColumn("score", F.lit(9)), model).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["x", "y", "x", "und", "und", "und", "y"]
    assert got[1].score == 1.0 and got[4].score == 0.0
    assert {m.lang for m in got[3].lang_mix} == {"x", "y"} and got[3].score == pytest.approx(0.6, abs=0.15)


def test_language_mixture_of_four(spark):
    rnd = random.Random(4)
    make = lambda syl, n: " ".join("".join(rnd.choice(syl) for _ in range(3)) for _ in range(n))
    kinds = {"a": ["ka", "lo", "mi"], "b": ["stré", "ung", "öch"], "c": ["wex", "jub", "zyf"], "d": ["pho", "qui", "dva"]}
    rows = [(i, make(s, 40), k) for k, s in kinds.items() for i in range(30)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    twice = [(1, " ".join(make(s, 60) for s in kinds.values())), (1, make(kinds["a"], 9)), (1, make(kinds["a"], 9))]
    got = language_id.identify(docs(spark, twice), model).collect()
    assert sorted(len(r.lang_mix) for r in got) == [1, 1, 4]
    assert language_id.identify(docs(spark, twice).limit(0), model).count() == 0


def test_language_proportions_against_plain_em(spark):
    """The shares of two known languages are those of expectation-maximisation written out, document by document."""
    rnd = random.Random(6)
    probs = np.random.default_rng(1).dirichlet(np.full(language_id.GRAMS, 0.05), 2).T + 1e-9
    texts = ["".join(rnd.choice("abcdefghij ") for _ in range(n)) + "x" for n in (30, 200, 1000)]
    codes = [language_id._padded(t) for t in texts]
    got = language_id.infer(codes, probs, penalty=-1e9, rounds=8)
    for c, row in zip(codes, got):
        p = probs[language_id._grams(c)]
        pi = np.full(2, 0.5)
        for _ in range(12):  # eight rounds, then four from there for the set of both
            q = p * pi / (p * pi).sum(axis=1, keepdims=True)
            pi = q.mean(axis=0)
        assert row / row.sum() == pytest.approx(pi, abs=1e-4)


def test_language_without_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    got = language_id.identify(docs(spark, [(1, "word")]), language_id.fit(empty)).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)


# decontamination


def test_edit_distance_within():
    assert decontaminate.edit_distance_within("kitten", "xx sitting yy") == 2
    assert decontaminate.edit_distance_within("abc", "") == 3
    assert decontaminate.edit_distance_within("", "abc") == 0


def test_leaks(spark):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 3, 8, 12, 20, 31, 45, 90, 200])] + [(50, None), (51, "!?")]
    noise = lambda n: " ".join(rnd.choice(vocab) + "x" for _ in range(n))
    rows = [(i, f"{noise(rnd.randrange(40))}\n{t.upper() if i % 2 else t}, {noise(9)}") for i, t in items[:9]] + [(100, noise(400)), (101, None), (102, "")]
    words = items[5][1].split()
    words[7], words[20] = "zzz", "yyyyyy"
    rows.append((103, noise(30) + " " + " ".join(words) + noise(5)))
    got = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    found = {r.doc_id: {(x.item_id, x.distance == 0) for x in r.leaks} for r in got.collect()}
    for i in range(9):
        assert (i, True) in found[i]
    assert found[103] == {(5, False)}
    assert not found[100] and not found[101] and not found[102]
    none = decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert none.filter(F.size("leaks") > 0).count() == 0


def test_leaks_odd_tables(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from it at once"
    rows = [(1, "x " * 300_000 + item), (2, item), (2, item), (None, item + "?"), (3, "")]
    table = docs(spark, rows).withColumn("leaks", F.lit("old"))
    items = spark.createDataFrame([(7, item), (8, item.upper()), (9, "")], "item_id long, text string")
    got = decontaminate.find_leaks(table, items)
    assert got.columns == ["doc_id", "text", "leaks"]
    found = sorted(((r.doc_id, sorted((x.item_id, x.distance, x.word) for x in r.leaks)) for r in got.collect()), key=repr)
    both = [(7, 0, 0), (8, 0, 0)]
    assert found == sorted([(1, [(7, 0, 300_000), (8, 0, 300_000)]), (2, both), (2, both), (None, both), (3, [])], key=repr)
    assert decontaminate.find_leaks(table.limit(0), items).count() == 0


@pytest.mark.parametrize("n_words", [6, 9, 14, 24, 40, 80, 200])
def test_recall_of_edited_items(n_words):
    rnd = random.Random(n_words)
    syllables = ["th", "er", "in", "ou", "an", "re", "st", "ly", "ed", "on", "ti", "a", "ing", "he", "wh", "ble"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    items = [" ".join(word() for _ in range(n_words)) for _ in range(150)]

    def letters(share):
        def edit(text):
            out = list(text)
            for i in rnd.sample([i for i, c in enumerate(out) if c != " "], int(share * len(out))):
                out[i] = rnd.choice("abcdefghijklmnopqrstuvwxyz")
            return "".join(out)

        return edit

    def words(text):
        out = text.split()
        for i in rnd.sample(range(len(out)), max(1, round(0.15 * len(out)))):
            out[i] = rnd.choice(["", word(), out[i] + " " + word()])
        return " ".join(out)

    sizes = {}
    for x in items:
        sizes.setdefault(decontaminate.window_of(len(x)), []).append(x)
    repeats = {k: decontaminate.repeats_for(v, *k, 0.2, 0.95, 11) for k, v in sizes.items()}
    tables = decontaminate.Tables(decontaminate.Block([(x, [i]) for i, x in enumerate(items)], repeats, 0.2, 11))
    for edit in (letters(0.10), letters(0.15), letters(0.19), words):
        texts = [" ".join([*(word() for _ in range(50)), edit(x), *(word() for _ in range(50))]) for x in items]
        got = tables.leaks(texts)
        within = [i for i, x in enumerate(items) if decontaminate.edit_distance_within(x, decontaminate.normal_text(texts[i])) <= int(0.2 * len(x))]
        assert len(within) > 60
        assert sum(any(y["item_id"] == i for y in got.get(i, [])) for i in within) >= 0.9 * len(within)


def random_texts(rnd, n, words, letters="abcdefgh"):
    return [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(words)) for _ in range(n)]


def test_parts_lose_no_candidate():
    rnd = random.Random(7)
    items = [*random_texts(rnd, 20, 3), *random_texts(rnd, 20, 12), *random_texts(rnd, 10, 60)]
    tables = decontaminate.Tables(decontaminate.Block([(x, [i]) for i, x in enumerate(items)], {}, 0.2, 11))
    texts, places = [], []
    for x in items:
        head, edited = random_texts(rnd, 1, rnd.randint(1, 20))[0], decontaminate._edited(x, 0.2, rnd)
        texts.append(f"{head} {edited} {random_texts(rnd, 1, 9)[0]}")
        places.append((len(head) + 1) // decontaminate.NEAR)
    codes, begins = decontaminate.normal_codes(texts)
    found = np.array([(i, j, places[i]) for i in range(len(items)) for j in range(len(items))])
    ok = {(i, j) for (i, j, _), good in zip(found.tolist(), tables.near_enough(codes, begins, found)) if good}
    for i, x in enumerate(items):
        if decontaminate.edit_distance_within(x, decontaminate.normal_text(texts[i])) <= int(0.2 * len(x)):
            assert (i, i) in ok
    assert sum(i != j for i, j in ok) < len(items) * len(items) // 4


def test_pieces_where_walks_do_not_reach(monkeypatch):
    rnd = random.Random(8)
    items = sorted(set(random_texts(rnd, 60, 2, "abcdefghijklmnopqrstuvwxyz") + random_texts(rnd, 60, 4, "abcdefghijklmnopqrstuvwxyz")))
    monkeypatch.setattr(decontaminate, "MOST_REPEATS", 1)
    assert decontaminate.repeats_for(items[:20], 6, 1, 0.2, 1.01, 11) == 0
    sizes = {decontaminate.window_of(len(x)): 0 for x in items}
    tables = decontaminate.Tables(decontaminate.Block([(x, [i]) for i, x in enumerate(items)], sizes, 0.2, 11))
    texts = [f"{random_texts(rnd, 1, 5)[0]} {decontaminate._edited(x, 0.2, rnd)} {random_texts(rnd, 1, 5)[0]}" for x in items]
    got = tables.leaks(texts)
    for i, x in enumerate(items):
        within = decontaminate.edit_distance_within(x, decontaminate.normal_text(texts[i])) <= int(0.2 * len(x))
        assert any(y["item_id"] == i for y in got.get(i, [])) == within


def test_a_benchmark_of_several_blocks(spark, monkeypatch):
    rnd = random.Random(9)
    items = [(i, t) for i, t in enumerate(random_texts(rnd, 12, 20))]
    rows = [(i, f"{random_texts(rnd, 1, 9)[0]} {t} {items[(i + 5) % 12][1]}") for i, t in items] + [(99, None)]
    table, asked = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    one = sorted((r.doc_id, sorted(x.item_id for x in r.leaks)) for r in decontaminate.find_leaks(table, asked).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    assert len(list(decontaminate.blocks_of(asked, 0.2, 0.95, 11, "item_id", "text"))) >= 3
    assert sorted((r.doc_id, sorted(x.item_id for x in r.leaks)) for r in decontaminate.find_leaks(table, asked).collect()) == one
    assert one == [(i, sorted([i, (i + 5) % 12])) for i in range(12)] + [(99, [])]


# licences, URLs


def test_license_units(spark):
    mit = licenses.TEMPLATES[2].text
    d = docs(spark, [(1, "intro\nreleased under the MIT licence.\nLicensed under CC BY-NC 4.0"), (2, mit.replace("sell", "vend")), (3, mit[:60] + "\n" + mit[60:]), (4, None), (5, ""), (6, "Licensed")])
    got = {(r.doc_id, r.unit, r.license_id, r.template) for r in licenses.scan_licenses(d, least=0.7).collect()}
    assert {(1, 3, "CC-BY-NC-4.0", "notice"), (2, 1, "MIT", "permission"), (3, 0, "MIT", "permission")} <= got
    assert {g[0] for g in got} <= {1, 2, 3}
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_license_paragraphs_and_odd_rows(spark):
    words = licenses.TEMPLATES[2].text.split()
    framed = "\n".join(" * " + " ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    code = "\n".join(f"x = {i}" for i in range(60))
    rows = [(1, f"{code}\n/*\n{framed}\n */\n{code}"), (1, f"{code}\n\n{framed}"), (2, " ".join(f"w{i}" for i in range(200_000)) + "\n\nReleased under the MIT License."), (2, "Licensed under CC BY 4.0."), (2, "Licensed under CC BY 4.0.")]
    d = docs(spark, rows).withColumn("dice", F.lit("kept elsewhere"))
    got = sorted((r.doc_id, r.unit, r.license_id, r.template, r.dice) for r in licenses.scan_licenses(d).collect())
    assert [g[:4] for g in got] == [(1, -2, "MIT", "permission"), (1, -2, "MIT", "permission"), (2, 1, "CC-BY-4.0", "notice"), (2, 1, "CC-BY-4.0", "notice"), (2, 3, "MIT", "notice")]
    assert all(g[4] == 1 for g in got)


def test_size_range_never_prunes_a_match():
    for n in range(1, 60):
        low, high = licenses.size_range(n, 0.8)
        assert all(low <= m <= high for m in range(1, 200) if 2 * min(n, m) / (n + m) >= 0.8)


def test_urls(spark):
    urls = ["https://a.example.com/en/1", "http://www.EXAMPLE.com/en/", "https://x.com", "ftp://y.com/?q", "https://b.net/fr/x#y", "http://m.q.org/a.html", "no scheme", None, "https://notexample.com/en/", "http://c.org/Casino/x", "https://a.example.com/en/1"]
    urls += ["http://x\ny.com/a", "http://x.org/" + "y" * 100_000 + "/ads/txt/z", "http://com\n/a", "http://roads.org/x/ads/y", "http://ads.net/", "http://x.org/pixel.gift", "http://x.org/PIXEL.gif?u"]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls)
    want = [("example.com/en/", "block"), ("www.example.com/en/", "allow"), (None, "allow"), ("com/", "allow"), ("net/fr/", "block"), (None, "block"), (None, "allow"), (None, "allow"), ("com/", "allow"), (None, "block"), ("example.com/en/", "block")]
    want += [("com/", "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow"), (None, "block")]
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == want
    assert (got[1].host, got[1].path, got[6].host, got[7].path) == ("www.example.com", "/en/", "", "")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, (url_filter.filter_rule("*x*"),))


def test_rules_of_equal_rank(spark):
    own = lambda name, verdict: url_filter.Rule(name, verdict, ("ads",), 5, True, url="ads")
    pages = spark.createDataFrame([(1, "http://x.org/ads/1"), (1, "http://x.org/ads/1")], "page_id long, url string")
    got = url_filter.judge_urls(pages, (own("b", "allow"), own("a", "block"))).collect()
    assert [(r.rule, r.verdict) for r in got] == [("b", "allow")] * 2  # the larger name


def test_filter_lines_and_their_tokens():
    rule = url_filter.filter_rule
    assert rule("||m.*.html|").tokens == ("m", "html") and rule("/pixel.gif^").tokens == ("pixel", "gif")
    assert rule("||ads").tokens == () and rule("@@ads.net^").verdict == "allow" and rule("ads.net^").tokens == ("net",)
    for line in ("", "! comment", "x$script", "a##b"):
        with pytest.raises(ValueError):
            rule(line)


def test_urls_like_their_sql(spark, tmp_path):
    from spanwright.llm.registry import ORACLES, QUERIES
    from tests.compare import compare

    urls = ["http://x\ny.com/a", "http://x\n.com", "https://m.a.org/x.HTML", "https://a.org/ads/txt/1", "https://ads.org/ads/txt/1", "x", None, "", "://", "a://b://c.com/d", "https://tracker.a.com/", "https://tracker.a.de/"] * 2
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations"):
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    assert compare(spark, str(tmp_path), QUERIES["op6_url_filter"], ORACLES["op6_url_filter"]) == ""


# WARC


def test_warc_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    html = ["<p>é</p>", "<p>é</p>", None, "", "z" * 300_000, "<p>é</p>"]
    pages = spark.createDataFrame([(10 - i, f"http://h/{i}\nx", h) for i, h in enumerate(html)] + [(None, None, "<p>é</p>"), (None, None, "alone")], "page_id long, url string, html string")
    warc.write_pages(pages.repartition(3), path)
    got = {(r.record_id, r.target_uri): r for r in warc.read_warc(spark, path, verify=True).collect()}
    assert len(got) == 8
    first = got[("urn:page:5", "http://h/5%0Ax")]
    assert (first.record_type, first.payload, first.payload_digest) == ("response", "<p>é</p>".encode(), warc.digest32("<p>é</p>".encode()))
    assert [(got[(f"urn:page:{10 - i}", f"http://h/{i}%0Ax")].record_type, got[(f"urn:page:{10 - i}", f"http://h/{i}%0Ax")].refers_to) for i in (0, 1, 2, 3)] == [("revisit", "urn:page:5"), ("revisit", "urn:page:5"), ("revisit", "urn:page:7"), ("response", None)]
    assert all(r.payload_bytes == len("<p>é</p>".encode()) for r in got.values() if r.refers_to == "urn:page:5")
    assert sorted(r.record_type for k, r in got.items() if "none:" in k[0]) == ["response", "revisit"]
    for schema in ("record_type string, record_id string", "record_type string, payload_bytes long"):
        assert warc.read_warc(spark, path, schema=schema).filter("record_type = 'revisit'").count() == 4
    big = warc.read_warc(spark, path).filter(F.col("record_id").isin("urn:page:6")).select("payload", "payload_bytes").first()
    assert big.payload_bytes == 300_000 and len(big.payload) == 300_000
    assert warc.read_warc(spark, path, schema="payload_bytes long").agg(F.sum("payload_bytes")).first()[0] == sum(len((h or "").encode()) for h in html) + len("<p>é</p>".encode()) + 5


def test_warc_of_an_empty_table_and_clashing_names(spark, tmp_path):
    pages = spark.createDataFrame([(2, "u", "<p>", "mine", 7), (1, "u", "<p>", "mine", 7)], "page_id long, url string, html string, record_type string, refers_to int")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.with_revisits(pages).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1)}
    empty = f"file://{tmp_path}/none"
    warc.write_pages(pages.limit(0), empty)
    assert warc.read_warc(spark, empty, verify=True).count() == 0


def test_warc_plain_gzip_and_minimum_size(spark, tmp_path):
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(warc.warc_record("response", f"urn:x:{i}", "u", None, b"p" * 9000 * i, "1970-01-01T00:00:00Z")) for i in range(3)))
    got = warc.read_warc(spark, f"file://{tmp_path}", verify=True)
    assert sorted(r.payload_bytes for r in got.collect()) == [0, 9000, 18000]
    assert got.filter("record_id = 'urn:x:1'").count() == 1
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.with_revisits(pages, min_bytes=3).filter("record_type = 'revisit'").collect()) == [4]


# nearest neighbours


def test_hadamard_keeps_norms():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(ann.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_nearest_handles_odd_rows_and_ties(spark):
    rows = [(i, [1.0, float(i % 3), 0.5, -0.0]) for i in range(60)] + [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 1.0, 1.0, 1.0]), (104, [1.0]), (None, [1.0] * 4), (0, [1.0, 0.0, 0.5, 0.0]), (20, [1.0, 2.0, 0.5, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(d, F.col("vec_id") % 20 == 0, k=5).collect()
    good = {i: np.array(v) for i, v in rows[:60]}
    for q in (0, 20, 40):
        want = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, pytest.approx(-s)) for s, i in want]
    assert {r.query_id for r in got} == {0, 20, 40}


def test_nearest_recall_with_unequal_norms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.2, 3, size=(1500, 1))
    d = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.nearest(d, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[q] & set([i for i in np.argsort(-(x @ x[q])) if i != q][:10])) for q in got)
    assert len(got) == 75 and all(len(v) == 10 for v in got.values())
    assert hit / 750 >= 0.9


def test_probes_are_the_best_buckets_of_all_rotations():
    index = ann.CrossPolytope(6, 1.0, False, 2, 10, 3)
    assert index.width == 8 and index.parts == [4, 4, 2]
    x = np.random.default_rng(1).normal(size=(40, 6))
    for table in (0, 1):
        a, b, c = index._axes(index._wide(x, True), table)
        sums = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(len(x), -1)
        got = index.order(x, table, 50)
        assert np.allclose(np.take_along_axis(sums, got, axis=1), -np.sort(-sums, axis=1)[:, :50])
        assert np.array_equal(np.sort(index.order(x, table, 1 << 10), axis=1), np.tile(np.arange(1 << 10), (40, 1)))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.array_equal(index.buckets(unit)[:, 1], index.order(x, 1, 1)[:, 0])


@pytest.mark.parametrize(("bits", "probes"), [(4, 3), (9, 40), (11, 120)])
def test_nearest_with_layouts_of_several_rotations(spark, monkeypatch, bits, probes):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(60, 1, 8)) + 0.15 * rng.normal(size=(60, 40, 8))).reshape(-1, 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "calibrated", lambda *a: (a[-1](bits), probes))
    monkeypatch.setattr(ann, "SHARD_ROWS", 300)
    got = {}
    for r in ann.nearest(d, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12)
    assert len(got) == 120 and all(len(v) == 10 for v in got.values())
    assert sum(len(got[q] & set([i for i in np.argsort(-(x @ x[q])) if i != q][:10])) for q in got) / 1200 >= 0.9


def test_nearest_falls_back_on_all_rows_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "calibrated", lambda *a: (a[-1](12), 1))  # hardly any query finds ten neighbours
    monkeypatch.setattr(ann, "SHARD_ROWS", 70)
    got = {}
    for r in ann.nearest(d, F.col("vec_id") % 2 == 0, k=10, tables=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    exact = sum([v for _, v in sorted(got[q])] == [i for i in np.argsort(-(x @ x[q])) if i != q][:10] for q in got)
    assert len(got) == 250 and exact >= 245


def test_nearest_keeps_ties_of_equal_vectors_by_id(spark):
    x = np.random.default_rng(8).normal(size=(30, 4))
    d = spark.createDataFrame([(i, x[i % 30].tolist()) for i in range(3000)], "vec_id long, embedding array<double>")
    for q in ann.nearest(d, F.col("vec_id") == 60, k=20).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect():
        best = int(np.argmax(x @ x[0]))
        assert sorted(q.v) == [i for i in range(best, 3000, 30) if i != 60][:20]


def test_nearest_few_rows(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(d, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 4.0)]
    assert ann.nearest(d.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(d, F.col("vec_id") == 9).count() == 0 and ann.nearest(d, F.lit(None).cast("boolean")).count() == 0
    assert ann.nearest(d.limit(1), F.lit(True)).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_path(spark, "x").startswith(common.shared_dir(spark))
