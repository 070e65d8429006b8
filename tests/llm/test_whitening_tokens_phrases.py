"""Whitening, token counts and collocations against plain versions: nulls, ties, repeats, clashing columns, empty tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanwright.llm import collocations, registry, token_counts, whitening

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


# whitening


def rotated(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "a",
    [
        np.cov(np.random.default_rng(0).standard_normal((64, 200))), np.eye(10), np.zeros((5, 5)), np.outer(np.arange(6.0), np.arange(6.0)), np.array([[4.0]]),
        np.diag([3.0, 3, 2, 2, 1]), rotated([3.0, 3, 3, 2, 2, 1, 1, 1]), rotated([3.0, 3 - 1e-13, 1, 1e-9]), rotated([1e6, 1.0, 1.0, 1 - 1e-15, 1e-8, 0]), rotated([2.0, 2 - 2e-15, 2 - 4e-15]),
    ],
)
def test_components_against_eigh(a):
    values, vectors = whitening.components_of(a, 8)
    want = np.linalg.eigvalsh(a)[::-1][:8]
    scale = max(np.abs(want).max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * scale
    assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-13 * scale


def test_polar_factor():
    a = np.random.default_rng(3).standard_normal((20, 20))
    a[:, 3] = a[:, 2] + 1e-9  # nearly singular
    u, _, v = np.linalg.svd(a)
    assert np.abs(whitening.polar(a) - u @ v).max() < 1e-5
    assert np.abs(whitening.polar(a).T @ whitening.polar(a) - np.eye(20)).max() < 1e-13


def test_op11_against_eigh(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = defaultdict(dict)
    for r in registry.QUERIES["op11_whitening"](spark, SF).collect():
        got[r.vec_id][r.component] = r
    x = np.floor(1024 * np.array([*rows.values()], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    want = c @ q / np.sqrt(e)
    have = np.array([[got[i][k].whitened for k in range(1, 9)] for i in rows])
    signs = np.sign((have * want).sum(axis=0))
    assert np.abs(have - want * signs).max() < 1e-9
    assert [got[i][1].deviation for i in rows] == ((n * x - s) ** 2).sum(axis=1).tolist()
    one = got[next(iter(rows))]
    assert [one[k].explained for k in range(1, 9)] == pytest.approx((e / np.trace(v)).tolist(), rel=1e-9)
    assert one[1].n == n and one[1].identity_error < 1e-10


VECTORS = "vec_id long, embedding array<double>, whitened string, N int"


def test_whitening_drops_only_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.0]), (2, [2.0, 1.0, 0.0]), (2, [2.0, 1.0, 0.0]), (None, [0.0, 0.5, 0.0]), (3, None), (4, [1.0, None, 0.0]), (5, [1.0, nan, 0.0]), (6, [inf, 0.0, 0.0]), (7, [])]
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], VECTORS)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 2, 2] and {r.N for r in got} == {7} and model.n == 4
    assert all(r.whitened[2] is None and None not in r.whitened[:2] for r in got)  # the third entry never varies
    white = np.array([r.whitened[:2] for r in got])
    assert np.abs(white.T @ white / 4 - np.eye(2)).max() < 1e-12 and whitening.identity_error(df, model) < 1e-12


def test_whitening_of_equal_empty_and_uneven_vectors(spark):
    same = spark.createDataFrame([(i, [0.25, -0.5], None, None) for i in range(3)], VECTORS)
    model = whitening.fit(same)
    assert [(r.deviation, r.whitened) for r in whitening.whiten(same, model).collect()] == [(0, [None, None])] * 3
    assert whitening.identity_error(same, model) == 0
    none = same.filter("vec_id < 0")
    assert whitening.whiten(none, whitening.fit(none)).count() == 0 and whitening.fit(none).n == 0
    uneven = spark.createDataFrame([(1, [1.0], None, None), (2, [1.0, 2.0], None, None)], VECTORS)
    with pytest.raises(Exception, match="entries cannot be whitened together"):
        whitening.fit(uneven)


def test_whitening_deviation_beyond_64_bits(spark):
    rows = [(i, [float(i % 2) * 2.0**40, float(i)], None, None) for i in range(5)]
    df = spark.createDataFrame(rows, VECTORS)
    x = [[int(v * 1024) + 100_000 for v in r[1]] for r in rows]
    s = [sum(c) for c in zip(*x)]
    want = [sum((5 * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    assert max(want) > 1 << 64
    got = whitening.whiten(df, whitening.fit(df)).orderBy("vec_id").collect()
    assert [int(r.deviation) for r in got] == want


# token counts


def by_library(texts, path=BYTES):
    own = Tokenizer.from_file(path)
    return [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_op12_against_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in registry.QUERIES["op12_token_counts"](spark, SF).collect()}
    assert sorted(got) == sorted(docs)
    for (i, text), n in zip(docs.items(), by_library(docs.values())):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512)


def test_byte_level_rule_over_all_plain_code_points():
    own = token_counts.Counting(*token_counts.tokenizer_file(BYTES)[1:])
    for i in range(0x250):
        c = chr(i)
        for text in (c, f"a{c}b", f"1{c}2", f" {c}", f" {c}{c}", f"{c} x", f".{c}.", f"x {c} y{c}", f"'{c}", f"\n{c}  {c}"):
            assert [p for part in own.pre_tokens(text) for p in part] == own._by_library(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_of_odd_texts(name, monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE", 7)
    monkeypatch.setattr(token_counts, "CACHED", 20)
    own = token_counts.Counting(*token_counts.tokenizer_file(public_tokenizers.path(name))[1:])
    rng = random.Random(1)
    letters = "ab'stre 1²½.,!\n\t é ß\u0085 -_x<|endoftext|> 中\U0001f600́"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        text = f"{text}<|endoftext|>{text[::-1]}" if rng.random() < 0.2 else text
        added, parts = own.parts(text)
        assert added + sum(own.length(p) for part in parts for pieces in own.pre_tokens(part) for p in pieces) == own.whole(text)


def test_token_counts_of_nulls_long_texts_and_clashes(spark):
    texts = [None, "", " ", "a" * 5000, "word " * 30_000, "x<|endoftext|>y", "x<|endoftext|>y", "中文 日本語", "\n\n  a"]
    df = spark.createDataFrame([(None if i == 3 else i, t, "own", "k") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, piece string")
    got = token_counts.count_tokens(df, BYTES, limit=3).collect()
    assert Counter((r.text, r.n_tokens, r.piece) for r in got) == Counter((t, n, "k") for t, n in zip(texts, by_library(texts)))
    assert all(r.over_limit == (r.n_tokens > 3) and r.n_bytes == len((r.text or "").encode()) for r in got)
    assert token_counts.count_tokens(df.filter("false"), BYTES).count() == 0
    small = token_counts.count_tokens(df, BYTES, table_bytes=16).agg(F.sum("n_tokens")).first()[0]
    assert small == sum(by_library(texts))
    with pytest.raises(ValueError, match="json or a .model"):
        token_counts.tokenizer_file(__file__)


def test_token_counts_of_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello there, world", "", None, "  two  blanks 中"]
    got = token_counts.count_tokens(spark.createDataFrame([(t,) for t in texts], "text string"), path).collect()
    assert [r.n_tokens for r in got] == [len(own.encode(t or "")) for t in texts]


# collocations


def brute(texts, least, top, longest=4):
    f, n = Counter(), Counter()
    for lang, text in texts:
        lang = lang or "und"
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        f[lang, tuple(words[i : i + k])] += 1
    f = {p: a for p, a in f.items() if a >= least}
    over = defaultdict(int)
    for (lang, p), a in f.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                over[lang, p[i : i + k]] = max(over[lang, p[i : i + k]], a)
    out = []
    for lang in n:
        found = []
        for (g, p), a in f.items():
            if g == lang and len(p) > 1 and not 100 * over[lang, p] >= 80 * a:
                score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_texts():
    rng = random.Random(5)
    words = ["the", "The", "of", "und", "ß", "é", "new", "york", "x,y", "a.b", "\x00", "z z"] + [f"w{i}" for i in range(12)]
    texts = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    return texts + [("en", "New York city hall\tnew york")] * 40 + [("en", None), ("fr", ""), (None, ". ,;:!?\r\n\x0b\x0c"), ("de", "a " * 3000)]


@pytest.mark.parametrize(("chunk", "suffixes", "small", "noted"), [(1 << 20, 1 << 21, 1024, 64), (300, 150, 16, 8), (50, 40, 9, 64)])
def test_collocations_against_brute_force(spark, monkeypatch, chunk, suffixes, small, noted):
    for name, value in (("CHUNK_WORDS", chunk), ("RANGE_SUFFIXES", suffixes), ("SMALL", small), ("NOTED", noted), ("SLICE", 50)):
        monkeypatch.setattr(collocations, name, value)
    texts = phrase_texts()
    df = spark.createDataFrame([(*t, "own", 1) for t in texts], "lang string, text string, phrase string, n int").repartition(3)
    got = collocations.collocations(df, least=12, top=50).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, 12, 50)
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(df.filter("false")).count() == 0


def test_quicksort_reports_cut_phrases_below_the_least():
    columns = [np.array([1, 1, 2, 2, 2]), np.array([3, 3, 0, 4, 4])]
    edge = np.array([1, 1, 0, 0, 0], np.int8)
    got = {(tuple(int(c[r]) for c in columns[:k]), int(t)) for rows, k, ts in collocations.frequent(columns, np.ones(5, np.int64), 3, edge) for r, t in zip(rows, ts)}
    assert got == {((1,), 2), ((2,), 3)}
