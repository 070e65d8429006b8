"""The pipeline against a plain version of its stages, and its contract."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from spanwright.llm.decontaminate import edit_distance_within

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])


def plain(docs, benchmark):
    """Language, lines, near-duplicates and leaks by loops over all documents."""
    kept = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    seen = Counter(k for t in kept.values() for k in {key(x) for x in t.split("\n")} if k)
    kept = {i: "\n".join(x for x in t.split("\n") if seen[key(x)] < 10) for i, t in kept.items()}
    sets = {i: shingles(t) for i, t in kept.items()}
    root = {}
    for i in sorted(kept):
        if i in root:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            root[j] = i
            todo += [k for k in kept if k not in root and k not in todo and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k])]
    kept = {i: t for i, t in kept.items() if root[i] == i}
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [words(t) for t in benchmark]
    return {i: t for i, t in kept.items() if not any(b in words(t) for b in items)}


def test_pipeline_matches_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain(docs, benchmark)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    names = df.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.stored(stage(spark, df, SF), "test-stage")
        assert df.columns == names
    assert {r.doc_id: r.text for r in df.collect()} == want
    assert all(r.n_chars == len(r.text) for r in df.collect())
    mixed = corpus_pipeline.mixing(spark, df, SF).collect()
    assert {r.doc_id for r in mixed} <= set(want) and all(1 <= r.copies <= 3 for r in mixed)
    taken, total = Counter(), sum(len(t.encode().split()) for t in want.values())
    for r in mixed:
        taken[r.source] += r.copies * len(r.text.encode().split())
    assert sum(taken.values()) == pytest.approx(total, rel=0.05)


def test_pipeline_survives_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "Some words here", "en", None, 1), (2, "", "en", "s", 0), (3, "Some words here", "en", "s", 15), (3, "Some words here", "en", "s", 15), (4, "word " * 50_000, "de", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.stored(stage(spark, df, SF), f"odd-{name}")
    assert {r.doc_id for r in df.collect()} <= {3, 4}
    empty = df.limit(0).drop("copies")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mixing"]
    assert edit_distance_within("abcd", "xxabxd") == 1


def test_clean_documents_of_several_languages_stay(spark):
    """Passages of three and of four languages in one document: none of them has half of it."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").filter("text is not null and length(text) > 1500").orderBy("doc_id").collect()
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, r.text[:500])
    langs = sorted(by_lang)
    mixed = [(900_001, "\n".join(by_lang[x] for x in langs[:3])), (900_002, "\n".join(by_lang[x] for x in langs[:4])), (900_003, "123 456"), (900_004, None)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in mixed], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), SF).filter("doc_id > 900000").collect()}
    assert len(langs) >= 4 and kept == {900_001, 900_002}
