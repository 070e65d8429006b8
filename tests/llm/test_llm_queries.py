"""The registered queries on the smallest tables: SQL twins, or brute force where SQL cannot state them."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from compare import compare
from spanwright.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    assert not compare(spark, SF, registry.QUERIES[name], registry.ORACLES[name])


def test_op1_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = defaultdict(list)
    for r in result(spark, "op1_ann"):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids if i % 20 == 0)
    hit = total = 0
    for q, found in got.items():
        s = x @ x[list(ids).index(q)]
        want = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want) + 1))
        assert all(v == pytest.approx(s[list(ids).index(i)], abs=1e-12) for _, i, v in found)
        hit, total = hit + len({f[1] for f in found} & set(want)), total + len(want)
    assert hit / total >= 0.9


def test_op4_finds_every_exact_item(spark, documents):
    words = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(i, k) for i, r in documents.items() for k, t in items.items() if t in words(r.text)}
    got = {(r.doc_id, r.item_id): r for r in result(spark, "op4_decontaminate")}
    assert want == {k for k, r in got.items() if r.distance == 0}
    assert all(r.similarity >= 0.8 for r in got.values())


def test_op5_against_all_pairs(spark, documents):
    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps, root = {i: fp(r.text) for i, r in documents.items()}, {}
    for i in sorted(fps):
        todo = [] if i in root else [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += [k for k in fps if k not in root and (fps[j] ^ fps[k]).bit_count() <= 2]
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in result(spark, "op5_simhash")} == {(i, f"{fps[i]:016x}", root[i]) for i in fps}


def test_op7_held_out_accuracy(spark, documents):
    got = result(spark, "op7_language_id")
    assert len(got) == len(documents)
    held = [r for r in got if r.held_out and documents[r.doc_id].lang and r.lang_pred != "und"]
    assert len(held) > 30
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_op8_targets(spark, documents):
    got, by = result(spark, "op8_mixing"), defaultdict(list)
    assert len(got) == len(documents)
    for r in got:
        assert r.size == len((documents[r.doc_id].text or "").encode().split())
        assert 0 <= r.taken <= 3 * r.size
        by[documents[r.doc_id].source].append(r)
    names = sorted((n for n in by if n is not None), key=lambda n: n.encode()) + [None] * (None in by)
    sizes, weights, capped = {n: sum(r.size for r in by[n]) for n in names}, {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[n] for n in capped)
        want = {n: 3.0 * sizes[n] if n in capped else left * weights[n] / sum(weights[m] for m in names if m not in capped) for n in names}
        over = {n for n in names if want[n] > 3 * sizes[n] and n not in capped}
        if not over:
            break
        capped |= over
    for n in names:
        assert all(r.target == pytest.approx(want[n]) for r in by[n])
        assert abs(sum(r.taken for r in by[n]) - want[n]) <= sorted(r.size for r in by[n])[len(by[n]) // 4]  # ten documents a source
    assert sorted(map(tuple, got)) == sorted(map(tuple, result(spark, "op8_mixing")))


def test_op10_against_all_strings(spark, documents):
    seen, want = set(), set()
    for i in sorted(documents):
        b = (documents[i].text or "").encode()
        own, gone = [b[p : p + 50] for p in range(len(b) - 49)], bytearray(len(b))
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + 50] = b"\1" * 50
        seen.update(own)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        want.add((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    assert {tuple(r) for r in result(spark, "op10_suffix_dedup")} == want


def test_pipeline_query(spark, documents):
    got = result(spark, "pipeline")
    assert got and {r.doc_id for r in got} <= set(documents)
