"""Near copies by word shingles against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from spanwright.llm import near_copies
from spanwright.llm.simhash import simhash64


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def plain(docs):
    """Ids that stay: the smallest of each component over all pairs."""
    sets, root = {i: shingles(t) for i, t in docs}, {}
    for i in sorted(sets):
        todo = [] if i in root else [i]
        while todo:
            if (j := todo.pop()) not in root:
                root[j] = i
                todo += [k for k in sets if k not in root and similar(sets[j], sets[k])]
    return {i for i, r in root.items() if i == r}


def edited(rng, words, n):
    w = list(words)
    for at in rng.sample(range(len(w)), n):
        w[at] = f"new{rng.randrange(1 << 30)}"
    return " ".join(w)


def varied(groups, copies):
    rng, out = random.Random(5), []
    for g in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([80, 200, 400]))]
        out += [" ".join(words)] + [edited(rng, words, rng.randrange(1, len(words) // 20)) for _ in range(copies)]
    rng.shuffle(out)
    return list(enumerate(out + ["", "  ", "one two", "One  two", None]))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_drops_near_copies_beyond_two_bits(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    docs = [(1, " ".join(words)), (2, edited(rng, words, 5)), (3, edited(rng, words, 60))]
    assert (simhash64(docs[0][1]) ^ simhash64(docs[1][1])).bit_count() > 2 and plain(docs) == {1, 3}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, docs), "").collect()} == {1, 3}


@pytest.mark.parametrize("meet", [512, 5])
def test_keep_one_similar_matches_all_pairs(spark, monkeypatch, meet):
    """Also with most keys going through shards and blocks."""
    monkeypatch.setattr(near_copies, "MEET", meet)
    docs = varied(12, 12)
    assert {r.doc_id for r in near_copies.keep_one_similar(frame(spark, docs)).collect()} == plain(docs)


def test_texts_without_copies_stay_where_they_are(spark):
    """Exchanges carry numbers and fingerprints, not each text twice and more."""
    rng = random.Random(8)
    docs = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(1500))) for i in range(120)]
    docs.append((500, edited(rng, docs[0][1].split(), 9)))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert {r.doc_id for r in near_copies.keep_one_similar(frame(spark, docs)).collect()} == set(range(120))
    assert written() - before < 0.3 * sum(len(t) for _, t in docs)


def test_rows_of_one_id_and_rows_without_one(spark):
    """Where several rows are meant, the smallest text stays; a full filter only lets more texts travel."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = [(5, a.upper()), (5, a), (5, a), (9, a), (None, b), (None, b.title()), (2, c), (None, c)]
    got = near_copies.keep_one_similar(frame(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("5", a.upper()), ("None", b.title()), ("2", c)])


def test_filters_of_numbers_miss_none(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "FILTER_BITS", 1 << 16)
    rows, even = spark.range(40_000).withColumnRenamed("id", "cls"), spark.range(0, 40_000, 2).withColumnRenamed("id", "cls")
    assert near_copies._held(rows, even).count() == 20_000  # beyond what the filter can tell, a join decides
    few = {r.cls for r in near_copies._held(rows, even.filter("cls < 2000")).collect()}
    assert few >= {r.cls for r in even.filter("cls < 2000").collect()} and len(few) < 4000


def test_keep_one_similar_matches_all_pairs_of_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id is not null")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    assert {r.doc_id for r in near_copies.keep_one_similar(table).collect()} == plain(docs)


def test_near_copies_meet_by_their_fingerprints(spark, monkeypatch):
    """Links come from SimHash fingerprints in reach of each other: with none in reach there are none."""
    docs = [x for x in varied(4, 4) if len((x[1] or "").split()) > near_copies.TINY + 5]
    assert {r.doc_id for r in near_copies.keep_one_similar(frame(spark, docs)).collect()} == plain(docs)
    monkeypatch.setattr(near_copies, "FAR", -1)
    assert near_copies.keep_one_similar(frame(spark, docs)).count() == len(docs)


@pytest.mark.parametrize("paired", [128, 3])
def test_groups_are_the_components_of_near_fingerprints(monkeypatch, paired):
    monkeypatch.setattr(near_copies, "PAIRED", paired)
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    w = centre[rng.integers(0, 12, 300)]
    for _ in range(25):
        w[np.arange(300), rng.integers(0, 2, 300)] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    key = np.sort(rng.integers(0, 6, 300)).astype(np.uint32)
    near = (np.bitwise_count(w[:, None] ^ w[None]).sum(axis=2) <= near_copies.FAR) & (key[:, None] == key[None])
    want = np.arange(300)
    for _ in range(300):
        want = np.where(near, want[None], 300).min(axis=1)
    assert near_copies._groups(key, w[:, 0], w[:, 1], near_copies.FAR).tolist() == want.tolist() and len(set(want)) > 20


@pytest.mark.parametrize("both,left,right", [(4, 1, 0), (8, 1, 1), (12, 3, 0), (16, 2, 2), (40, 10, 0), (80, 10, 10), (800, 100, 100)])
def test_pairs_of_the_least_similarity_have_a_block_in_common(both, left, right):
    """Recall of the blocks at a Jaccard of 0.8, by size; 0.995 is 2.5 deviations below 0.998 for so many pairs."""
    rng, (blocks, bits) = np.random.default_rng(both), near_copies.layout(50_000)
    found, trials = 0, 1000
    for _ in range(trials):
        h = rng.integers(0, 1 << 64, both + left + right, dtype=np.uint64)
        a, b = h[: both + left], np.concatenate([h[:both], h[both + left :]])
        if max(len(a), len(b)) <= near_copies.TINY:
            keys = [set(near_copies._mix(np.append(x.sum(dtype=np.uint64) - x, x.sum(dtype=np.uint64))).tolist()) for x in (a, b)]
            found += bool(keys[0] & keys[1])
            continue
        x, y = (np.unpackbits(np.frombuffer(near_copies.fingerprint(z, -(-blocks * bits // 64)), np.uint8)) for z in (a, b))
        same = (x == y)[: blocks * bits].reshape(blocks, bits).all(axis=1).any()
        found += bool(same and (x != y)[:128].sum() <= near_copies.FAR)
    assert found >= 0.995 * trials
