"""Similar word sets against all pairs."""

import random

import numpy as np
import pytest

from spanwright.operators import similarity


def brute(texts, least):
    sets = {}
    for i, t in texts:
        words = frozenset("".join(c if c.isascii() and (c.islower() or c.isdigit()) else " " for c in (t or "").lower()).split())
        if words and i is not None:
            sets.setdefault(words, []).append(i)
    named = sorted((min(ids), s) for s, ids in sets.items())
    out = [(min(ids), i, 1.0) for ids in sets.values() for i in ids if i != min(ids)]
    for k, (a, x) in enumerate(named):
        out += [(a, b, len(x & y) / len(x | y)) for b, y in named[k + 1 :] if len(x & y) / len(x | y) >= least]
    return sorted(out)


def some_texts(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "a"]
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.6:
            own = rng.choice(texts)[1].split()
            for _ in range(rng.randint(0, max(1, len(own) // 8))):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = [rng.choice(words) for _ in range(rng.choice([1, 2, 9, 40, 300]))]
        rng.shuffle(own)
        texts.append((i, " ".join(own)))
    return texts


@pytest.mark.parametrize(("seed", "least"), [(1, 0.9), (2, 0.75), (3, 0.5), (4, 1.0)])
def test_pairs_against_all_pairs(spark, seed, least):
    texts = [*some_texts(seed), (900, None), (901, ""), (902, "-- ?"), (903, "The OF"), (904, "of the!"), (905, "of the")]
    got = similarity.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), least).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, least)


def test_filters_leave_few_candidates(spark):
    docs = spark.createDataFrame(some_texts(9, 400), "doc_id long, text string")
    classes, _ = similarity._classes(docs, 0.9)
    pairs = similarity.jaccard_classes(docs, 0.9).filter("jaccard < 1").count()
    assert pairs <= similarity.candidates(classes, 0.9).count() <= 5 * pairs


def test_a_clash_of_all_buckets_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(similarity, "COUNTED", 1)
    texts = some_texts(5, 60)
    got = similarity.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string"), 0.8).collect()
    assert sorted(tuple(r) for r in got) == brute(texts, 0.8)


def test_empty_table_and_bounds(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similarity.jaccard_classes(docs, 0.9).count() == 0 and similarity.set_classes(docs).count() == 0
    with pytest.raises(ValueError, match="above 0"):
        similarity.jaccard_classes(docs, 0)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (set(rng.integers(0, 1000, rng.integers(1, 600)).tolist()) for _ in range(2))
        bits = lambda s: np.bincount([x % similarity.PARITIES for x in s], minlength=similarity.PARITIES) & 1
        assert (bits(a) ^ bits(b)).sum() <= len(a ^ b)
