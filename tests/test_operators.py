"""Literal cases of the operators."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.operators import chunk, metrics, segment, similarity, stats, study, vector
from spanwright.plans import texts


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


def ranked(spark, gains, n_relevant):
    return spark.createDataFrame([(1, i + 1, g, n_relevant) for i, g in enumerate(gains)], "q int, rank int, gain int, n_relevant int")


def test_ranking_metrics(spark):
    m = metrics.per_query(ranked(spark, [0, 0, 1, 0], 1), ["q"], (2, 3)).first()
    assert (m.recall_at_3, m.recall_at_2, m.mrr_at_3) == (1.0, 0.0, pytest.approx(1 / 3))
    m = metrics.per_query(ranked(spark, [1, 0, 1, 0], 2), ["q"], (1, 2, 4)).first()
    assert (m.precision_at_4, m.precision_at_1, m.precision_at_2) == (0.5, 1.0, 0.5)
    assert metrics.per_query(ranked(spark, [1], 1), ["q"], (5,)).first().precision_at_5 == pytest.approx(0.2)
    assert metrics.per_query(ranked(spark, [0, 1], 1), ["q"], (2,)).first().ndcg_at_2 == pytest.approx(1 / math.log2(3))
    assert metrics.per_query(ranked(spark, [0, 0], 0), ["q"], (2,)).first().ndcg_at_2 == 0.0


def test_multihop_coverage(spark):
    r = spark.createDataFrame([(1, 1, "c1"), (1, 2, "c2"), (1, 3, "c3")], "q int, rank int, id string")
    need = spark.createDataFrame([(1, "a", "c1"), (1, "b", "c3")], "q int, passage string, id string")
    assert metrics.multihop_coverage(r, need, ["q"], 3).first().coverage == 1
    assert metrics.multihop_coverage(r, need, ["q"], 1).first().coverage == 0


@pytest.mark.parametrize(("a", "b", "kind", "fraction"), [((0, 2000), (500, 830), "shorter", 1.0), ((1000, 1400), (0, 24000), "shorter", 1.0), ((0, 500), (300, 5000), "shorter", 0.4), ((0, 200), (0, 400), "gold", 0.5)])
def test_span_overlap(spark, a, b, kind, fraction):
    c = spark.createDataFrame([("d", 0, *a)], "doc_id string, seq int, char_start int, char_end int")
    g = spark.createDataFrame([("g", "d", *b)], "gold_id string, doc_id string, char_start int, char_end int")
    assert chunk.span_overlap(c, g, 0.1, kind).first().fraction == pytest.approx(fraction)
    assert chunk.span_overlap(c, g, 0.5, kind).count() == (fraction >= 0.5)


def test_holm(spark):
    p = spark.createDataFrame([("f", i, x) for i, x in enumerate([0.01, 0.04, 0.03, 0.005])], "family string, i int, p double")
    got = [r.p_holm for r in stats.holm(p, "p", "i", ["family"]).orderBy("i").collect()]
    assert got == pytest.approx([0.03, 0.06, 0.06, 0.02])


@pytest.mark.parametrize(("diffs", "r"), [([0.2, 0.5, 0.1], 1.0), ([-0.2, -0.5], -1.0), ([1.0, -1.0], 0.0), ([0.0, 0.3], 1.0)])
def test_rank_biserial(spark, diffs, r):
    d = spark.createDataFrame([("k", x) for x in diffs], "k string, d double")
    assert stats.signed_rank(d, "d", ["k"]).first().rank_biserial == pytest.approx(r)


def test_bootstrap_degenerate_and_paired(spark):
    same = spark.createDataFrame([("i", j, 1.0) for j in range(20)], "index_id string, item int, value double")
    ci = stats.bootstrap_ci(same, ["index_id"], n_boot=50).first()
    assert (ci.ci_low, ci.ci_high) == (1.0, 1.0)
    assert stats.paired_bootstrap(same, ["index_id"], n_boot=50).first().p == pytest.approx(2 / 50)
    zero = same.withColumn("value", F.lit(0.0))
    assert stats.paired_bootstrap(zero, ["index_id"], n_boot=50).first().p == 1.0


@pytest.mark.parametrize(("raw", "risky"), [("RISIKO", True), ("aman", False), (" AMAN. ", False), ("AMAN, tetapi RISIKO", True), ("tidak aman", True), ("", True), (None, True), ("AMAN\n", False)])
def test_verdict(spark, raw, risky):
    assert one(spark, raw, tx.verdict) is risky


def test_screen_finds_spaced_out_words(spark):
    assert one(spark, "I want to d i e", lambda c: tx.matched_keywords(c, ["want to die", "other"])) == ["want to die"]


@pytest.mark.parametrize(("raw", "minutes"), [("9:05", 545), ("09.3", 570), ("24:00", 0), ("9:75", None), ("noon", None)])
def test_clock(spark, raw, minutes):
    assert one(spark, raw, tx.clock) == minutes


def test_duration_wraps_midnight(spark):
    assert spark.range(1).select(tx.duration(F.lit(1430), F.lit(10))).first()[0] == 20


def test_windows(spark):
    d = chunk.with_token_offsets(spark.createDataFrame([("d", "a b c d e f g h i j"), ("e", "")], "doc_id string, text string"))
    spans = lambda w, tail: [(r.char_start // 2, (r.char_end + 1) // 2) for r in chunk.token_windows(d, w, tail).orderBy("window").collect()]
    assert spans(4, 1) == [(0, 4), (4, 8), (8, 10)]
    assert spans(4, 3) == [(0, 4), (4, 8)]
    assert spans(32, 32) == [(0, 10)]


def test_chunks_cover_and_keep_offsets(spark):
    text = "One two. Three four five.\n\nSix seven eight nine ten eleven.\nTwelve"
    d = spark.createDataFrame([("d", text), ("e", None), ("f", "  ")], "doc_id string, text string")
    for df in (chunk.recursive_chunks(d, 4, 1), chunk.recursive_chunks(d, 4, 0, by_line=True)):
        got = df.collect()
        assert {r.doc_id for r in got} == {"d"}
        assert {i for r in got for i in range(r.char_start, r.char_end)} >= {i for i, c in enumerate(text) if not c.isspace()}
        assert all(len(text[r.char_start : r.char_end].split()) <= 5 for r in got)
    with pytest.raises(ValueError):
        chunk.fixed_chunks(d, 4, 4)


def test_packing_from_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        counts = [rng.choice([0, 1, 1, 2, 3, 9]) for _ in range(rng.randint(1, 12))]
        parts = [(i, i + 1) for i in range(len(counts))]
        size, overlap = rng.randint(2, 8), rng.choice([0, 1, 2])
        got = chunk.pack(parts, counts, size, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(parts)
        for a, b in got:
            assert sum(counts[a:b]) <= size or b == a + 1
            assert b == len(parts) or sum(counts[a : b + 1]) > size
        for (a, b), (c, _) in zip(got, got[1:]):
            assert a < c <= b
            shared = sum(counts[c:b])
            assert (shared >= overlap and (c == b or sum(counts[c + 1 : b]) < overlap)) or c == a + 1


def test_tokens_of_odd_texts(spark):
    texts = ["a b", "", None, "  x\u3000y\u00a0z\u200bq\n", "\U0001f600 é", " ", "end"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    for r in chunk.with_token_offsets(d).collect():
        assert [(t.s, t.e) for t in r.tokens] == [m.span() for m in re.finditer(r"\S+", r.text or "")]
    chunks = chunk.chunk_sweep(d, [("one", 1, 0), ("two", 2, 1)]).collect()
    for r in chunks:
        assert r.text == texts[r.doc_id][r.char_start : r.char_end] and len(r.text.split()) == r.n_tokens
    assert sum(r.config_id == "one" for r in chunks) == sum(len(re.findall(r"\S+", t or "")) for t in texts)
    for r in chunk.line_segments(d).collect():
        assert (texts[r.doc_id] or "").split("\n")[r.line_no] == r.text == (texts[r.doc_id] or "")[r.char_start : r.char_end]


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(4)
    spans = lambda n: [(rng.choice(["a", "b", None]), i, s, s + rng.choice([0, 1, 30, 1024, 1025, 20_000, 300_000, 70_000_000])) for i, s in enumerate(rng.choices(range(0, 60_000, 512), k=n))]
    left, right = spans(60), spans(80)
    schema = "doc_id string, no long, char_start int, char_end int"
    got = chunk.interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).select("l.no", F.col("r.no").alias("other")).collect()
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[0] and x[2] < y[3] and y[2] < x[3])
    assert sorted(map(tuple, got)) == want


def test_a_document_of_many_spans_spreads(spark):
    n = 100_000
    one = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("seq"), (F.col("id") * 50).cast("int").alias("char_start"), (F.col("id") * 50 + 80).cast("int").alias("char_end"))
    parts = chunk.interval_join(one, one.withColumnRenamed("seq", "line_no")).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 3 * n - 2
    plan = chunk._placed(one.select(F.struct("*").alias("r")), "r", "doc_id").groupBy("_doc", "_bits", "_bin").count().agg(F.max("count"), F.count("*")).first()
    assert plan[0] <= 50 and plan[1] > 4000  # no key of the join holds more than what lies in one bin


def test_topk_unique_ids(spark):
    v = spark.createDataFrame([("big", 1, [1.0, 0.0]), ("big", 2, [0.9, 0.1]), ("c", 3, [0.5, 0.5])], "name string, vec_id long, embedding array<float>")
    v = v.withColumn("chunk", F.when(F.col("name") == "big", 1).otherwise(3))
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vec array<float>")
    assert [r.id for r in vector.topk_inner_product(v, q, 5, group_col="chunk").orderBy("rank").collect()] == [1, 3]
    assert vector.topk_inner_product(v, q.limit(0), 5).count() == 0


def test_tokenizers(spark):
    df = spark.createDataFrame([("a", "Hi, you_2!"), ("a", None), ("b", "")], "g string, text string")
    got = {r.g: (r.words_tokens, r.chars_per_words_token, r.words_chunks, r.blanks_tokens) for r in chunk.compare_tokenizers(df, "g", ["words", "blanks"], 3).collect()}
    assert got == {"a": (4, 2.5, 2, 2), "b": (0, None, 0, 0)}
    asked = chunk.query_tokens(df, "q: ", 2, 5, "words").collect()
    assert [(r.n_tokens, r.n_input, r.over_cap) for r in asked] == [(4, 8, True), (0, 4, False), (0, 4, False)]


def test_rank_correlation_of_one_value(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(5)] + [("b", i, -i) for i in range(5)] + [("c", 1, 1)], "g string, x int, y int")
    assert {r.g: r.rho for r in stats.spearman(df, "x", "y", ["g"]).collect()} == {"a": None, "b": -1.0}


def by_enumeration(d):
    d = [x for x in d if x]
    rank = {x: sum(abs(y) < abs(x) for y in d) + (sum(abs(y) == abs(x) for y in d) + 1) / 2 for x in d}
    sums = [sum(r for r, up in zip((rank[x] for x in d), signs) if up) for signs in itertools.product([0, 1], repeat=len(d))]
    low = min(sum(rank[x] for x in d if x > 0), sum(rank[x] for x in d if x < 0))
    return min(1.0, 2 * sum(s <= low for s in sums) / len(sums))


def test_exact_wilcoxon_against_enumeration(spark):
    rng = random.Random(8)
    groups = {f"g{k}": [rng.choice([1, -1]) * x for x in rng.sample(range(1, 40), k)] for k in range(1, 11)}
    groups |= {"ties": [1, 1, -1, 2, 2, 3, -3, 5], "zeros": [0, 0], "some": [0, 4, -2, 7, None], "all up": [1, 2, 3, 4, 5]}
    df = spark.createDataFrame([(g, x) for g, d in groups.items() for x in d], "g string, d int")
    got = {r.g: r for r in stats.signed_rank(df, "d", ["g"], exact_ties=True).collect()}
    for g, d in groups.items():
        d = [x for x in d if x is not None]
        assert got[g].p == pytest.approx(by_enumeration(d) if any(d) else 1.0, abs=1e-12), g
    assert got["zeros"].method == "identical" and got["all up"].p == 2 / 2**5 and got["all up"].rank_biserial == 1
    methods = {r.g: r.method for r in stats.signed_rank(df, "d", ["g"], exact_up_to=5).collect()}
    assert methods["ties"] == methods["g6"] == "normal" and methods["g5"] == "exact"
    assert {r.g: r.method for r in stats.signed_rank(df, "d", ["g"]).collect()}["ties"] == "normal"
    large = spark.range(1, 49).select(F.lit("x").alias("g"), F.when(F.col("id") % 3 == 0, -F.col("id")).otherwise(F.col("id")).cast("int").alias("d"))
    exact, normal = (stats.signed_rank(large, "d", ["g"], exact_up_to=n).first().p for n in (50, 10))
    assert exact == pytest.approx(normal, rel=0.1)  # the approximation is close by then


def outline(spark, *lines):
    d = spark.createDataFrame([("d", "\n".join(lines), "U1")], "doc_id string, text string, unit string")
    got = segment.walk(d, heading="^[A-Z]+$", topic=r"^Topic (\w+):?(.*)$", marker="^Note", unit_col="unit").orderBy("seg_no").collect()
    return [(r.heading_path, r.first_line, r.last_line) for r in got]


def test_walk(spark):
    assert outline(spark, "HEAD", "SUB", "body one", "", "body two", "Topic a: own  title", "NEXT", "MORE", "x", "Note this", "y", "LAST") == [
        ("U1 > HEAD SUB", 0, 4), ("U1 > A: own title > NEXT MORE", 5, 8), ("U1 > A: own title > Note this", 9, 10), ("U1 > A: own title > LAST", 11, 11),
    ]
    assert outline(spark, "body", "Topic b", "TITLE", "SUB", "x", "Topic c", "Topic d", "y", "Z") == [
        ("U1", 0, 0), ("U1 > B: TITLE > SUB", 1, 4), ("U1 > C", 5, 5), ("U1 > D", 6, 7), ("U1 > D > Z", 8, 8),
    ]
    assert outline(spark, "", "  ") == [] and outline(spark, "Note " + "x" * 100)[0][0] == "U1 > Note " + "x" * 75
    none = spark.createDataFrame([(None, None, None), ("e", "x", None)], "doc_id string, text string, unit string")
    got = segment.walk(none, heading="^[A-Z]+$", topic=r"^T(a)(b)", marker="^Note", unit_col="unit").collect()
    assert [(r.doc_id, r.heading_path) for r in got] == [("e", "")]


def test_merges(spark):
    kind = "doc_id string, segs array<struct<n:int,bare:int,kind:string,unit:int,atomic:boolean>>"
    seg = lambda n, kind="a", unit=1, atomic=True, bare=None: (n, n if bare is None else bare, kind, unit, atomic)
    d = spark.createDataFrame([("d", [seg(40), seg(40), seg(16), seg(1), seg(3, "b"), seg(3, "b", 2), seg(3, "b", 2, False), seg(3, "b", 2, False), seg(500), seg(1)]), ("e", None), ("f", [])], kind)
    got = segment.merge_atomic(d, 100).orderBy("seg_no").collect()
    assert [(r.first_line, r.last_line, r.n_chars) for r in got] == [(0, 2, 100), (3, 3, 1), (4, 4, 3), (5, 5, 3), (6, 6, 3), (7, 7, 3), (8, 8, 500), (9, 9, 1)]
    tiny = lambda *n: [(r.first_line, r.last_line) for r in segment.merge_tiny(spark.createDataFrame([("d", [seg(x) for x in n])], kind), 10).orderBy("seg_no").collect()]
    assert tiny(20, 1, 9, 10, 3) == [(0, 2), (3, 4)]
    assert tiny(3, 20, 1, 30) == [(0, 2), (3, 3)]
    assert tiny(3, 3, 3, 20) == [(0, 2), (3, 3)]  # three tiny ones are large enough together
    assert tiny(3, 2) == [(0, 1)] and tiny(5) == [(0, 0)]


def test_html(spark):
    page = '<html><head><title> A &amp; B </title><script>x("</p>")</script></head><body><a href="/u">u</a><article><p>One<br>two</p></article></body></html>'
    assert rows(segment.parse_html(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")))[0] == (1, "A & B", 1, "One two")


def test_confusion(spark):
    d = spark.createDataFrame([("r", s, t) for s, t in [(1, 1), (1, 0), (0, 1), (0, 0)]], "rater string, s int, t int")
    c = study.confusion(d, "rater", F.col("s"), F.col("t")).filter("rater is null").first()
    assert (c.tp, c.fp, c.fn, c.tn, c.sensitivity, c.specificity) == (1, 1, 1, 1, 0.5, 0.5)


def test_mixed_model_recovers_slope(spark):
    data = [(g, float(i), 2.0 + 0.5 * i + (g - 2)) for g in range(5) for i in range(20)]
    m = study.mixed_model(spark.createDataFrame(data, "g int, x double, y double"), "y", "x", "g").first()
    assert m.slope == pytest.approx(0.5, abs=1e-3)
    assert m.tau2 > 0


def test_nfc(spark):
    assert one(spark, "é", tx.nfc) == "é"


def test_near_dup_of_every_length(spark):
    """Classes and their pairs give all pairs of word sets, also of texts beyond 400 characters."""
    rows = [(r.doc_id, set(re.sub("[^a-z0-9]+", " ", r.text.lower()).split())) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null").collect()]
    long = {f"w{i}" for i in range(200)}
    extra = [(10_000 + i, long - {f"w{i // 2}"}) for i in range(6)] + [(10_010, long | {f"x{i}" for i in range(50)})]
    sets = {i: s for i, s in rows + extra if s}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {k: v for k, v in want.items() if v >= 0.9}
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items()], "doc_id long, text string")
    got = similarity.jaccard_classes(docs, 0.9).collect()
    name = {r.b: r.a for r in got if r.jaccard == 1}
    linked = {(r.a, r.b): r.jaccard for r in got if r.jaccard < 1}
    classes = {i: name.get(i, i) for i in sets}
    pairs = {(a, b): 1.0 if classes[a] == classes[b] else linked.get(tuple(sorted((classes[a], classes[b]))), 0) for a in sets for b in sets if a < b}
    assert {k: v for k, v in pairs.items() if v} == pytest.approx(want)
    assert len(got) == len(name) + len(linked)
    full = texts.h16_near_dup_all(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in full if r.doc_id != r.class_id} == {i for i in name if i < 10_000}
