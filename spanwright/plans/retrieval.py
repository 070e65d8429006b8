"""Queries over vectors: top-k, relevance, metrics, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.operators import metrics, stats, vector
from spanwright.session import materialised

KS = (1, 3, 5, 10)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _queries(emb: DataFrame, every: int = 50) -> DataFrame:
    return emb.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def g8_topk_ip(spark, sf):
    emb = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    return vector.topk_inner_product(emb, _queries(emb), 10).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


_PAIRS = """
q AS (SELECT vec_id AS query_id, label AS qlabel, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (SELECT q.query_id, q.qlabel, e.vec_id, e.label, list_inner_product(q.qe::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM q, embeddings e{where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"""
G8 = f"WITH {_PAIRS.format(where='')} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 10"


def g9_topk_multivector(spark, sf):
    emb = _t(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 2).alias("chunk_id"))
    return vector.topk_inner_product(emb, _queries(emb), 5, group_col="chunk_id").select("query_id", "rank", F.col("id").alias("chunk_id"))


G9 = """WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
best AS (SELECT query_id, vec_id // 2 AS chunk_id, max(list_inner_product(qe::DOUBLE[], embedding::DOUBLE[])) AS score FROM q, embeddings GROUP BY ALL)
SELECT query_id, rank, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best) WHERE rank <= 5"""


def g4_l2_normalise(spark, sf):
    emb = _t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3.0).alias("v"))
    unit = emb.select("vec_id", vector.l2_normalise(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(vector.dot(F.col("u"), F.col("u")), 9).alias("norm2"), F.round(F.col("u")[0], 6).alias("first"))


G4 = """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3.0::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM v)
SELECT vec_id, round(list_inner_product(u, u), 9) AS norm2, round(u[1], 6) AS first FROM u"""


def g3_mean_pool(spark, sf):
    pooled = vector.mean_pool(_t(spark, sf, "embeddings").select("label", "embedding"), "label", "embedding")
    return pooled.select("label", F.col("at").alias("component"), F.round("value", 6).alias("value"))


G3 = """SELECT label, i - 1 AS component, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i"""


def _ranked(spark, sf, k: int = 10) -> DataFrame:
    """Ranked results of every query with gains: a vector is relevant if it has the query's label."""
    emb = _t(spark, sf, "embeddings")
    top = vector.topk_inner_product(emb.select("vec_id", "embedding"), _queries(emb), k, skip_self=True)
    labels = emb.select("vec_id", "label")
    totals = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    asked = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel"))
    out = top.join(labels.select(F.col("vec_id").alias("id"), "label"), "id").join(asked, "query_id").join(totals.withColumnRenamed("label", "qlabel"), "qlabel")
    return out.select("query_id", "qlabel", "rank", "id", "label", (F.col("label") == F.col("qlabel")).cast("int").alias("gain"), "n_relevant")


def _scores(spark, sf) -> DataFrame:
    return metrics.per_query(_ranked(spark, sf), ["query_id", "qlabel"], KS)


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places: sums come in another order from another engine."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def i7_metrics_per_query(spark, sf):
    return _rounded(_scores(spark, sf))


_GAINS = _PAIRS.format(where=" WHERE e.vec_id <> q.query_id") + """,
g AS (SELECT r.query_id, r.qlabel, r.rank, r.vec_id, r.label, (r.label = r.qlabel)::INT AS gain, n.n AS n_relevant FROM ranked r JOIN (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label) n ON n.label = r.qlabel WHERE r.rank <= 10)"""
_METRICS = ", ".join(
    f"max(CASE WHEN rank <= {k} THEN gain ELSE 0 END)::DOUBLE AS recall_at_{k}, sum(CASE WHEN rank <= {k} THEN gain ELSE 0 END) / {k}.0::DOUBLE AS precision_at_{k}, "
    f"coalesce(1.0::DOUBLE / min(CASE WHEN gain = 1 AND rank <= {k} THEN rank END), 0.0) AS mrr_at_{k}, "
    f"CASE WHEN max(n_relevant) > 0 THEN sum(CASE WHEN rank <= {k} THEN gain ELSE 0 END / log2(rank + 1.0::DOUBLE)) / list_sum(list_transform(range(1, least({k}, max(n_relevant)) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) ELSE 0.0 END AS ndcg_at_{k}"
    for k in KS
)
_SCORED = f"{_GAINS}, s AS (SELECT query_id, qlabel, {_METRICS} FROM g GROUP BY query_id, qlabel)"
_NAMES = [f"{m}_at_{k}" for k in KS for m in ("recall", "precision", "mrr", "ndcg")]
_MEANS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in _NAMES)
I7 = f"WITH {_SCORED} SELECT query_id, qlabel, {', '.join(f'round({m}, 9) AS {m}' for m in _NAMES)} FROM s"


def i8_metrics_by_label(spark, sf):
    return _rounded(_scores(spark, sf).groupBy("qlabel").agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(m).alias(m) for m in _NAMES]))


I8 = f"WITH {_SCORED} SELECT qlabel, count(*) AS n_queries, {_MEANS} FROM s GROUP BY qlabel"


def i9_metrics_grouping_sets(spark, sf):
    s = _scores(spark, sf).withColumn("half", F.when(F.col("query_id") % 100 == 0, "even").otherwise("odd"))
    return _rounded(metrics.grouped_means(s, [[], ["qlabel"], ["half"]], _NAMES))


I9 = f"WITH {_SCORED}, h AS (SELECT *, CASE WHEN query_id % 100 = 0 THEN 'even' ELSE 'odd' END AS half FROM s) SELECT qlabel, half, count(*) AS n_queries, {_MEANS} FROM h GROUP BY GROUPING SETS ((), (qlabel), (half))"


def i6_multihop_coverage(spark, sf):
    r = _ranked(spark, sf)
    need = r.select("query_id", "qlabel").distinct().select("query_id", F.explode(F.array(F.col("qlabel"), (F.col("qlabel") + 1) % 10)).alias("passage"))
    labels = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("passage"))
    return metrics.multihop_coverage(r, need.join(labels, "passage"), ["query_id"], 10)


I6 = f"""WITH {_GAINS}, need AS (SELECT DISTINCT query_id, unnest([qlabel, (qlabel + 1) % 10]) AS passage FROM g),
met AS (SELECT n.query_id, n.passage, max(CASE WHEN g.label = n.passage THEN 1 ELSE 0 END) AS met FROM need n JOIN g USING (query_id) GROUP BY ALL)
SELECT query_id, min(met) AS coverage, count(*) AS n_passages FROM met GROUP BY query_id"""


def g16_predicate_hit_at_k(spark, sf):
    hit = F.col("label").isin(1, 2, 3)
    per = _ranked(spark, sf).groupBy("query_id", "qlabel").agg(*[F.max(F.when((F.col("rank") <= k) & hit, 1).otherwise(0)).alias(f"hit_at_{k}") for k in (5, 10)])
    return per.groupBy("qlabel").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"hit_at_{k}").alias(f"hit_at_{k}") for k in (5, 10)])


G16 = f"""WITH {_GAINS}, per AS (SELECT query_id, qlabel, max((rank <= 5 AND label IN (1, 2, 3))::INT) AS h5, max((rank <= 10 AND label IN (1, 2, 3))::INT) AS h10 FROM g GROUP BY ALL)
SELECT qlabel, count(*) AS n, avg(h5) AS hit_at_5, avg(h10) AS hit_at_10 FROM per GROUP BY qlabel"""


def g17_composition(spark, sf):
    c = _ranked(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return c.select("label", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


G17 = f"WITH {_GAINS} SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM g GROUP BY label"


def i11_rank_indexes(spark, sf):
    """Four rankings of the same results (cut-offs as indexes), ordered by mean nDCG, ties by name."""
    long = _scores(spark, sf).select("query_id", F.expr("stack(4, 'top-1', ndcg_at_1, 'top-3', ndcg_at_3, 'top-5', ndcg_at_5, 'top-10', ndcg_at_10) as (index_id, v)"))
    means = long.groupBy("index_id").agg(F.round(F.avg("v"), 9).alias("score"), F.count(F.lit(1)).alias("n"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "index_id")))


I11 = f"""WITH {_SCORED}, l AS (SELECT 'top-1' AS index_id, ndcg_at_1 AS v FROM s UNION ALL SELECT 'top-3', ndcg_at_3 FROM s UNION ALL SELECT 'top-5', ndcg_at_5 FROM s UNION ALL SELECT 'top-10', ndcg_at_10 FROM s),
m AS (SELECT index_id, round(avg(v), 9) AS score, count(*) AS n FROM l GROUP BY index_id) SELECT *, row_number() OVER (ORDER BY score DESC, index_id) AS place FROM m"""


def _intervals(scores: DataFrame) -> DataFrame:
    each = scores.select(F.col("qlabel").alias("index_id"), F.col("query_id").alias("item"), F.col("ndcg_at_5").alias("value"))
    return stats.bootstrap_ci(each, ["index_id"], n_boot=10_000, seed=20260628)


def k1_bootstrap_ci(spark, sf):
    return _intervals(_scores(spark, sf))


_BOOT = """n AS (SELECT index_id, count(*) AS n FROM v GROUP BY index_id), i AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY item) - 1 AS j FROM v),
draws AS (SELECT n.index_id, b, j, ('0x' || substr(md5('20260628/' || b || '/' || j), 1, 8))::BIGINT % n.n AS pick FROM n, range(10000) t(b), range(n.n) u(j)),
means AS (SELECT d.index_id, d.b, avg(i.value) AS m FROM draws d JOIN i ON i.index_id = d.index_id AND i.j = d.pick GROUP BY ALL)"""
K1 = f"""WITH {_SCORED}, v AS (SELECT qlabel AS index_id, query_id AS item, ndcg_at_5 AS value FROM s), {_BOOT}
SELECT m.index_id, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high, count(*) AS n_boot FROM means m GROUP BY index_id"""


def k2_paired_bootstrap(spark, sf):
    d = _scores(spark, sf).select(F.lit("ndcg5-mrr5").alias("index_id"), F.col("query_id").alias("item"), (F.col("ndcg_at_5") - F.col("mrr_at_5")).alias("value"))
    return stats.paired_bootstrap(materialised(d, "differences"), ["index_id"], n_boot=10_000, seed=20260628)  # read twice


K2 = f"""WITH {_SCORED}, v AS (SELECT 'ndcg5-mrr5' AS index_id, query_id AS item, ndcg_at_5 - mrr_at_5 AS value FROM s), {_BOOT},
o AS (SELECT index_id, avg(value) AS diff FROM v GROUP BY index_id)
SELECT o.index_id, round(max(o.diff), 9) AS diff, round(quantile_cont(m.m, 0.025), 9) AS ci_low, round(quantile_cont(m.m, 0.975), 9) AS ci_high,
       least(1.0::DOUBLE, 2 * greatest(avg(CASE WHEN o.diff > 0 THEN (m.m <= 0)::INT ELSE (m.m >= 0)::INT END), 1 / 10000.0::DOUBLE)) AS p
FROM means m JOIN o USING (index_id) GROUP BY o.index_id"""


def k20_selection(spark, sf):
    """The best index and those whose interval reaches its lower bound."""
    scores = materialised(_scores(spark, sf), "scores")  # read twice
    ci = _intervals(scores)
    means = scores.groupBy(F.col("qlabel").alias("index_id")).agg(F.round(F.avg("ndcg_at_5"), 9).alias("score"), F.min("recall_at_5").alias("floor_recall"))
    return stats.select_winner(means.join(ci, "index_id"))


K20 = f"""WITH {_SCORED}, v AS (SELECT qlabel AS index_id, query_id AS item, ndcg_at_5 AS value FROM s), {_BOOT},
ci AS (SELECT index_id, round(quantile_cont(m, 0.025), 9) AS ci_low, round(quantile_cont(m, 0.975), 9) AS ci_high FROM means GROUP BY index_id),
a AS (SELECT qlabel AS index_id, round(avg(ndcg_at_5), 9) AS score, min(recall_at_5) AS floor_recall FROM s GROUP BY qlabel),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, index_id) AS place FROM a JOIN ci USING (index_id))
SELECT r.index_id, r.score, r.floor_recall, r.ci_low, r.ci_high, r.place, r.ci_high >= w.ci_low AS tied FROM r, (SELECT ci_low FROM r WHERE place = 1) w"""


def k19_rank_sensitivity(spark, sf):
    """Labels ranked by two metrics: rank correlation, winner and mean shift."""
    m = _scores(spark, sf).groupBy("qlabel").agg(F.round(F.avg("ndcg_at_5"), 9).alias("a"), F.round(F.avg("precision_at_10"), 9).alias("b"))
    return stats.rank_sensitivity(m, "qlabel", "a", "b")


K19 = f"""WITH {_SCORED}, m AS (SELECT qlabel, round(avg(ndcg_at_5), 9) AS a, round(avg(precision_at_10), 9) AS b FROM s GROUP BY qlabel),
r AS (SELECT *, row_number() OVER (ORDER BY a DESC, qlabel) AS ra, row_number() OVER (ORDER BY b DESC, qlabel) AS rb FROM m)
SELECT count(*) AS n, 1 - 6 * sum((ra - rb) * (ra - rb))::DOUBLE / (count(*) * (count(*) * count(*) - 1)) AS rho, bool_or(ra = 1 AND rb = 1) AS winner_stable, count(*) FILTER (WHERE ra <= 3 AND rb <= 3) = 3 AS top3_same, round(avg(abs(a - b)), 9) AS mean_shift FROM r"""

QUERIES = {f.__name__: f for f in (
    g8_topk_ip,
    g9_topk_multivector,
    g4_l2_normalise,
    g3_mean_pool,
    i7_metrics_per_query,
    i8_metrics_by_label,
    i9_metrics_grouping_sets,
    i6_multihop_coverage,
    g16_predicate_hit_at_k,
    g17_composition,
    i11_rank_indexes,
    k1_bootstrap_ci,
    k2_paired_bootstrap,
    k20_selection,
    k19_rank_sensitivity
)}
ORACLES = {
    "g8_topk_ip": G8,
    "g9_topk_multivector": G9,
    "g4_l2_normalise": G4,
    "g3_mean_pool": G3,
    "i7_metrics_per_query": I7,
    "i8_metrics_by_label": I8,
    "i9_metrics_grouping_sets": I9,
    "i6_multihop_coverage": I6,
    "g16_predicate_hit_at_k": G16,
    "g17_composition": G17,
    "i11_rank_indexes": I11,
    "k1_bootstrap_ci": K1,
    "k2_paired_bootstrap": K2,
    "k20_selection": K20,
    "k19_rank_sensitivity": K19
}
