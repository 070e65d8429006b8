"""Queries over ratings-like tables: joins, pivots, agreement, tests, draws, validation, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.operators import stats, study
from spanwright.plans.retrieval import _t
from spanwright.streaming import replay

Q, O = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


_DRAW = "('0x' || substr(md5('{seed}/' || {key}), 1, 8))::BIGINT"


@query("SELECT DISTINCT l.l_partkey % 2500 AS ref FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey % 2500)")
def h2_unknown_refs(spark, sf):
    """References without a target (anti join)."""
    refs = _t(spark, sf, "lineitem").select((F.col("l_partkey") % 2500).alias("ref")).distinct()
    return refs.join(_t(spark, sf, "part").select(F.col("p_partkey").alias("ref")), "ref", "left_anti")


@query("""WITH n AS (SELECT CASE WHEN item_id % 7 = 3 THEN item_id + 1000 ELSE item_id END AS item_id, CASE WHEN item_id % 5 = 1 THEN text || '!' ELSE text END AS text FROM benchmark WHERE item_id % 11 <> 2)
SELECT coalesce(b.item_id, n.item_id) AS item_id, CASE WHEN b.item_id IS NULL THEN 'added' WHEN n.item_id IS NULL THEN 'dropped' WHEN b.text = n.text THEN 'unchanged' ELSE 'edited' END AS status FROM benchmark b FULL JOIN n ON b.item_id = n.item_id""")
def h15_gold_diff(spark, sf):
    b = _t(spark, sf, "benchmark")
    i = F.col("item_id")
    n = b.filter(i % 11 != 2).select(F.when(i % 7 == 3, i + 1000).otherwise(i).alias("item_id"), F.when(i % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return study.diff_tables(b, n, "item_id", ["text"])


@query("""SELECT o_orderkey AS key, 'orders' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'lineitem' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def h18_set_equality(spark, sf):
    o, li = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("key")), _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    return o.join(li, "key", "left_anti").withColumn("side", F.lit("orders")).unionByName(li.join(o, "key", "left_anti").withColumn("side", F.lit("lineitem")))


@query(r"""WITH c AS (SELECT item_id, text, list_sort(list_distinct(list_filter([0, instr(text, '. ')::BIGINT - 1, instr(text, ', ')::BIGINT - 1, length(text)], lambda x: x >= 0))) AS cuts FROM benchmark),
p AS (SELECT item_id, text, unnest(range(1, len(cuts))) AS n, cuts FROM c), x AS (SELECT item_id, n, cuts[n] AS s, substr(text, (cuts[n] + 1)::BIGINT, (cuts[n + 1] - cuts[n])::BIGINT) AS part, cuts[n + 1] AS e FROM p)
SELECT item_id, chr((96 + n)::INT) AS part, s + length(regexp_extract(part, '^\s*')) AS char_start, e - length(regexp_extract(part, '\s*$')) AS char_end FROM x WHERE e - length(regexp_extract(part, '\s*$')) > s + length(regexp_extract(part, '^\s*'))""")
def n1_gold_split(spark, sf):
    return study.anchored_spans(_t(spark, sf, "benchmark"), "item_id", "text", [". ", ", "])


@query("""WITH q AS (SELECT item_id, text, CASE item_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'odd' END AS difficulty FROM benchmark)
SELECT item_id, unnest(list_filter([CASE WHEN difficulty NOT IN ('easy', 'medium', 'hard') THEN 'unknown difficulty' END, CASE WHEN length(text) < 120 THEN 'short question' END, CASE WHEN NOT regexp_matches(text, '[.?]$') THEN 'no end mark' END], lambda x: x IS NOT NULL)) AS problem FROM q""")
def n3_validate(spark, sf):
    d = F.when(F.col("item_id") % 4 == 0, "easy").when(F.col("item_id") % 4 == 1, "medium").when(F.col("item_id") % 4 == 2, "hard").otherwise("odd")
    checks = [(~d.isin("easy", "medium", "hard"), "unknown difficulty"), (F.length("text") < 120, "short question"), (~F.col("text").rlike("[.?]$"), "no end mark")]
    return study.problems(_t(spark, sf, "benchmark"), "item_id", checks)


@query("""SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, quantile_cont(n_chars::DOUBLE, 0.5) AS median, list_sort(list(n_chars))[count(n_chars) // 2 + 1] AS upper_median, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang""")
def j4_describe(spark, sf):
    d = study.describe(_t(spark, sf, "documents"), ["lang"], "n_chars")
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


@query("""SELECT coalesce(toxic::VARCHAR, 'blank') AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def j5_distribution(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy(F.coalesce(F.col("toxic").cast("string"), F.lit("blank")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


_PAIR = """w AS (SELECT o_custkey AS "case", avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders GROUP BY o_custkey), p AS (SELECT *, a - b AS d FROM w WHERE a IS NOT NULL AND b IS NOT NULL)"""


def _pairs(spark, sf):
    return study.pivot_pairs(_t(spark, sf, "orders").withColumnRenamed("o_custkey", "case"), "case", "o_orderstatus", "o_totalprice", "F", "O")


@query(f'WITH {_PAIR} SELECT "case", round(a, 6) AS a, round(b, 6) AS b, round(d, 6) AS d FROM p')
def j7_pivot_pairs(spark, sf):
    return _pairs(spark, sf).select("case", *[F.round(c, 6).alias(c) for c in "abd"])


@query(f"WITH {_PAIR} SELECT count(*) AS n_pairs, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down, count(*) FILTER (WHERE d = 0) AS tie FROM p")
def j19_sign_tally(spark, sf):
    return study.sign_tally(_pairs(spark, sf), "d")


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(m) AS n, round(avg(m), 6) AS mean, round(avg(m) - 1.96 * stddev_samp(m) / sqrt(count(m)), 6) AS ci_low, round(avg(m) + 1.96 * stddev_samp(m) / sqrt(count(m)), 6) AS ci_high FROM c GROUP BY l_returnflag""")
def j8_strata_ci(spark, sf):
    s = study.strata_ci(_t(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity")
    return s.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query("""WITH x AS (SELECT lang, (n_chars > 1500)::INT AS s, quality AS t FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) FILTER (WHERE s = 1 AND t = 1) AS tp, count(*) FILTER (WHERE s = 1 AND t = 0) AS fp, count(*) FILTER (WHERE s = 0 AND t = 1) AS fn, count(*) FILTER (WHERE s = 0 AND t = 0) AS tn FROM x GROUP BY ROLLUP (lang))
SELECT *, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS agreement, tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity FROM c""")
def j10_confusion(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).cast("int").alias("s")).join(_t(spark, sf, "labels"), "doc_id")
    return study.confusion(d, "lang", F.col("s"), F.col("quality"))


@query("""SELECT o_orderpriority, o_orderstatus, count(DISTINCT o_custkey % 5) AS n_conditions, count(DISTINCT o_custkey % 5) <= 1 AS aliased FROM orders GROUP BY ALL""")
def j13_aliasing(spark, sf):
    c = _t(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.countDistinct(F.col("o_custkey") % 5).alias("n_conditions"))
    return c.withColumn("aliased", F.col("n_conditions") <= 1)


@query("""WITH v AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 50) AS yes FROM events GROUP BY user_id) SELECT *, yes * 2 > n AS majority, yes > 0 AND yes < n AS unstable FROM v""")
def j14_majority(spark, sf):
    return study.majority(_t(spark, sf, "events"), "user_id", F.col("value") > 50)


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS n_large FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def j16_crosstab(spark, sf):
    return _t(spark, sf, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_totalprice") > 150000, 1).otherwise(0)).alias("n_large"))


@query("""WITH u AS (SELECT lang, 'quality' AS dim, quality AS v FROM documents JOIN labels USING (doc_id) UNION ALL SELECT lang, 'toxic', toxic FROM documents JOIN labels USING (doc_id)), m AS (SELECT dim, avg(v) FILTER (WHERE lang = 'en') AS a, avg(v) FILTER (WHERE lang <> 'en') AS b FROM u GROUP BY dim) SELECT *, abs(a - b) AS gap FROM m""")
def j18_rater_gap(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "lang").join(_t(spark, sf, "labels"), "doc_id").unpivot(["lang"], ["quality", "toxic"], "dim", "v")
    m = d.groupBy("dim").agg(F.avg(F.when(F.col("lang") == "en", F.col("v"))).alias("a"), F.avg(F.when(F.col("lang") != "en", F.col("v"))).alias("b"))
    return m.withColumn("gap", F.abs(F.col("a") - F.col("b")))


@query("""WITH p AS (SELECT p_partkey, p_brand, (p_size % 20 + 1) / 1000.0::DOUBLE AS p FROM part), s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY p_brand) - row_number() OVER w + 1) * p) AS step FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY p, p_partkey))
SELECT p_partkey, p, max(step) OVER (PARTITION BY p_brand ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING) AS p_holm FROM s""")
def k3_holm(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", "p_brand", ((F.col("p_size") % 20 + 1) / F.lit(1000.0)).alias("p"))
    return stats.holm(p, "p", "p_partkey", ["p_brand"]).select("p_partkey", "p", "p_holm")


@query("SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS midrank FROM documents")
def k4_midrank(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return d.join(stats.midranks(d, "n_chars", ["lang"]), ["lang", "n_chars"]).select("doc_id", "midrank")


_SIGNED = """d AS (SELECT lang, (n_chars - 2000) % 500 AS d FROM documents WHERE (n_chars - 2000) % 500 <> 0), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY abs(d)) + (count(*) OVER (PARTITION BY lang, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d),
s AS (SELECT lang, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY lang)"""


def _signed(spark, sf):
    d = _t(spark, sf, "documents").select("lang", ((F.col("n_chars") - 2000) % 500).alias("d"))
    return stats.signed_rank(d, "d", ["lang"])


@query(f"WITH {_SIGNED} SELECT lang, n, (w_plus - w_minus) / (w_plus + w_minus) AS rank_biserial FROM s")
def k5_rank_biserial(spark, sf):
    return _signed(spark, sf).select("lang", "n", "rank_biserial")


@query(f"WITH {_SIGNED} SELECT lang, n, w_plus, w_minus FROM s")
def k6_wilcoxon_w(spark, sf):
    return _signed(spark, sf).select("lang", "n", "w_plus", "w_minus")


# the null distribution by n: a list of how many sign patterns give each rank sum; the error function by its series
def _wilcoxon(differences: str, keys: str) -> str:
    """CTEs that end in p (keys, n, method, p), from the CTEs ``differences`` with one named e (keys, d)."""
    same = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    own = lambda t: ", ".join(f"{t}.{k.strip()}" for k in keys.split(","))
    return f"""WITH RECURSIVE dist AS (SELECT 0 AS n, [1::DOUBLE] AS c UNION ALL
SELECT n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda w: coalesce(c[w + 1], 0) + CASE WHEN w > n THEN coalesce(c[w - n], 0) ELSE 0 END) FROM dist WHERE n < 50),
{differences},
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {keys}, abs(d)) AS t FROM e WHERE d <> 0 WINDOW w AS (PARTITION BY {keys} ORDER BY abs(d))),
s AS (SELECT {keys}, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, sum(t * t - 1) AS ties FROM r GROUP BY {keys}),
x AS (SELECT s.*, abs(w - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE) / sqrt(2::DOUBLE) AS x FROM s),
known AS (SELECT {own("x")}, x.n, CASE WHEN x.ties = 0 AND x.n <= 50 THEN 'exact' ELSE 'normal' END AS method, CASE WHEN x.ties = 0 AND x.n <= 50 THEN least(1, 2 * list_sum(dist.c[1:(w + 1)::BIGINT]) / 2::DOUBLE ** x.n) WHEN x = 0 THEN 1 WHEN x > 6 THEN 0
  ELSE greatest(0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda k: exp(-x * x + 2 * k * ln(2::DOUBLE) + (2 * k + 1) * ln(x) + lgamma(k + 1) - lgamma(2 * k + 2))))) END AS p FROM x LEFT JOIN dist ON dist.n = x.n),
p AS (SELECT {own("g")}, coalesce(known.n, 0) AS n, coalesce(known.method, 'identical') AS method, coalesce(known.p, 1) AS p FROM (SELECT DISTINCT {keys} FROM e) g LEFT JOIN known ON {same("g", "known")})"""


_WILCOXON = _wilcoxon(
    "e AS (SELECT lang, coalesce(source, '') || '/' || doc_id % 3 AS part, (n_chars - 2000) % 500 AS d FROM documents WHERE n_chars IS NOT NULL)",
    "lang, part"
) + " SELECT lang, part, n, method, round(p, 9) AS p FROM p"


@query(_WILCOXON)
def k6_wilcoxon_p(spark, sf):
    """Small groups without ties by the exact distribution, the others by the normal approximation."""
    part = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id") % 3)
    d = _t(spark, sf, "documents").select("lang", part.alias("part"), ((F.col("n_chars") - 2000) % 500).alias("d"))
    return stats.signed_rank(d, "d", ["lang", "part"]).select("lang", "part", "n", "method", F.round("p", 9).alias("p"))


@query("""WITH r AS (SELECT lang, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM documents WHERE lang IN ('en', 'de')), a AS (SELECT count(*) FILTER (WHERE lang = 'en') AS n1, count(*) FILTER (WHERE lang = 'de') AS n2, sum(r) FILTER (WHERE lang = 'en') AS s FROM r)
SELECT n1, n2, s - n1 * (n1 + 1) / 2.0::DOUBLE AS u, 2 * (s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n2) - 1 AS rank_biserial FROM a""")
def k8_mwu_u(spark, sf):
    return stats.mann_whitney(_t(spark, sf, "documents").select("lang", "n_chars"), "n_chars", "lang", "en", "de")


@query("""WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS y FROM lineitem)
SELECT g, count(*) AS n, round(corr(x, y), 9) AS rho FROM r GROUP BY g HAVING count(*) >= 4""")
def k9_spearman(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    return stats.spearman(li, "l_quantity", "l_extendedprice", ["g"])


@query("""WITH d AS (SELECT vec_id, i AS rater, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 6) t(i)), m AS (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS r, avg(x) OVER (PARTITION BY rater) AS c, avg(x) OVER () AS a FROM d),
s AS (SELECT count(DISTINCT vec_id) AS n, count(DISTINCT rater) AS k, sum((r - a) ** 2) AS rr, sum((c - a) ** 2) AS cc, sum((x - r - c + a) ** 2) AS ee FROM m), q AS (SELECT n, k, rr / (n - 1) AS msr, cc / (k - 1) AS msc, ee / ((n - 1) * (k - 1)) AS mse FROM s)
SELECT n, k, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 9) AS icc FROM q""")
def k10_icc21(spark, sf):
    e = _t(spark, sf, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 5)).alias("rater", "x"))
    return stats.icc21(e.withColumn("x", F.col("x").cast("double")), "vec_id", "rater", "x")


@query("""WITH x AS (SELECT (n_chars % 5)::INT AS a, ((n_chars + quality * 2) % 5)::INT AS b FROM documents JOIN labels USING (doc_id)), c AS (SELECT DISTINCT v FROM (SELECT a AS v FROM x UNION SELECT b FROM x)), p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM c), k AS (SELECT p.i, q.i AS j FROM x JOIN p ON x.a = p.v JOIN p q ON x.b = q.v),
n AS (SELECT sum((i - j) ** 2) AS seen, count(*) AS n FROM k), e AS (SELECT sum((a.i - b.j) ** 2 * a.n * b.n) AS chance FROM (SELECT i, count(*) AS n FROM k GROUP BY i) a, (SELECT j, count(*) AS n FROM k GROUP BY j) b) SELECT n, round(1 - seen * n / chance, 9) AS kappa FROM n, e""")
def k11_weighted_kappa(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "n_chars").join(_t(spark, sf, "labels"), "doc_id").select(
        (F.col("n_chars") % 5).alias("a"),
        ((F.col("n_chars") + F.col("quality") * 2) % 5).alias("b")
    )
    return stats.weighted_kappa(d, "a", "b").select("n", F.round("kappa", 9).alias("kappa"))


@query("""WITH x AS (SELECT quality AS a, toxic AS b FROM labels), o AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) / count(*)::DOUBLE AS po FROM x), e AS (SELECT sum(r.n * coalesce(c.n, 0)) AS e FROM (SELECT a, count(*) AS n FROM x GROUP BY a) r LEFT JOIN (SELECT b, count(*) AS n FROM x GROUP BY b) c ON r.a = c.b)
SELECT n, po AS agreement, round((po - e / (n * n)::DOUBLE) / (1 - e / (n * n)::DOUBLE), 9) AS kappa FROM o, e""")
def k12_kappa(spark, sf):
    return stats.cohen_kappa(_t(spark, sf, "labels"), "quality", "toxic").select("n", "agreement", F.round("kappa", 9).alias("kappa"))


@query()
def k13_mixed_model(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return study.mixed_model(li, "y", "x", "l_suppkey")


@query("""WITH g AS (SELECT o_orderpriority, o_custkey % 4 AS rater, sign(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'))::INT AS s FROM orders GROUP BY ALL) SELECT o_orderpriority, count(s) AS n_raters, count(DISTINCT s) = 1 AS agree FROM g GROUP BY o_orderpriority""")
def k15_direction(spark, sf):
    m = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    g = _t(spark, sf, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 4).alias("rater")).agg(F.signum(m("F") - m("O")).cast("int").alias("s"))
    return g.groupBy("o_orderpriority").agg(F.count("s").alias("n_raters"), (F.countDistinct("s") == 1).alias("agree"))


@query(f"""WITH d AS (SELECT doc_id, n_chars FROM documents ORDER BY {_DRAW.format(seed='sample', key='doc_id')}, doc_id LIMIT 50) SELECT doc_id, n_chars, CASE WHEN (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) % 4 IN (0, 3) THEN 1 ELSE 2 END AS block FROM d""")
def l1_sample_snake(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "n_chars")
    return study.snake_blocks(d, 50, tx.draw_order("sample", F.col("doc_id")), "n_chars", "doc_id")


@query(f"""SELECT doc_id, quality, toxic, place, CASE WHEN place % 2 = 1 THEN 'r1' ELSE 'r2' END AS rater FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY {_DRAW.format(seed='strata', key='doc_id')}, doc_id) AS place FROM labels) WHERE place <= 6""")
def l2_stratified(spark, sf):
    s = study.stratified_draw(_t(spark, sf, "labels"), ["quality", "toxic"], 6, tx.draw_order("strata", F.col("doc_id")), "doc_id")
    return s.select("doc_id", "quality", "toxic", "place", F.when(F.col("place") % 2 == 1, "r1").otherwise("r2").alias("rater"))


@query(f"""WITH s AS (SELECT s_suppkey, 'R' || printf('%03d', row_number() OVER (ORDER BY {_DRAW.format(seed='blind', key='s_suppkey')}, s_suppkey)) AS response_id FROM supplier) SELECT response_id, s_suppkey, n_name FROM s JOIN supplier USING (s_suppkey) JOIN nation ON n_nationkey = s_nationkey""")
def l7_blind_codes(spark, sf):
    s = study.blind_codes(_t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), tx.draw_order("blind", F.col("s_suppkey")), "s_suppkey")
    return s.join(_t(spark, sf, "nation"), s["s_nationkey"] == F.col("n_nationkey")).select("response_id", "s_suppkey", "n_name")


@query(r"""WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '—' WHEN 1 THEN (l_quantity::INT % 5 + 1) || ' - setuju' WHEN 2 THEN 'tidak berlaku' WHEN 3 THEN '' ELSE (l_quantity::INT % 5 + 1) || '.5' END AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, TRY_CAST(nullif(regexp_extract(raw, '^([1-5])\s*[–-]', 1), '') AS INT) AS likert, TRY_CAST(nullif(regexp_extract(raw, '^\s*(-?\d+(\.\d+)?)', 1), '') AS DOUBLE) AS number, raw IN ('', '—') AS not_rated FROM c""")
def c12_translate(spark, sf):
    q = (F.pmod(F.col("l_quantity").cast("int"), F.lit(5)) + 1).cast("string")
    n = F.col("l_linenumber") % 5
    raw = F.when(n == 0, "—").when(n == 1, F.concat(q, F.lit(" - setuju"))).when(n == 2, "tidak berlaku").when(n == 3, "").otherwise(F.concat(q, F.lit(".5")))
    c = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return c.select("l_orderkey", "l_linenumber", tx.likert(F.col("raw")).alias("likert"), tx.leading_number(F.col("raw")).alias("number"), F.col("raw").isin("", "—").alias("not_rated"))


@query("""WITH c AS (SELECT event_id, hour(ts) AS h, minute(ts) AS m, ((event_id * 7) % 1440)::INT AS e FROM events) SELECT event_id, h * 60 + m AS start_min, ((e - (h * 60 + m)) % 1440 + 1440) % 1440 AS duration FROM c""")
def c13_clock(spark, sf):
    t = F.format_string("%d:%02d", F.hour("ts"), F.minute("ts"))
    start = tx.clock(F.col("t"))
    e = _t(spark, sf, "events").select("event_id", t.alias("t"), ((F.col("event_id") * 7) % 1440).cast("int").alias("e"))
    return e.select("event_id", start.alias("start_min"), tx.duration(start, F.col("e")).alias("duration"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_discount) AS avg_disc, count(*) AS n, max_by(l_orderkey, (l_extendedprice, l_orderkey)) AS top_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def j1_group_counts(spark, sf):
    li = _t(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_discount").alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
        F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("top_order")
    )


@query("""SELECT r_name, c.c_name IS NULL AS no_match, n_name, concept_n FROM (SELECT n.n_name, r.r_name, count(c.c_custkey) AS concept_n, max(c.c_name) AS c_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 GROUP BY ALL) c""")
def j3_zero_filled(spark, sf):
    """Counts over every declared category, zero where none."""
    rich = _t(spark, sf, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    dims = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return dims.join(rich, "n_nationkey", "left").select("r_name", F.col("k").isNull().alias("no_match"), "n_name", F.coalesce("k", F.lit(0)).alias("concept_n"))


@query(f"""WITH {_PAIR}, g AS (SELECT "case" % 10 AS g, d FROM p) SELECT g, count(*) AS n, round(avg(d), 4) AS mean, round(quantile_cont(d, 0.5), 4) AS median, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, round(avg(d) / stddev_samp(d), 6) AS dz FROM g GROUP BY g HAVING count(*) >= 5""")
def k7_paired_report(spark, sf):
    r = study.paired_report(_pairs(spark, sf).withColumn("g", F.col("case") % 10), ["g"], "d")
    return r.select("g", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("t", 6).alias("t"), F.round("dz", 6).alias("dz"))


@query(f"""WITH d AS (SELECT doc_id, quality, toxic, (row_number() OVER (PARTITION BY quality, toxic ORDER BY {_DRAW.format(seed='deal', key='doc_id')}, doc_id) - 1 + toxic) % 2 AS k FROM labels), r AS (SELECT CASE WHEN doc_id % 9 = 0 THEN 'both' WHEN k = 0 THEN 'r1' ELSE 'r2' END AS rater, quality FROM d),
x AS (SELECT unnest(CASE WHEN rater = 'both' THEN ['r1', 'r2'] ELSE [rater] END) AS rater, quality FROM r) SELECT rater, count(*) AS items, count(*) FILTER (WHERE quality = 1) AS heavy FROM x GROUP BY rater""")
def l3_deal_workload(spark, sf):
    d = study.deal(_t(spark, sf, "labels"), ["quality", "toxic"], ["r1", "r2"], tx.draw_order("deal", F.col("doc_id")), "doc_id", F.col("toxic"))
    return study.workload(d.withColumn("rater", F.when(F.col("doc_id") % 9 == 0, "both").otherwise(F.col("rater"))), "rater", ["r1", "r2"], F.col("quality") == 1)


@query("SELECT p_partkey, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 - (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE) * 0.1::DOUBLE AS \"offset\" FROM part")
def t9_spread(spark, sf):
    return study.jitter(_t(spark, sf, "part"), "p_size", "p_partkey", 0.1).select("p_partkey", "offset")


_CELLS = """cells AS (SELECT conv_id AS sheet, turn AS "row", 1 AS "col", role AS value FROM conversations UNION ALL SELECT conv_id, turn, 2, text FROM conversations)"""


@query(f"""WITH {_CELLS}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet, value ORDER BY "row", "col") AS nth FROM cells WHERE value IN ('user', 'assistant')) WHERE nth = 1) SELECT h.sheet, h.value AS header, c.value AS answer FROM h LEFT JOIN cells c ON c.sheet = h.sheet AND c."row" = h."row" AND c."col" = h."col" + 1""")
def a14_cell_answers(spark, sf):
    c = _t(spark, sf, "conversations")
    cells = c.select(
        F.col("conv_id").alias("sheet"),
        F.col("turn").alias("row"),
        F.explode(F.array(
            F.struct(F.lit(1).alias("col"), F.col("role").alias("value")),
            F.struct(F.lit(2).alias("col"), F.col("text").alias("value"))
        )).alias("c")
    ).select("sheet", "row", "c.col", "c.value")
    return study.cell_answers(cells, ["user", "assistant"])


@query()
def a17_worksheet(spark, sf):
    c = _t(spark, sf, "conversations")
    lines = c.select(
        "conv_id",
        F.explode(F.array(
            F.struct((F.col("turn") * 2).alias("line_no"), F.when(F.col("turn") % 2 == 0, "## entry").otherwise("").alias("text")),
            F.struct((F.col("turn") * 2 + 1).alias("line_no"), F.concat("role", F.lit(": "), F.regexp_replace("text", "\n", " ")).alias("text"))
        )).alias("l")
    ).select("conv_id", "l.line_no", "l.text")
    return study.worksheet(lines, "conv_id", "^## ", r"^(\w+): (.*)$")


@query("""WITH s AS (SELECT l_orderkey AS response_id, avg(l_quantity) AS score FROM lineitem GROUP BY l_orderkey), k AS (SELECT o_orderkey AS response_id, o_custkey AS question_id, o_orderstatus AS condition FROM orders)
SELECT condition, c_mktsegment AS stratum, count(*) AS n, count(score) AS n_scored, round(avg(score), 6) AS mean FROM k LEFT JOIN s USING (response_id) LEFT JOIN customer ON c_custkey = question_id GROUP BY ALL""")
def h6_blind_key_join(spark, sf):
    """Scores joined to the blind key, then to the case's data; cases without a score stay."""
    s = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("response_id")).agg(F.avg("l_quantity").alias("score"))
    k = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("response_id"), F.col("o_custkey").alias("question_id"), F.col("o_orderstatus").alias("condition"))
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_mktsegment").alias("stratum"))
    return k.join(s, "response_id", "left").join(c, "question_id", "left").groupBy("condition", "stratum").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("n_scored"),
        F.round(F.avg("score"), 6).alias("mean")
    )


@query("""SELECT d.doc_id, l.quality IS NULL AS pending FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL""")
def h17_resume(spark, sf):
    """What is still to do: the rows whose id is not done yet."""
    return _t(spark, sf, "documents").select("doc_id").join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").withColumn("pending", F.lit(True))


@query("""SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3""")
def m1_top_per_group(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return _t(spark, sf, "part").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("""SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1""")
def m5_duplicate_ids(spark, sf):
    return _t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("""(SELECT c_custkey AS key FROM customer WHERE c_acctbal > 5000) INTERSECT (SELECT o_custkey FROM orders) """)
def m8_intersect(spark, sf):
    return _t(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("key")).intersect(_t(spark, sf, "orders").select(F.col("o_custkey").alias("key")))


@query("""(SELECT c_custkey AS key FROM customer) EXCEPT (SELECT o_custkey FROM orders)""")
def m9_except(spark, sf):
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("key")).exceptAll(_t(spark, sf, "orders").select(F.col("o_custkey").alias("key"))).distinct()


@query("""SELECT c_custkey AS key FROM customer WHERE c_acctbal > 9000 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000""")
def m7_union(spark, sf):
    rich = _t(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("key"))
    return rich.union(_t(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("key"))).distinct()


@query("""SELECT n_chunks, spec, config_strategy, size, overlap FROM (SELECT 'fixed-' || (64 * (1 + doc_id % 3)) || CASE WHEN doc_id % 2 = 0 THEN '-16' ELSE '' END AS spec, count(*) AS n_chunks FROM documents GROUP BY 1), LATERAL (SELECT split_part(spec, '-', 1) AS config_strategy, split_part(spec, '-', 2)::INT AS size, coalesce(nullif(split_part(spec, '-', 3), ''), '0')::INT AS overlap)""")
def t19_parse_config(spark, sf):
    spec = F.concat(F.lit("fixed-"), 64 * (1 + F.col("doc_id") % 3), F.when(F.col("doc_id") % 2 == 0, "-16").otherwise(""))
    parts = F.split("spec", "-")
    return _t(spark, sf, "documents").groupBy(spec.alias("spec")).agg(F.count(F.lit(1)).alias("n_chunks")).select(
        "n_chunks",
        "spec",
        parts[0].alias("config_strategy"),
        parts[1].cast("int").alias("size"),
        F.coalesce(F.try_element_at(parts, F.lit(3)).cast("int"), F.lit(0)).alias("overlap")
    )


@query("""WITH f AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS f FROM conversations WHERE role = 'user')
SELECT * FROM (SELECT conv_id, turn, list_filter(['the', 'und'], lambda k: contains(f, k) OR contains(replace(f, ' ', ''), k)) AS matched FROM f) WHERE len(matched) > 0""")
def stream_screen(spark, sf):
    """The keyword screen over conversations as a stream, run to the end of the input."""
    return replay.screened(spark, f"{sf}/conversations.parquet", ["the", "und"])


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    """Tumbling counts of events by type with a watermark, run to the end of the input."""
    w = replay.windowed_counts(spark, f"{sf}/events.parquet")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


_DIMENSIONS = """e AS (SELECT dimension, d FROM (SELECT o_orderpriority AS dimension, o_custkey, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS d FROM orders GROUP BY ALL) WHERE d IS NOT NULL),
report AS (SELECT dimension, count(*) AS n, avg(d) AS mean, quantile_cont(d, 0.5) AS median, avg(d) / stddev_samp(d) AS dz FROM e GROUP BY dimension HAVING count(*) >= 5 AND count(*) FILTER (WHERE d <> 0) > 0)"""


@query(f"""{_wilcoxon(_DIMENSIONS, "dimension")}, f AS (SELECT report.*, p.p, p.method FROM report JOIN p USING (dimension)), m AS (SELECT dimension, p, row_number() OVER (ORDER BY p, dimension) AS i, count(*) OVER () AS n FROM f WHERE dimension <> '1-URGENT'),
h AS (SELECT dimension, max(least(1, (n - i + 1) * p)) OVER (ORDER BY i) AS p_holm FROM m) SELECT dimension, n, round(mean, 4) AS mean, round(median, 4) AS median, round(dz, 6) AS dz, method, round(p, 9) AS p, round(p_holm, 9) AS p_holm FROM f LEFT JOIN h USING (dimension)""")
def k14_primary_analysis(spark, sf):
    """Every dimension's pairs with their tests; the first dimension is primary, the others one Holm family."""
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    a = study.primary_analysis(o, "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "F", "O", "1-URGENT")
    r = lambda c, n: F.round(c, n).alias(c)
    return a.select("dimension", "n", r("mean", 4), r("median", 4), r("dz", 6), "method", r("p", 9), r("p_holm", 9))


@query("""WITH w AS (SELECT l_shipmode AS dimension, l_orderkey, avg(l_quantity) FILTER (WHERE l_linenumber % 2 = 0) AS a, avg(l_quantity) FILTER (WHERE l_linenumber % 2 = 1) AS b FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag AS l_shipmode FROM lineitem) GROUP BY ALL), c AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
g AS (SELECT dimension, count(*) AS n, avg((a + b) / 2) AS g, avg(a) AS ma, avg(b) AS mb FROM c GROUP BY dimension), s AS (SELECT dimension, any_value(g.n) AS n, 2 * sum(((a + b) / 2 - g) ** 2) AS ssr, any_value(g.n) * any_value((ma - g) ** 2 + (mb - g) ** 2) AS ssc, sum((a - g) ** 2 + (b - g) ** 2) AS sst FROM c JOIN g USING (dimension) GROUP BY dimension),
m AS (SELECT dimension, n, ssr / (n - 1) AS msr, ssc AS msc, (sst - ssr - ssc) / (n - 1) AS mse FROM s) SELECT dimension, n, round((msr - mse) / (msr + mse + 2 * (msc - mse) / n), 9) AS icc FROM m""")
def k16_inter_rater(spark, sf):
    """Agreement of two raters on the items that both rated, by dimension."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("dimension"), "l_quantity", F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd").alias("rater"))
    return study.inter_rater(li, "l_orderkey", "rater", "dimension", "l_quantity", ("even", "odd")).select("dimension", "n", F.round("icc", 9).alias("icc"))


@query(f"""WITH s AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY {_DRAW.format(seed='raters', key='doc_id')}, doc_id) AS k FROM labels)
SELECT doc_id, CASE WHEN k <= 2 + toxic THEN 'both' WHEN (k - (2 + toxic) - 1 + quality) % 2 = 0 THEN 'p1' ELSE 'p2' END AS rater FROM s""")
def l4_assign_raters(spark, sf):
    """Shared cases drawn from each stratum, the others dealt to two raters from an offset of the stratum."""
    labels = _t(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return study.assign_raters(labels, ["quality", "toxic"], F.lit(2) + F.col("toxic"), ["p1", "p2"], tx.draw_order("raters", F.col("doc_id")), "doc_id", F.col("quality")).select("doc_id", "rater")


QUERIES, ORACLES = Q, O
