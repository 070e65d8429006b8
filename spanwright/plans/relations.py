"""Queries that set tables beside each other: alignments, roles, blinding, probes, packets, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.operators import relate, stats, vector
from spanwright.plans.retrieval import _PAIRS, _queries, _t
from spanwright.plans.study import _DRAW
from spanwright.session import shared_dir
from spanwright.sources import tables

Q, O = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


@query("""WITH a AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_custkey, round(a.v, 4) AS a, round(b.v, 4) AS b, round(a.v - b.v, 4) AS d FROM a JOIN b USING (o_custkey)""")
def h8_aligned(spark, sf):
    """Two series of means by customer, aligned; customers of one series only are left out."""
    o = _t(spark, sf, "orders")
    side = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"))
    r = relate.aligned(side("F"), side("O"), "o_custkey", "v")
    return r.select("o_custkey", *[F.round(c, 4).alias(c) for c in ("a", "b", "d")])


@query("""SELECT o_orderkey, n, quantity, n - quantity AS d FROM (SELECT o_orderkey, o_totalprice AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1) ON l_orderkey = o_orderkey""")
def h9_strict_pairs(spark, sf):
    """Two systems' figures paired item by item; an item of one system only would be an error."""
    o, li = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    sums = li.groupBy("o_orderkey").agg(F.sum("l_quantity").alias("v")).join(o.select("o_orderkey"), "o_orderkey", "left_semi")
    own = o.join(li, "o_orderkey", "left_semi").withColumnRenamed("o_totalprice", "v")
    return relate.aligned(own, sums, "o_orderkey", "v", strict=True).select("o_orderkey", F.col("a").alias("n"), F.col("b").alias("quantity"), "d")


@query("""SELECT d.doc_id, md5(d.text) AS digest, l.quality, s.n AS source_size FROM documents d JOIN labels l USING (doc_id) JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s USING (source)""")
def h11_three_way(spark, sf):
    """Questions beside their answers and their assignment: three tables, two keys, six columns."""
    d = _t(spark, sf, "documents").select("doc_id", "text", "source")
    sizes = d.groupBy("source").agg(F.count(F.lit(1)).alias("source_size"))
    return d.join(_t(spark, sf, "labels").select("doc_id", "quality"), "doc_id").join(sizes, "source").select("doc_id", F.md5("text").alias("digest"), "quality", "source_size")


@query("""SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 4)""")
def h20_shared_cases(spark, sf):
    """Rows of the cases that are shared: those of four turns or more."""
    c = _t(spark, sf, "conversations")
    shared = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    return c.join(shared, "conv_id", "left_semi").select("conv_id", "turn", F.md5("text").alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag IN ('A', 'R') AS retained, CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity::INT ELSE -1 END AS char_start, CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity::INT + 9 ELSE -1 END AS char_end FROM lineitem""")
def c5_roles(spark, sf):
    """Rows split into retained and dropped by role; dropped ones have no offsets."""
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("int").alias("char_start"), (F.col("l_quantity").cast("int") + 9).alias("char_end"))
    return relate.by_role(li, "l_returnflag", ["A", "R"]).drop("l_returnflag")


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '  ' END AS text FROM conversations) WHERE trim(text) <> ''""")
def c7_required(spark, sf):
    """Rows whose required fields are there: texts that are null or blank go."""
    c = _t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, "  ").alias("text"))
    return relate.required(c, ["conv_id", "text"]).drop("text")


@query("""SELECT doc_id, md5(text) AS digest FROM documents JOIN labels USING (doc_id)""")
def c8_blind(spark, sf):
    """Items for a rater, without the labels and the source that would tell."""
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id").withColumn("digest", F.md5("text"))
    return relate.blinded(d, ["text", "lang", "source", "n_chars", "quality", "toxic"])


@query("""SELECT source, row_number() OVER (ORDER BY min(doc_id)) AS place FROM documents GROUP BY source""")
def m6_first_seen(spark, sf):
    """Sources in the order in which they are first seen."""
    return relate.first_seen(_t(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders QUALIFY place BETWEEN 40 AND 99""")
def m11_page(spark, sf):
    """Sixty orders behind the forty dearest (a page of a report)."""
    o = _t(spark, sf, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("_price"))
    return relate.page(o, ["_price", "o_orderkey"], 40, 60).select("o_orderkey", "place")


@query(f"""WITH {_PAIRS.format(where='')} SELECT query_id, bool_or(rank <= 3 AND label = qlabel AND vec_id <> query_id) AS hit_at_3, bool_or(rank <= 10 AND label = qlabel AND vec_id <> query_id) AS hit_at_10, max(vec_id) FILTER (WHERE rank = 1) AS top_vec_id, max(label) FILTER (WHERE rank = 1) AS top_label FROM ranked GROUP BY query_id""")
def t6_probe(spark, sf):
    """For every query whether another vector of its label is among the first three and ten, and what stands first."""
    e = _t(spark, sf, "embeddings")
    top = vector.topk_inner_product(e.select("vec_id", "embedding"), _queries(e), 10).withColumnRenamed("id", "vec_id")
    named = top.join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel")), "query_id")
    return relate.probe(named, "query_id", "rank", (F.col("label") == F.col("qlabel")) & (F.col("vec_id") != F.col("query_id")), (3, 10), ["vec_id", "label"])


@query("""WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) SELECT doc_id, w * 100 AS start, least(w * 100 + 100, n) AS stop FROM t, range(0, (n + 99) // 100) AS r(w)""")
def f18_passage_windows(spark, sf):
    """Token windows of every document under a limit of 128 tokens, 26 for the prefix and 2 special ones."""
    n = F.regexp_count("text", F.lit(r"\S+"))
    return _t(spark, sf, "documents").select("doc_id", F.explode(relate.passage_windows(n, 128, 26, 2)).alias("w")).select("doc_id", "w.*")


@query("""WITH s AS (SELECT source, max(n_chars) AS tokens_max, CASE source WHEN (SELECT min(source) FROM documents) THEN NULL ELSE 8000 END AS cap FROM documents GROUP BY source)
SELECT source, CASE WHEN cap IS NULL OR tokens_max IS NULL THEN 'unknown' WHEN tokens_max > cap THEN 'cap exceeded' ELSE 'no-op' END AS truncation FROM s""")
def g19_truncation(spark, sf):
    """Whether a source's longest text exceeds a cap; one source has no cap."""
    d = _t(spark, sf, "documents")
    least = d.agg(F.min("source").alias("_least"))
    s = d.groupBy("source").agg(F.max("n_chars").alias("tokens_max")).join(F.broadcast(least), F.lit(True))  # one row
    return relate.truncation_class(s.withColumn("cap", F.when(~F.col("source").eqNullSafe(F.col("_least")), 8000)), "tokens_max", "cap").select("source", "truncation")


@query("""WITH x AS (SELECT n_chars > 1500 AS screen, toxic = 1 AS judge, quality = 1 AS surfaced FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS n, count(*) FILTER (WHERE judge) AS judged_risky, count(*) FILTER (WHERE screen OR judge) AS in_union, count(*) FILTER (WHERE (screen OR judge) AND surfaced) AS surfaced, count(*) FILTER (WHERE (screen OR judge) AND surfaced) / count(*) FILTER (WHERE screen OR judge)::DOUBLE AS rate FROM x""")
def t1_two_metrics(spark, sf):
    """A safety metric on all rows and one on those that screen or judge calls risky."""
    d = _t(spark, sf, "documents").select("doc_id", "n_chars").join(_t(spark, sf, "labels"), "doc_id")
    return relate.two_metrics(d, F.col("n_chars") > 1500, F.col("toxic") == 1, F.col("quality") == 1)


@query(f"""SELECT printf('R%03d', row_number() OVER (ORDER BY {_DRAW.format(seed='blind', key='doc_id')}, doc_id)) AS response_id, doc_id, quality AS condition FROM labels""")
def t33_sealed_key(spark, sf):
    """The sealed key behind blind codes, in the codes' order."""
    labels = _t(spark, sf, "labels").select("doc_id", "quality")
    return relate.sealed_key(labels, tx.draw_order("blind", F.col("doc_id")), "doc_id", ["doc_id", F.col("quality").alias("condition")])


@query("""SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS packet FROM conversations GROUP BY conv_id""")
def t14_packet_files(spark, sf):
    """One file of JSON lines for each conversation, its turns in order, written and read back in the files' order."""
    c = _t(spark, sf, "conversations")
    at = tables.new_folder(shared_dir(spark), spark.sparkContext.applicationId, "packets")
    relate.write_packets(c, "conv_id", ["turn"], at)
    back = spark.read.schema("turn long, role string, text string, conv_id long").json(at).withColumn("_at", F.col("_metadata.file_block_start") + F.monotonically_increasing_id())
    told = F.transform(F.array_sort(F.collect_list(F.struct("_at", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return back.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(told, "\n")).alias("packet"))


@query("""WITH s AS (SELECT source, lang, avg(n_chars) AS size, avg(quality) AS quality, avg(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
p AS (SELECT 'quality' AS against, lang, size, round(quality, 9) AS v FROM s UNION ALL SELECT 'toxic', lang, size, round(toxic, 9) FROM s),
r AS (SELECT against, lang, rank() OVER (PARTITION BY against, lang ORDER BY size) + (count(*) OVER (PARTITION BY against, lang, size) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY against, lang ORDER BY v) + (count(*) OVER (PARTITION BY against, lang, v) - 1) / 2.0::DOUBLE AS b FROM p)
SELECT against, lang, count(*) AS n, CASE WHEN isnan(corr(a, b)) THEN NULL ELSE round(corr(a, b), 6) END AS rho FROM r GROUP BY ALL HAVING count(*) >= 4""")
def k17_triangulation(spark, sf):
    """Rank correlations of a measure with two others, by language, for four pairs or more."""
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(_t(spark, sf, "labels"), "doc_id")
    s = d.groupBy("source", "lang").agg(F.avg("n_chars").alias("size"), F.round(F.avg("quality"), 9).alias("quality"), F.round(F.avg("toxic"), 9).alias("toxic"))
    both = s.select("lang", "size", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("against", "v"))
    r = stats.spearman(both, "size", "v", ["against", "lang"])
    return r.select("against", "lang", "n", F.round("rho", 6).alias("rho"))


QUERIES, ORACLES = Q, O
