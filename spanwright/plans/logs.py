"""Queries over logs: the append-only interaction log, resumed generation, incremental builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.operators import chunk, deidentify, incremental
from spanwright.plans.retrieval import _t
from spanwright.plans.texts import _TOK, _fixed_sql
from spanwright.session import shared_dir
from spanwright.sources import tables
from spanwright.streaming import resume
from spanwright.streaming.interaction_log import InteractionLog

Q, O = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


def _folder(spark, name):
    return tables.new_folder(shared_dir(spark), spark.sparkContext.applicationId, name)


@query("""SELECT 'desk' AS session, conv_id, turn, role, md5(text) AS digest, substr(sha256('{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":' || to_json(role) || ',"text":' || to_json(text) || '}'), 1, 12) AS interaction_id FROM conversations""")
def b10_interaction_log(spark, sf):
    """Conversations streamed to a log in two runs over one checkpoint; the batches are then replayed and add nothing."""
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    inbox, at = _folder(spark, "inbox"), _folder(spark, "log")
    log = InteractionLog(spark, at, turns.schema)
    for part in ("role = 'user'", "role <> 'user' OR role IS NULL"):
        turns.filter(part).write.mode("append").parquet(inbox)
        log.append(spark.readStream.schema(turns.schema).parquet(inbox), "desk", f"{at}/state").awaitTermination()
    for entry in log.manifest().orderBy("batch").limit(2).collect():
        log.write_batch(turns, entry.session, entry.batch)
    return log.records().select("session", "conv_id", "turn", "role", F.md5("text").alias("digest"), "interaction_id")


_VARIANTS = [(f"fixed-{size}-{over}", size, over) for size in (64, 128) for over in (0, 16)]


@query(f"""WITH {_TOK}, c AS ({" UNION ALL ".join(f"SELECT '{v}' AS variant, * FROM ({_fixed_sql(s, o)})" for v, s, o in _VARIANTS)})
SELECT variant, CASE WHEN variant IN ('fixed-64-0', 'fixed-128-16') THEN 'first' ELSE 'second' END AS run, count(*) AS n_rows, sum(n_tokens)::BIGINT AS n_tokens FROM c GROUP BY variant""")
def t3_missing_variants(spark, sf):
    """Chunk variants of all documents: the first run builds two, the second the two that are missing, the third none."""
    docs, at = _t(spark, sf, "documents").select("doc_id", "text"), _folder(spark, "variants")
    inputs = docs.agg(F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(F.xxhash64("doc_id", "text"))).alias("inputs"))
    wanted = spark.createDataFrame(_VARIANTS, "variant string, size int, overlap int").join(inputs, F.lit(True))  # one row
    build = lambda todo: chunk.chunk_sweep(docs, sorted((r.variant, r["size"], r.overlap) for r in todo.collect()), with_text=False).withColumnRenamed("config_id", "variant")
    incremental.build_missing(spark, at, wanted.filter(F.col("variant").isin("fixed-64-0", "fixed-128-16")), build, "first")
    incremental.build_missing(spark, at, wanted, build, "second")
    if incremental.build_missing(spark, at, wanted, build, "third"):
        raise AssertionError("a third run has nothing to build")
    held = incremental.rows(spark, at, build(wanted.limit(1))).groupBy("variant").agg(F.sum("n_tokens").alias("n_tokens"))
    return incremental.manifest(spark, at).join(held, "variant").select("variant", "run", "n_rows", "n_tokens")


_NEEDLES = r"""n AS (SELECT DISTINCT needle FROM (SELECT regexp_extract(text, '^\w+ \w+') AS needle FROM benchmark UNION ALL SELECT regexp_extract(text, '^\w+ \w+ \w+') FROM benchmark UNION ALL SELECT regexp_extract(text, '\w{5,}') FROM benchmark) WHERE needle <> ''),
p AS (SELECT string_agg(needle, '|' ORDER BY length(needle) DESC, needle) AS p FROM n)"""


@query(rf"""WITH {_NEEDLES} SELECT doc_id, regexp_replace(text, p, '[nama]', 'g') AS clean, len(regexp_extract_all(text, p)) AS n_removed FROM documents, p""")
def d15_substitution(spark, sf):
    """Names taken from the benchmark's texts, some the beginnings of others, out of all documents; a second run changes nothing."""
    b = _t(spark, sf, "benchmark")
    needles = [F.regexp_extract("text", p, 0) for p in (r"^\w+ \w+", r"^\w+ \w+ \w+", r"\w{5,}")]
    rules = b.select(F.lit(None).cast("string").alias("id"), F.explode(F.array(*needles)).alias("needle")).filter("needle <> ''").distinct().withColumn("replacement", F.lit("[nama]"))
    once = deidentify.deidentify(_t(spark, sf, "documents").select("doc_id", "text"), rules)
    again = deidentify.deidentify(once.withColumnRenamed("n_removed", "n").drop("survives"), rules)
    return again.select("doc_id", F.col("text").alias("clean"), (F.col("n") + F.col("n_removed")).alias("n_removed"))


@query("""SELECT o_custkey AS question_id, max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT", max(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH", max(o_totalprice) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS "3-MEDIUM",
max(o_totalprice) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED", max(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW" FROM orders GROUP BY o_custkey""")
def a10_score_pivot(spark, sf):
    """Scores written as CSV, read as text and turned into a column for each system."""
    o = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("question_id"), F.col("o_orderpriority").alias("index_id")).agg(F.max("o_totalprice").alias("ndcg"))
    at = _folder(spark, "scores")
    o.write.option("header", True).csv(at)
    return tables.score_columns(tables.read_csv(spark, at, "question_id long, index_id string, ndcg string"), "ndcg")


@query("""SELECT event_id::VARCHAR AS event_id, coalesce(CASE WHEN event_type = 'click' THEN value::DECIMAL(18, 2)::VARCHAR END, '') AS click_value, coalesce(CASE WHEN event_type <> 'click' THEN user_id::VARCHAR END, '') AS user_id FROM events""")
def b8_union_csv(spark, sf):
    """Rows of different keys written under the union of their keys and read back."""
    e = _t(spark, sf, "events")
    always = F.create_map(F.lit("event_id"), F.col("event_id").cast("string"))
    other = F.when(
        F.col("event_type") == "click",
        F.create_map(F.lit("click_value"), F.col("value").cast("decimal(18,2)").cast("string"))
    ).otherwise(F.create_map(F.lit("user_id"), F.col("user_id").cast("string")))
    at = _folder(spark, "union")
    header = tables.write_union_csv(e.select("event_id", F.map_concat(always, other).alias("fields")), "fields", "event_id", at)
    back = tables.read_csv(spark, at, ", ".join(f"`{c}` string" for c in header))
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("event_id", "click_value", "user_id")])


@query("""WITH q AS (SELECT conv_id || '/' || turn AS question_id, text AS question, len(list_filter(['the', 'und'], lambda k: contains(replace(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ', ''), k))) > 0 AS screen, CASE WHEN conv_id % 5 = 0 THEN turn % 4 = 0 END AS pin FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT question_id, coalesce(pin, screen) AS risky, pin IS NOT NULL AS pinned, md5(CASE WHEN coalesce(pin, screen) THEN '[!] ' ELSE '' END || question) AS answer FROM q""")
def o10_resumed_generation(spark, sf):
    """User turns answered in two runs, the second with all files again: what is done is skipped, pinned verdicts win."""
    turns = _t(spark, sf, "conversations").filter("role = 'user' AND text IS NOT NULL")
    key = F.concat_ws("/", "conv_id", "turn")
    none = F.lit(None)
    asked = turns.select(
        "conv_id",
        key.alias("question_id"),
        F.lit(1).cast("long").alias("nth"),
        F.col("text").alias("question"),
        (F.size(tx.matched_keywords(F.col("text"), ["the", "und"])) > 0).alias("risky"),
        none.cast("boolean").alias("pin")
    )
    pins = turns.filter("conv_id % 5 = 0").select(
        key.alias("question_id"),
        F.lit(0).cast("long").alias("nth"),
        none.cast("string").alias("question"),
        none.cast("boolean").alias("risky"),
        (F.col("turn") % 4 == 0).alias("pin")
    )
    inbox, at = _folder(spark, "questions"), _folder(spark, "answers")
    answered = lambda d: d.select("question_id", "risky", "pinned", F.md5(F.concat(F.when(F.col("risky"), "[!] ").otherwise(""), "question")).alias("answer"))
    pins.write.parquet(inbox)
    for half in (asked.filter("conv_id % 2 = 0"), asked):  # the first run is cut off half-way
        half.drop("conv_id").write.mode("append").parquet(inbox)
        resume.generate(spark.readStream.schema(resume.EVENTS).parquet(inbox), answered, f"{at}/data", f"{at}/state").awaitTermination()
    return spark.read.schema("question_id string, risky boolean, pinned boolean, answer string").parquet(f"{at}/data")


QUERIES, ORACLES = Q, O
