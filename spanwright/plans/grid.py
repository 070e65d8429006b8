"""Queries over grids of indexes: chunk configurations by models, their statistics, searches and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.operators import chunk, index, vector
from spanwright.plans.retrieval import _t
from spanwright.plans.texts import _TOK, _fixed_sql
from spanwright.session import materialised, shared_dir
from spanwright.sources import tables

Q, O = {}, {}

_CONFIGS = [("fixed-64-16", 64, 16), ("fixed-128-0", 128, 0)]
#: name, dimensions, tokens that it reads.
_MODELS = [("wide", 64, 100), ("slim", 32, 50)]


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


def _models(spark):
    rows = [(f"{c}__{m}__mv", c, m, dim, read, "ip", m == "wide", False, True) for c, _, _ in _CONFIGS for m, dim, read in _MODELS]
    return spark.createDataFrame(
        rows,
        "index_id string, chunk_config_id string, model string, dim int, max_seq_len int, metric string, normalized boolean, context_enriched boolean, multi_vector boolean"
    )


def _grid(spark, sf):
    """(models, chunks, vectors, queries): every chunk of both configurations under both models.

    A chunk's windows stand for stretches of ``max_seq_len`` tokens; the vector of window w is an embedding picked by document, place and w.
    """
    models = _models(spark)
    spans = chunk.chunk_sweep(_t(spark, sf, "documents").select("doc_id", "text"), _CONFIGS, with_text=False)
    chunks = spans.withColumnRenamed("config_id", "chunk_config_id").join(F.broadcast(models), "chunk_config_id")
    chunks = materialised(chunks.select("index_id", F.concat_ws("-", "doc_id", "seq").alias("chunk_id"), "n_tokens", "max_seq_len", "dim", "doc_id", "seq", "char_start", "char_end"), "grid-chunks")
    e = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    windows = chunks.select("index_id", "chunk_id", "dim", "doc_id", "seq", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("max_seq_len")).cast("int") - 1)).alias("window_no"))
    picked = windows.join(F.broadcast(n), F.lit(True)).withColumn("vec_id", (F.col("doc_id") * 7 + F.col("seq") * 3 + F.col("window_no")) % F.col("n"))  # one row by all
    vectors = picked.join(e, "vec_id").select("index_id", "chunk_id", "window_no", F.slice("embedding", F.lit(1), F.col("dim")).alias("vec"))
    asked = e.filter(F.col("vec_id") % 50 == 0).join(F.broadcast(models), F.lit(True))  # a few models
    queries = asked.select("index_id", F.col("vec_id").alias("query_id"), F.slice("embedding", F.lit(1), F.col("dim")).alias("vec"))
    return models, chunks, vectors, queries


_MODEL_ROWS = ", ".join(f"('{c}__{m}__mv', '{c}', '{m}', {dim}, {read}, '{m}' = 'wide')" for c, _, _ in _CONFIGS for m, dim, read in _MODELS)
_GRID = f"""WITH {_TOK}, c AS ({" UNION ALL ".join(f"SELECT '{c}' AS chunk_config_id, * FROM ({_fixed_sql(s, o)})" for c, s, o in _CONFIGS)}),
m(index_id, chunk_config_id, model, dim, max_seq_len, normalized) AS (VALUES {_MODEL_ROWS}),
ch AS (SELECT index_id, doc_id || '-' || seq AS chunk_id, n_tokens, max_seq_len, dim, doc_id, seq, char_start, char_end FROM c JOIN m USING (chunk_config_id)),
w AS (SELECT *, unnest(range(0, (n_tokens + max_seq_len - 1) // max_seq_len)) AS window_no FROM ch),
v AS (SELECT w.*, e.embedding[1:dim] AS vec FROM w JOIN embeddings e ON e.vec_id = (w.doc_id * 7 + w.seq * 3 + w.window_no) % (SELECT count(*) FROM embeddings)),
tokens AS (SELECT index_id, count(*) AS n_chunks, round(avg(n_tokens), 1) AS tokens_mean, max(n_tokens) AS tokens_max, count(*) FILTER (WHERE n_tokens > max_seq_len) AS truncated_chunks, round(count(*) FILTER (WHERE n_tokens > max_seq_len) / count(*), 4) AS truncation_rate FROM ch GROUP BY index_id),
windows AS (SELECT index_id, sum(n)::BIGINT AS n_vectors, count(*) FILTER (WHERE n > 1) AS windowed_chunks FROM (SELECT index_id, chunk_id, count(*) AS n FROM w GROUP BY ALL) GROUP BY index_id),
stats AS (SELECT m.*, 'ip' AS metric, false AS context_enriched, true AS multi_vector, n_chunks, tokens_mean, tokens_max, truncated_chunks, truncation_rate, n_vectors, windowed_chunks FROM m JOIN tokens USING (index_id) JOIN windows USING (index_id)),
best AS (SELECT v.index_id, q.vec_id AS query_id, v.chunk_id, max(round(list_inner_product(q.embedding[1:dim]::DOUBLE[], v.vec::DOUBLE[]), 9)) AS score FROM v, embeddings q WHERE q.vec_id % 50 = 0 GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY index_id, query_id ORDER BY score DESC, chunk_id) AS rank FROM best)"""


@query(f"{_GRID} SELECT index_id, query_id, rank, chunk_id, score, n_chunks, n_vectors, windowed_chunks, truncation_rate FROM top JOIN stats USING (index_id) WHERE rank <= 10")
def g12_index_grid(spark, sf):
    """The ten best chunks of every index of the grid for every query, with the index's figures."""
    models, chunks, vectors, queries = _grid(spark, sf)
    top = index.grid_topk(index.checked(vectors, models), queries, 10)
    stats = index.index_stats(chunks, vectors, models).select("index_id", "n_chunks", "n_vectors", "windowed_chunks", "truncation_rate")
    return top.join(F.broadcast(stats), "index_id")


@query(f"{_GRID} SELECT * FROM stats")
def b7_index_records(spark, sf):
    """The record of every index: sixteen columns."""
    models, chunks, vectors, _ = _grid(spark, sf)
    return index.index_stats(chunks, vectors, models)


@query(f"{_GRID} SELECT index_id, chunk_id, window_no, list_transform(vec, lambda x: round(x::DOUBLE, 6)) AS vec, n_tokens, char_start, char_end FROM v")
def b6_index_store(spark, sf):
    """All indexes saved beside their chunk tables, bucketed alike, and loaded by a join without an exchange."""
    _, chunks, vectors, _ = _grid(spark, sf)
    at = tables.new_folder(shared_dir(spark), spark.sparkContext.applicationId, "index")
    names = [f"{kind}_{at.rpartition('-')[2]}" for kind in ("vectors", "chunks")]
    index.save(vectors, names[0], f"{at}/vectors", buckets=8)
    index.save(chunks.select("index_id", "chunk_id", "n_tokens", "char_start", "char_end"), names[1], f"{at}/chunks", buckets=8)
    back = index.load(spark, *names)
    return back.withColumn("vec", F.transform("vec", lambda x: vector.rounded(x.cast("double"), 6)))


QUERIES, ORACLES = Q, O
