"""Queries over cells, segments, indexes and study ledgers: header maps, canonical texts, index checks, freezes, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.operators import chunk, reports, study
from spanwright.plans.retrieval import _t
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


_DRAW = "('0x' || substr(md5('{seed}/' || {key}), 1, 8))::BIGINT"


def _written(spark, name):
    """A new folder for what a query writes and reads back."""
    return tables.new_folder(shared_dir(spark), spark.sparkContext.applicationId, name)


# cells


def _part_cells(spark, sf):
    """Parts as sheets of cells: a sheet a brand, a header in row 0 whose columns are not in one order."""
    p = _t(spark, sf, "part")
    flip = F.col("p_size") % 2
    cell = lambda col, value: F.struct(col.cast("int").alias("col"), value.cast("string").alias("value"))
    body = p.select(
        (F.concat("p_brand", F.lit("/"), flip)).alias("sheet"),
        (F.col("p_partkey") + 1).alias("row"),
        F.explode(F.array(cell(1 + flip, F.col("p_partkey")), cell(2 - flip, F.col("p_type")), cell(F.lit(3), F.col("p_size")))).alias("c")
    )
    names = p.select(F.concat("p_brand", F.lit("/"), flip).alias("sheet"), flip.alias("flip")).distinct()
    head = names.select(
        "sheet",
        F.lit(0).cast("long").alias("row"),
        F.explode(F.array(
            cell(1 + F.col("flip"), F.lit("Item no.")),
            cell(2 - F.col("flip"), F.lit("Kind of item")),
            cell(F.lit(3), F.lit("Size (cm)"))
        )).alias("c")
    )
    return head.unionByName(body).select("sheet", "row", "c.col", "c.value")


_ITEMS = "SELECT p_brand || '/' || (p_size % 2) AS sheet, p_partkey + 1 AS \"row\", p_partkey::VARCHAR AS item, p_type AS kind FROM part"


@query(_ITEMS)
def a13_header_map(spark, sf):
    """Columns by the names in the header row, wherever they stand."""
    return study.by_header(_part_cells(spark, sf), {"item": "Item no.", "kind": "Kind of item"})


@query(_ITEMS.replace(" AS kind", " AS kind, p_size::VARCHAR AS size"))
def a16_fuzzy_header(spark, sf):
    """Columns by a part of a header, in any case."""
    return study.by_header(_part_cells(spark, sf), {"item": "item no", "kind": "kind", "size": "size"}, fuzzy=True)


@query("""SELECT conv_id AS sheet, turn AS item, text AS answer FROM conversations WHERE turn % 3 <> 2""")
def a15_answers_below(spark, sf):
    """An answer is one row below its item number, in column 3; numbers may be floats, fractions are none."""
    c = _t(spark, sf, "conversations")
    number = F.when(F.col("turn") % 3 == 0, F.col("turn").cast("string")).when(F.col("turn") % 3 == 1, F.concat("turn", F.lit(".0"))).otherwise(F.concat("turn", F.lit(".5")))
    cell = lambda row, col, value: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), value.alias("value"))
    cells = c.select(F.col("conv_id").alias("sheet"), F.explode(F.array(cell(F.col("turn") * 2, 1, number), cell(F.col("turn") * 2 + 1, 3, F.col("text")))).alias("c")).select("sheet", "c.*")
    return study.answers_below(cells, 1, 3)


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS question, regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1) AS answers, regexp_extract_all(html, '<a[^>]* href="[^"]*"[^>]*>([^<]*)</a>', 1) AS names FROM pages)
SELECT page_id, question, len(answers) AS n_answers, list_aggregate(list_filter(names, lambda x, i: list_position(names, x) = i), 'string_agg', '; ') AS authors FROM p""")
def a20_detail_parse(spark, sf):
    """Heading, number of paragraphs and the different link texts in order of a page."""
    all_ = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    names = F.array_join(F.array_distinct(all_('<a[^>]* href="[^"]*"[^>]*>([^<]*)</a>')), "; ")
    return _t(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("question"),
        F.size(all_("(?s)<p[^>]*>(.*?)</p>")).alias("n_answers"),
        F.nullif(names, F.lit("")).alias("authors")
    )


@query("""SELECT event_id, 'k' AS needle, json_extract_string(props, '$.k') AS replacement FROM events""")
def a23_sealed_table(spark, sf):
    """Substitutions of a JSON map; keys that begin with an underscore are notes."""
    noted = F.concat(F.lit('{"_note": "x", '), F.substr("props", F.lit(2)))
    return study.sealed_entries(_t(spark, sf, "events").select("event_id", noted.alias("sealed")), "event_id", "sealed")


@query("""SELECT conv_id || ' — ' || left(text, 70) AS label, text AS question FROM conversations WHERE turn = 0""")
def a26_sample_labels(spark, sf):
    first = _t(spark, sf, "conversations").filter("turn = 0")
    return first.select(F.concat("conv_id", F.lit(" — "), F.substring("text", 1, 70)).alias("label"), F.col("text").alias("question"))


# folders


@query("""SELECT l_returnflag || '-' || l_linestatus AS config_id, count(*) AS n, true AS filled FROM lineitem GROUP BY 1""")
def a12_discovery(spark, sf):
    """Configurations found by the folders that hold their files, from a listing; then every row of what was found is read and counted."""
    at = _written(spark, "configs")
    li = _t(spark, sf, "lineitem").select(F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("config_id"), "l_orderkey")
    tables.write_partitioned(li, at, "config_id")
    name = F.url_decode(F.replace(F.regexp_extract("folder", "config_id=(.+)", 1), F.lit("+"), F.lit("%2B")))  # as Spark escapes a folder's name
    found = tables.discover(spark, at, "*.parquet").groupBy(F.nullif(name, F.lit("__HIVE_DEFAULT_PARTITION__")).alias("config_id")).agg((F.sum("n_bytes") > 0).alias("filled"))
    rows = spark.read.schema("l_orderkey long, config_id string").parquet(at).groupBy(F.col("config_id").alias("id")).agg(F.count("*").alias("n"))
    return found.join(rows, F.col("config_id").eqNullSafe(F.col("id")), "left").select("config_id", F.coalesce("n", F.lit(0)).alias("n"), "filled")


@query(r"""SELECT conv_id, md5(string_agg(trim(text), chr(10) || chr(10) ORDER BY turn)) AS digest, sum(length(trim(text)))::BIGINT + 2 * (count(*) - 1) AS n_chars FROM conversations GROUP BY conv_id""")
def b3_canonical_text(spark, sf):
    """The parts of a unit in order, two line feeds between them: the text that all offsets refer to."""
    whole = reports.joined_in_order(_t(spark, sf, "conversations"), "conv_id", "turn", F.btrim("text"), "\n\n", "t")
    return whole.select("conv_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))


@query("""SELECT role AS section_role, count(*) AS n, min(CASE WHEN role = 'user' THEN turn ELSE -1 END) AS first_start FROM conversations GROUP BY role""")
def b4_segment_tables(spark, sf):
    """Retained and dropped segments as one table with a folder a role; dropped ones have no offsets (E15)."""
    at = _written(spark, "segments")
    c = _t(spark, sf, "conversations").select(F.col("role").alias("section_role"), F.when(F.col("role") == "user", F.col("turn")).otherwise(-1).alias("char_start"))
    tables.write_partitioned(c, at, "section_role")
    back = spark.read.schema("char_start long, section_role string").parquet(at)
    return back.groupBy("section_role").agg(F.count(F.lit(1)).alias("n"), F.min("char_start").alias("first_start"))


@query("""SELECT vec_id, label, len(embedding) AS dim FROM embeddings""")
def b6_index_save_load(spark, sf):
    """Vectors and ids saved under an index's folder and read back."""
    at = _written(spark, "index")
    v = _t(spark, sf, "embeddings")
    tables.write_partitioned(v.select("vec_id", "embedding", F.col("label").alias("index_id")), at, "index_id")
    return spark.read.schema(f"vec_id long, embedding {v.schema['embedding'].dataType.simpleString()}, index_id {v.schema['label'].dataType.simpleString()}").parquet(at).select(
        "vec_id",
        F.col("index_id").alias("label"),
        F.size("embedding").alias("dim")
    )


@query("""SELECT o_orderkey::VARCHAR AS id, c_mktsegment AS stratum, n_name AS unit FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def b9_bom_export(spark, sf):
    """A joined study table as CSV that begins with a byte order mark, as a reader gets it back."""
    at = _written(spark, "export")
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey")).join(_t(spark, sf, "customer"), "c_custkey")
    o = o.join(_t(spark, sf, "nation"), o["c_nationkey"] == F.col("n_nationkey")).select(F.col("id").cast("string"), F.col("c_mktsegment").alias("stratum"), F.col("n_name").alias("unit"))
    tables.write_csv_with_bom(o, at)
    return tables.read_csv(spark, at, "id string, stratum string, unit string")


# segments


@query("""SELECT event_type AS unit, row_number() OVER (ORDER BY min(event_id)) AS place, count(*) AS n_pages FROM events GROUP BY event_type""")
def e1_units_in_order(spark, sf):
    """Units in the order in which they are first seen; one row a unit is ordered."""
    return reports.units_in_order(_t(spark, sf, "events").withColumnRenamed("event_type", "unit"), "unit", "event_id").select("unit", "place", F.col("n").alias("n_pages"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line_no FROM documents), s AS (SELECT *, regexp_replace(line, '^[\s•*-]+', '') AS bare FROM l)
SELECT doc_id, line_no, CASE WHEN starts_with(bare, 'The') THEN 'The' WHEN starts_with(bare, 'An') THEN 'An' ELSE 'Der' END AS marker FROM s WHERE starts_with(bare, 'The') OR starts_with(bare, 'An') OR starts_with(bare, 'Der')""")
def e6_marker_hits(spark, sf):
    """Lines that begin with a curated marker once bullets are stripped; the first marker of the list counts."""
    lines = _t(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), tx.leading_marker(F.col("line"), ["The", "An", "Der"]).alias("marker")).filter("marker is not null")


@query("""WITH t AS (SELECT conv_id, turn::DOUBLE AS ord, role AS content_type FROM conversations), f AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') + 0.5 AS ord, 'figure' AS content_type FROM conversations GROUP BY conv_id)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS place, content_type FROM (SELECT * FROM t UNION ALL SELECT * FROM f WHERE ord IS NOT NULL)""")
def e9_figures(spark, sf):
    """A transcribed figure goes behind the last clinical segment of its unit."""
    t = _t(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("content_type"))
    return reports.with_figures(t, t.select("conv_id"), "conv_id", "ord", "content_type", "user", "figure")


# indexes


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND role <> '' THEN role || chr(10) || text ELSE text END AS input FROM conversations""")
def g1_encoder_input(spark, sf):
    """The heading path in front of a chunk's text where the configuration is enriched and there is one."""
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.encoder_input(F.col("turn") % 2 == 0, F.col("role"), F.col("text")).alias("input"))


@query("""SELECT label AS index_id, count(*) AS n_vectors, count(DISTINCT vec_id) AS n_ids, max(len(embedding)) AS dim, count(DISTINCT len(embedding)) = 1 AS one_dim, count(*) = count(DISTINCT vec_id) AS unique_ids, count(*) * max(len(embedding)) * 4 AS flat_bytes FROM embeddings GROUP BY label""")
def g7_index_checks(spark, sf):
    """What an index must hold before it is built (one dimension, as many ids as vectors), and its flat size (G10)."""
    return study.index_record(_t(spark, sf, "embeddings").withColumnRenamed("label", "index_id"), ["index_id"], "vec_id", "embedding")


@query("""SELECT s.lang AS config_id, m.l_returnflag AS model_id, s.n * m.n AS cells FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) s CROSS JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag) m""")
def h21_grid(spark, sf):
    """Configurations times models: two tables of a row a name."""
    s = _t(spark, sf, "documents").groupBy(F.col("lang").alias("config_id")).agg(F.count(F.lit(1)).alias("n"))
    m = _t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model_id")).agg(F.count(F.lit(1)).alias("m"))
    return s.crossJoin(m).select("config_id", "model_id", (F.col("n") * F.col("m")).alias("cells"))


@query("""SELECT n AS name, count(event_id) AS n, count(event_id) = 0 AS unknown FROM (VALUES ('click'), ('error'), ('nothing')) v(n) LEFT JOIN events ON event_type = n GROUP BY n""")
def c6_restricted_grid(spark, sf):
    """A grid cut to the names asked for; names that are not there are reported."""
    return study.restricted(_t(spark, sf, "events"), "event_type", ["click", "error", "nothing"])


_WORDS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


@query(f"""WITH q AS (SELECT conv_id, turn, len(regexp_extract_all(text, '{_WORDS}')) AS n_tokens, len(regexp_extract_all('query: ' || text, '{_WORDS}')) + 2 AS n_input FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT *, n_input > 32 AS over_cap FROM q""")
def t20_query_tokens(spark, sf):
    """Tokens of a query with prefix and special tokens, and whether they are above the cap."""
    asked = _t(spark, sf, "conversations").filter("role = 'user' AND text IS NOT NULL").select("conv_id", "turn", "text")
    return chunk.query_tokens(asked, "query: ", 2, 32, "words").drop("text")


@query(rf"""WITH t AS (SELECT lang, length(coalesce(text, '')) AS chars, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS words, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS blanks FROM documents)
SELECT lang, sum(words)::BIGINT AS words_tokens, sum(blanks)::BIGINT AS blanks_tokens, round(sum(chars) / sum(words), 3) AS chars_per_words_token, round(sum(chars) / sum(blanks), 3) AS chars_per_blanks_token,
sum((words + 255) // 256)::BIGINT AS words_chunks, sum((blanks + 255) // 256)::BIGINT AS blanks_chunks FROM t GROUP BY lang""")
def f20_tokenizers(spark, sf):
    """Corpus tokens, characters a token and chunks of 256 tokens under two tokenizers."""
    return chunk.compare_tokenizers(_t(spark, sf, "documents").select("lang", "text"), "lang", ["words", "blanks"], 256)


# study tables


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS influence, lower(trim(' ' || o_orderstatus || ' ')) IN ('f', 'true', '1', '1.0', 'yes') AS verdict FROM orders""")
def c16_ordinals(spark, sf):
    """Categories to numbers by a dictionary, null where it has none; verdict words to true or false (C17)."""
    o = _t(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        tx.ordinal(F.col("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}).alias("influence"),
        tx.verdict_is(F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")), ["f", "true", "1", "1.0", "yes"]).alias("verdict")
    )


@query("""WITH c AS (SELECT l_returnflag, l_orderkey, round(avg(l_discount * 20), 6) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(*) AS n, avg((m < 1)::INT) AS fail_rate FROM c GROUP BY l_returnflag""")
def j9_fail_rate(spark, sf):
    """Share of cases whose mean over raters is below 1: the case is the unit."""
    return reports.fail_rate(_t(spark, sf, "lineitem"), "l_returnflag", "l_orderkey", F.col("l_discount") * 20, 1)


@query("""SELECT lang, count(*) AS expected, count(l.doc_id) AS scored, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY lang""")
def j17_coverage(spark, sf):
    return reports.coverage(_t(spark, sf, "documents").select("doc_id", "lang"), _t(spark, sf, "labels"), "doc_id", "lang")


@query("""SELECT l_linenumber AS kind, round(avg(l_tax), 6) AS score, row_number() OVER (ORDER BY round(avg(l_tax), 6) DESC, l_linenumber) AS place FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_linenumber""")
def j21_extract(spark, sf):
    """One index's means by type, best first; a row a type is ordered."""
    return reports.means_in_order(_t(spark, sf, "lineitem").filter("l_returnflag = 'A'").withColumnRenamed("l_linenumber", "kind"), "kind", "l_tax")


_RATER = """r AS (SELECT o_custkey % 12 AS rater, o_orderstatus AS condition, o_totalprice / 1000 AS v, o_orderpriority AS block FROM orders)"""


def _ratings(spark, sf):
    return _t(spark, sf, "orders").select(
        (F.col("o_custkey") % 12).alias("rater"),
        F.col("o_orderstatus").alias("condition"),
        (F.col("o_totalprice") / 1000).alias("v"),
        F.col("o_orderpriority").alias("block"),
        "o_custkey"
    )


@query(f"""WITH {_RATER} SELECT rater, round(avg(v), 6) AS mean, round(avg(v) FILTER (WHERE condition = 'F') - avg(v) FILTER (WHERE condition = 'O'), 6) AS benefit FROM r GROUP BY rater""")
def j22_rater_benefit(spark, sf):
    r = reports.rater_benefit(_ratings(spark, sf), "rater", "condition", "v", "F", "O")
    return r.select("rater", F.round("mean", 6).alias("mean"), F.round("benefit", 6).alias("benefit"))


@query(f"""WITH {_RATER}, b AS (SELECT block, quantile_cont(v, 0.5) FILTER (WHERE condition = 'F') - quantile_cont(v, 0.5) FILTER (WHERE condition = 'O') AS gap FROM r GROUP BY block), base AS (SELECT quantile_cont(v, 0.5) FILTER (WHERE condition = 'F') - quantile_cont(v, 0.5) FILTER (WHERE condition = 'O') AS gap FROM r)
SELECT block, round(b.gap, 4) AS gap, round(b.gap - base.gap, 4) AS beyond_baseline FROM b, base""")
def k18_block_decomposition(spark, sf):
    """A block's difference of medians, and what is left of it beyond that of all blocks."""
    return study.block_decomposition(_ratings(spark, sf), "block", "condition", "v", "F", "O").select("block", F.round("gap", 4).alias("gap"), F.round("beyond_baseline", 4).alias("beyond_baseline"))


@query(f"""WITH {_RATER}, d AS (SELECT block, round(avg(v), 6) AS mean, count(*) AS n FROM r GROUP BY block), w AS (SELECT block, CASE WHEN block = '1-URGENT' THEN mean + 1 ELSE mean END AS mean, CASE WHEN block = '5-LOW' THEN n + 1 ELSE n END AS n FROM d WHERE block <> '2-HIGH')
SELECT d.block, CASE WHEN w.block IS NULL THEN 'not recorded' WHEN abs(w.mean - d.mean) > 1e-9 THEN 'mean differs' ELSE 'n differs' END AS problem FROM d LEFT JOIN w USING (block) WHERE w.block IS NULL OR abs(w.mean - d.mean) > 1e-9 OR w.n <> d.n""")
def k21_rederivation(spark, sf):
    """Recorded results against the ones derived anew: a list of problems."""
    d = _ratings(spark, sf).groupBy("block").agg(F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    recorded = d.filter("block <> '2-HIGH'").select(
        "block",
        (F.col("mean") + F.when(F.col("block") == "1-URGENT", 1).otherwise(0)).alias("mean"),
        (F.col("n") + F.when(F.col("block") == "5-LOW", 1).otherwise(0)).alias("n")
    )
    return study.rederived(recorded, d, "block", ["mean", "n"])


@query(f"""WITH c AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS gap, avg(extract('month' FROM o_orderdate)) FILTER (WHERE o_orderstatus = 'F') - avg(extract('month' FROM o_orderdate)) FILTER (WHERE o_orderstatus = 'O') AS confidence FROM orders GROUP BY o_custkey),
k AS (SELECT rank() OVER (ORDER BY gap) + (count(*) OVER (PARTITION BY gap) - 1) / 2.0 AS a, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 AS b FROM (SELECT round(gap, 4) AS gap, round(confidence, 6) AS confidence FROM c WHERE gap IS NOT NULL AND confidence IS NOT NULL)) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM k""")
def k22_confidence_gap(spark, sf):
    """Rank correlation over cases of two differences between conditions: rating and confidence."""
    return reports.gap_correlation(_t(spark, sf, "orders"), "o_custkey", "o_orderstatus", F.col("o_totalprice"), F.month("o_orderdate"), "F", "O")


@query("""SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS likert, arg_min(value, event_id) FILTER (WHERE value BETWEEN 0 AND 10) AS first_0_10, count(*) FILTER (WHERE contains(event_type, 'ur')) AS section_rows FROM events GROUP BY user_id""")
def k23_exit_form(spark, sf):
    """A questionnaire a rater: mean of the rated items, first answer from 0 to 10, rows of one section."""
    r = reports.exit_form(_t(spark, sf, "events"), "user_id", "event_id", "value", F.col("event_type") == "click", 0, 10, F.contains("event_type", F.lit("ur")))
    return r.select("user_id", F.round("likert", 6).alias("likert"), F.col("first_in_range").alias("first_0_10"), "section_rows")


_HELD = f"""s AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality ORDER BY {_DRAW.format(seed='study', key='doc_id')}, doc_id) AS k FROM labels)"""


@query(f"""WITH {_HELD} SELECT doc_id, quality, toxic, toxic = 1 AND k > 8 AS by_risk, CASE WHEN k % 2 = 1 THEN 'r1' ELSE 'r2' END AS rater, CASE WHEN k % 2 = 1 THEN 'with-without' ELSE 'without-with' END AS crossover FROM s WHERE k <= 8 OR toxic = 1""")
def l6_freeze(spark, sf):
    """A stratified draw with all risk cases beside it, dealt to raters and orders."""
    labels = _t(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return study.freeze(labels, ["quality"], 8, F.col("toxic") == 1, tx.draw_order("study", F.col("doc_id")), "doc_id")


@query(f"""WITH {_HELD} SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format(seed='held', key='doc_id')}, doc_id) AS k FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE k <= 8 OR toxic = 1)) WHERE k <= 30""")
def l9_held_out(spark, sf):
    """A draw that shares no case with the study's."""
    return reports.held_out(_t(spark, sf, "labels").select("doc_id"), l6_freeze(spark, sf), "doc_id", tx.draw_order("held", F.col("doc_id")), 30)


@query("""SELECT c_name, regexp_extract(c_name, '(\\d+)$', 1)::BIGINT AS number, (c_acctbal > 0)::INT AS positive FROM customer WHERE c_mktsegment = 'BUILDING'""".replace("\\\\", "\\"))
def m2_numeric_suffix(spark, sf):
    """Records of one keyword in the order of the number their id ends with (T22)."""
    c = _t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_name", (F.col("c_acctbal") > 0).cast("int").alias("positive"))
    return reports.by_numeric_suffix(c, "c_name")


@query("""SELECT verdict, count(*) AS n, verdict NOT IN ('accept', 'revise', 'reject') AS fatal FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'accept' WHEN '2-HIGH' THEN 'revise' WHEN '3-MEDIUM' THEN 'reject' WHEN '5-LOW' THEN 'todo' ELSE 'unknown' END AS verdict FROM orders) GROUP BY verdict""")
def n5_verdict_counts(spark, sf):
    """Verdicts of a worksheet; what is still to do or unknown is fatal."""
    verdict = tx.ordinal(F.col("o_orderpriority"), {"1-URGENT": "accept", "2-HIGH": "revise", "3-MEDIUM": "reject", "5-LOW": "todo"})
    return reports.verdict_counts(_t(spark, sf, "orders"), verdict, ["accept", "revise", "reject"])


@query(r"""WITH w AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+')) AS n FROM conversations) SELECT conv_id, turn, unnest(list_filter([CASE WHEN n < 15 OR n > 35 THEN 'words outside of 15 to 35' END, CASE WHEN turn > 4 THEN 'long session' END, CASE WHEN (turn % 2 = 0) <> (n % 2 = 0) THEN 'cells disagree' END], lambda x: x IS NOT NULL)) AS problem FROM w""")
def n7_quality_lists(spark, sf):
    """Lists of doubtful rows: lengths, durations, cells that contradict each other."""
    n = F.regexp_count("text", F.lit(r"\S+"))
    w = _t(spark, sf, "conversations").select("conv_id", "turn", n.alias("n"))
    checks = [((F.col("n") < 15) | (F.col("n") > 35), "words outside of 15 to 35"), (F.col("turn") > 4, "long session"), ((F.col("turn") % 2 == 0) != (F.col("n") % 2 == 0), "cells disagree")]
    named = w.withColumn("key", F.struct("conv_id", "turn"))
    return study.problems(named, "key", checks).select("key.conv_id", "key.turn", "problem")


@query("""SELECT conv_id, left(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 250) AS preview FROM conversations GROUP BY conv_id""")
def o9_preview(spark, sf):
    whole = reports.joined_in_order(_t(spark, sf, "conversations"), "conv_id", "turn", F.concat("role", F.lit(": "), "text"), "\n", "preview")
    return whole.select("conv_id", F.substring("preview", 1, 250).alias("preview"))


@query("""SELECT conv_id, turn, CASE WHEN turn * 5 NOT BETWEEN 1 AND 20 THEN 'k outside of 1 to 20' WHEN trim(CASE WHEN conv_id % 4 = 0 THEN '  ' ELSE text END) = '' THEN 'blank question' ELSE 'ok' END AS status FROM conversations""")
def o16_validation(spark, sf):
    q, k = F.when(F.col("conv_id") % 4 == 0, "  ").otherwise(F.col("text")), F.col("turn") * 5
    return _t(spark, sf, "conversations").select("conv_id", "turn", tx.request_status(k, q, 20).alias("status"))


# study figures and packets


_LINES3 = """li AS (SELECT l_suppkey AS item, l_returnflag AS system, avg(l_discount) AS v FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {_LINES3}, w AS (SELECT system, avg(v) AS m FROM li GROUP BY system), best AS (SELECT max_by(system, (round(m, 9), system)) AS system FROM w), p AS (SELECT b.item, o.system, o.v - b.v AS d FROM li b JOIN best USING (system) JOIN li o ON o.item = b.item AND o.system <> b.system)
SELECT system, count(*) AS n, round(avg(d), 9) AS mean_diff, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down FROM p GROUP BY system""")
def t3_paired_lines(spark, sf):
    """Every system against the winner over the items that both have."""
    li = _t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("system")).agg(F.avg("l_discount").alias("v"))
    return study.against_winner(li, "system", "item", "v").withColumn("mean_diff", F.round("mean_diff", 9))


@query("""WITH j AS (SELECT doc_id, (n_chars % 100) / 100.0 AS a, (quality + toxic) / 2.0 AS b FROM documents JOIN labels USING (doc_id) WHERE doc_id % 13 <> 5 AND n_chars IS NOT NULL), k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y, a, b FROM j)
SELECT count(*) AS n, round(avg(a)::DOUBLE, 6) AS mean_a, round(avg(b)::DOUBLE, 6) AS mean_b, round(corr(x, y), 6) AS rho FROM k""")
def t7_agreement(spark, sf):
    """Two scores joined on the id, without the rows of an exclusion list: means and rank correlation."""
    j = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id").filter(F.col("doc_id") % 13 != 5)
    return reports.agreement(j, F.col("n_chars") % 100 / 100, (F.col("quality") + F.col("toxic")) / 2)


@query(f"""WITH {_RATER} SELECT rater, count(*) AS n, count(*) FILTER (WHERE block = '1-URGENT') AS influenced, list_sort(list(DISTINCT floor(v / 50)::BIGINT)) AS helpfulness, round(avg(v) FILTER (WHERE condition = 'F'), 4) AS words_with, round(avg(v) FILTER (WHERE condition = 'O'), 4) AS words_without FROM r GROUP BY rater""")
def t8_process(spark, sf):
    """A rater's levels of helpfulness, counts of influence and words by condition."""
    level = F.floor(F.col("v") / 50).cast("long")
    r = reports.process(_ratings(spark, sf), "rater", "condition", "v", "F", "O", F.col("block") == "1-URGENT", level)
    mean = lambda c, name: F.round(c, 4).alias(name)
    return r.select("rater", "n", "influenced", F.col("levels").alias("helpfulness"), mean("mean_first", "words_with"), mean("mean_second", "words_without"))


_LIST = """w AS (SELECT o_custkey % 12 AS rater, o_orderkey AS response, row_number() OVER (PARTITION BY o_custkey % 12 ORDER BY o_orderdate, o_orderkey) AS position FROM orders)"""


@query(f"""WITH {_LIST} SELECT rater, position, response, o_orderstatus AS condition, o_custkey AS case_id, o_custkey % 5 = 0 AS shared FROM w JOIN orders ON o_orderkey = response""")
def t12_worklists(spark, sf):
    """Worklists read with their positions (T11), the blind key decoded and shared cases marked."""
    placed = study.worklists(_t(spark, sf, "orders"), F.col("o_custkey") % 12, ["o_orderdate", "o_orderkey"], F.col("o_custkey") % 5 == 0)
    return placed.select("rater", "position", F.col("o_orderkey").alias("response"), F.col("o_orderstatus").alias("condition"), F.col("o_custkey").alias("case_id"), "shared")


@query("""SELECT o_custkey AS case_id, count(*) AS n_contexts, count(*) FILTER (WHERE o_totalprice > 200000) AS n_full, count(*) FILTER (WHERE o_totalprice <= 200000) AS n_light, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS packet FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY o_custkey""")
def t14_packets(spark, sf):
    """One packet a case of the first population: its contexts in order, full and light ones counted."""
    o = _t(spark, sf, "orders").join(_t(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    body = F.md5(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ","))
    return o.groupBy(F.col("o_custkey").alias("case_id")).agg(
        F.count(F.lit(1)).alias("n_contexts"),
        F.count_if(F.col("o_totalprice") > 200000).alias("n_full"),
        F.count_if(F.col("o_totalprice") <= 200000).alias("n_light"),
        body.alias("packet")
    )


@query("""SELECT conv_id, '## ' || conv_id || ' (p. ' || CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END || ', viewer ' || CASE WHEN a = b THEN (a + 12)::VARCHAR ELSE (a + 12) || '–' || (b + 12) END || ')' AS header FROM (SELECT conv_id, min(turn) AS a, max(turn) // 2 AS b FROM conversations GROUP BY conv_id)""")
def t16_passage_header(spark, sf):
    """Printed and viewer page ranges; a range of one page is one number."""
    p = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("a"), F.floor(F.max("turn") / 2).alias("b"))
    return p.select(
        "conv_id",
        F.concat(
            F.lit("## "),
            "conv_id",
            F.lit(" (p. "),
            tx.page_range(F.col("a"), F.col("b")),
            F.lit(", viewer "),
            tx.page_range(F.col("a") + 12, F.col("b") + 12),
            F.lit(")")
        ).alias("header")
    )


QUERIES, ORACLES = Q, O
