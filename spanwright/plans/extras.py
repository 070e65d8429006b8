"""Further queries: block order, repairs, reply parsing, audits, allocation and comparison joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.operators import study
from spanwright.plans.retrieval import _t
from spanwright.plans.study import ORACLES as _STUDY_SQL
from spanwright.plans.texts import _WRAPPED

Q, O = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_quantity / 7, 0), round_even(l_extendedprice / 1000, 0), l_linenumber) AS block_no FROM lineitem WHERE l_discount > 0.01""")
def a2_reading_order(spark, sf):
    """Blocks of a page in reading order: rounded top, rounded left (half to even)."""
    w = Window.partitionBy("l_orderkey").orderBy(F.bround(F.col("l_quantity") / 7), F.bround(F.col("l_extendedprice") / 1000), "l_linenumber")
    return _t(spark, sf, "lineitem").filter("l_discount > 0.01").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("block_no"))


@query("""SELECT o_orderkey AS id, o_orderstatus AS meta_status, o_orderpriority AS meta_priority, o_custkey AS param_customer FROM orders""")
def c1_flatten(spark, sf):
    """Nested metadata and parameters as prefixed columns."""
    o = _t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("meta"),
        F.struct(F.col("o_custkey").alias("customer")).alias("param")
    )
    return o.select("id", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("meta", "param") for f in o.schema[s].dataType.names])


@query(rf"""WITH {_WRAPPED} SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(shown, '') END AS shown FROM documents LEFT JOIN (
SELECT doc_id, string_agg(CASE WHEN p IS NULL THEN x WHEN NOT item AND NOT regexp_matches(p, '[.;:?!]$') AND regexp_matches(x, '^[\p{{Ll}}0-9]') THEN ' ' || x ELSE chr(10) || x END, '' ORDER BY i) AS shown FROM j GROUP BY doc_id) USING (doc_id)""")
def d9_display_reflow(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.display_reflow(F.split("text", "\n")).alias("shown"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(text, '. ', '.'), '(\p{Ll}[.!?])(\p{Lu})', '\1 \2', 'g'), '[ \t]{2,}', ' ', 'g'))) AS digest FROM documents""")
def d11_readability(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(tx.readable(F.replace("text", F.lit(". "), F.lit(".")))).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def d12_mojibake(spark, sf):
    """Texts spoiled by a wrong decoding come back as they were."""
    spoiled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return _t(spark, sf, "documents").select("doc_id", F.md5(tx.fix_mojibake(F.when(F.col("text").rlike("[À-ÿ]"), spoiled).otherwise(F.col("text")))).alias("digest"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '\s+', ' ', 'g')) AS plain FROM pages""")
def d13_strip_tags(spark, sf):
    return _t(spark, sf, "pages").select("page_id", tx.collapse(F.replace(F.regexp_replace("html", "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" "))).alias("plain"))


_SIGNED_OFF = "regexp_replace(text, '[A-Z]', 'x', 'g') || CASE turn % 3 WHEN 0 THEN ' nama saya Budi Santoso, halo' WHEN 1 THEN ' my name is Cahya. Mr. Tan, halo' ELSE ' halo' END"
_NAMED = r"\b((?:[Nn]ama saya|[Ss]aya bernama|[Dd]r\.|[Bb]apak|[Ii]bu|[Mm]y name is|[Mm]r\.|[Mm]rs\.)\s+)((?:[A-Z][\w''-]+)(?:\s+[A-Z][\w''-]+)?)"


@query(rf"SELECT conv_id, turn, regexp_replace(t, '{_NAMED}', '\1[nama]', 'g') AS text, len(regexp_extract_all(t, '{_NAMED}')) AS n FROM (SELECT conv_id, turn, {_SIGNED_OFF} AS t FROM conversations)")
def d15_redact_names(spark, sf):
    """Names after an introduction or a title are taken out of texts that are signed in three ways."""
    end = F.when(F.col("turn") % 3 == 0, " nama saya Budi Santoso, halo").when(F.col("turn") % 3 == 1, " my name is Cahya. Mr. Tan, halo").otherwise(" halo")
    r = _t(spark, sf, "conversations").select("conv_id", "turn", tx.redact_names(F.concat(F.regexp_replace("text", "[A-Z]", "x"), end)).alias("r"))
    return r.select("conv_id", "turn", "r.text", "r.n")


_BRIEF = "'## Summary' || chr(10) || text || chr(10) || '## Referral' || chr(10) || 'see [1] and [' || (turn + 1) || ']' || chr(10) || '## End'"


def _brief():
    return F.concat(F.lit("## Summary\n"), F.col("text"), F.lit("\n## Referral\nsee [1] and ["), (F.col("turn") + 1).cast("string"), F.lit("]\n## End"))


@query("SELECT conv_id, turn, 'see [1] and [' || (turn + 1) || ']' AS referral FROM conversations")
def d23_section(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", tx.section(_brief(), "Referral").alias("referral"))


@query("""SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, 'th')) AS with_th, sum(len(regexp_extract_all(text, 'the')))::BIGINT AS n_the, count(*) FILTER (WHERE NOT regexp_matches(text, '[.]$')) AS open_end FROM conversations GROUP BY role""")
def d24_audit(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.groupBy("role").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("text").rlike("th")).alias("with_th"),
        F.sum(F.regexp_count("text", F.lit("the"))).alias("n_the"),
        F.count_if(~F.col("text").rlike("[.]$")).alias("open_end")
    )


@query("""WITH c AS (SELECT conv_id, turn, turn + 1 AS n FROM conversations UNION SELECT conv_id, turn, 1 FROM conversations), x AS (SELECT conv_id, list(role ORDER BY turn) AS ctx FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.n, x.ctx[c.n] AS cited FROM c JOIN x USING (conv_id) WHERE c.n BETWEEN 1 AND len(x.ctx)""")
def g18_resolve_citations(spark, sf):
    """Markers [n] of a section resolved to the n-th context; numbers out of range are left out."""
    t = _t(spark, sf, "conversations")
    cited = t.select("conv_id", "turn", F.explode(tx.citation_numbers(tx.section(_brief(), "Referral"))).alias("n"))
    ctx = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("ctx"))
    return cited.join(ctx, "conv_id").filter((F.col("n") >= 1) & (F.col("n") <= F.size("ctx"))).select("conv_id", "turn", "n", F.element_at("ctx", F.col("n")).alias("cited"))


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS expected FROM orders WHERE o_orderstatus <> CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END""")
def h13_frozen_mismatch(spark, sf):
    e = F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O")
    return _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", e.alias("expected")).filter("o_orderstatus <> expected")


@query("""SELECT rule, judge, count(*) AS n FROM (SELECT CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS rule, CASE WHEN quality = 1 THEN 'long' ELSE 'short' END AS judge FROM documents JOIN labels USING (doc_id)) GROUP BY ALL""")
def h14_rule_against_judge(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    rule, judge = F.when(F.col("n_chars") > 1500, "long").otherwise("short"), F.when(F.col("quality") == 1, "long").otherwise("short")
    return d.groupBy(rule.alias("rule"), judge.alias("judge")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS role_f, max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS role_o, max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS role_p FROM orders GROUP BY o_custkey""")
def h19_allocation(spark, sf):
    """One row a case, a column a role."""
    p = _t(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("o_orderkey"))
    return p.select("o_custkey", *[F.col(c).alias(f"role_{c.lower()}") for c in "FOP"])


@query("""WITH x AS (SELECT n_chars > 1500 AS screen, quality = 1 AS judge FROM documents JOIN labels USING (doc_id)) SELECT count(*) FILTER (WHERE screen AND judge) AS agreed, count(*) FILTER (WHERE screen AND NOT judge) AS screen_only, count(*) FILTER (WHERE judge AND NOT screen) AS judge_only, count(*) FILTER (WHERE screen OR judge) AS in_union FROM x""")
def j11_split(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id").select((F.col("n_chars") > 1500).alias("s"), (F.col("quality") == 1).alias("j"))
    s, j = F.col("s"), F.col("j")
    return d.agg(F.count_if(s & j).alias("agreed"), F.count_if(s & ~j).alias("screen_only"), F.count_if(j & ~s).alias("judge_only"), F.count_if(s | j).alias("in_union"))


@query("""WITH c AS (SELECT user_id, avg((value > 50)::INT) AS m FROM events GROUP BY user_id) SELECT count(*) AS n_cases, count(*) FILTER (WHERE m > 0.5) AS in_scope, count(*) FILTER (WHERE m > 0 AND m < 1) AS split FROM c""")
def k24_scope(spark, sf):
    """Cases whose raters mostly say yes: the case is the unit."""
    c = _t(spark, sf, "events").groupBy("user_id").agg(F.avg((F.col("value") > 50).cast("int")).alias("m"))
    return c.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("m") > 0.5).alias("in_scope"), F.count_if((F.col("m") > 0) & (F.col("m") < 1)).alias("split"))


@query("""SELECT conv_id, turn, CASE WHEN risky THEN '[!] ' ELSE '' END || left(text, 60) || CASE WHEN length(text) > 60 THEN ' (truncated)' ELSE '' END AS answer FROM (SELECT *, turn % 3 = 0 AS risky FROM conversations WHERE role = 'assistant')""")
def o6_answer(spark, sf):
    a = _t(spark, sf, "conversations").filter("role = 'assistant'")
    return a.select(
        "conv_id",
        "turn",
        F.concat(
            F.when(F.col("turn") % 3 == 0, "[!] ").otherwise(""),
            F.substring("text", 1, 60),
            F.when(F.length("text") > 60, " (truncated)").otherwise("")
        ).alias("answer")
    )


@query("""SELECT event_id, CASE WHEN k = 0 THEN NULL ELSE round_even((k // 2) / k::DOUBLE, 3) END AS faithfulness FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def o12_judge_reply(spark, sf):
    """Supported over all claims, from the JSON inside a fenced reply; null without claims."""
    reply = F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n```"))
    k = _t(spark, sf, "events").select("event_id", tx.first_json(reply, "k bigint").getField("k").alias("k"))
    return k.select("event_id", F.bround(F.floor(F.col("k") / 2) / F.nullif("k", F.lit(0)), 3).alias("faithfulness"))


@query("""SELECT event_type, round(avg(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END), 6) AS mean, count(*) FILTER (WHERE event_id % 7 <> 0) AS n FROM events GROUP BY event_type""")
def o14_mean_without_nan(spark, sf):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    real = F.when(~F.isnan("v"), F.col("v"))
    return _t(spark, sf, "events").withColumn("v", v).groupBy("event_type").agg(F.round(F.avg(real), 6).alias("mean"), F.count(real).alias("n"))


@query("""WITH p AS (SELECT doc_id, unnest(list_filter(['all', CASE WHEN toxic = 1 THEN 'risky' END, CASE WHEN doc_id % 5 = 0 THEN 'sampled' END], lambda x: x IS NOT NULL)) AS population, quality FROM labels) SELECT population, count(*) AS n, avg(quality) AS rate FROM p GROUP BY population""")
def t5_populations(spark, sf):
    """Overlapping populations in one pass."""
    names = F.filter(F.array(F.lit("all"), F.when(F.col("toxic") == 1, "risky"), F.when(F.col("doc_id") % 5 == 0, "sampled")), lambda x: x.isNotNull())
    return _t(spark, sf, "labels").select(F.explode(names).alias("population"), "quality").groupBy("population").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("rate"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace('# ' || text || ' **b** [l](u)', '(?m)^#+\s*', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`]+', '', 'g') AS plain FROM conversations""")
def d28_plain_markdown(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", tx.plain_markdown(F.concat(F.lit("# "), "text", F.lit(" **b** [l](u)"))).alias("plain"))


@query("""WITH g AS (SELECT lang, CASE WHEN n_chars <= 500 THEN 'short' ELSE 'long' END AS kind, count(*) AS n FROM documents GROUP BY 1, 2) SELECT *, n / sum(n) OVER (PARTITION BY lang) AS share FROM g""")
def j12_shares(spark, sf):
    kind = F.when(F.col("n_chars") <= 500, "short").otherwise("long")
    g = _t(spark, sf, "documents").groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))


@query(rf"""SELECT count(*) AS n, count(*) FILTER (WHERE part <> regexp_replace(part, '^\s+|\s+$', '', 'g')) AS untrimmed FROM (SELECT substr(text, char_start + 1, char_end - char_start) AS part FROM ({_STUDY_SQL['n1_gold_split']}) JOIN benchmark USING (item_id))""")
def n2_gold_check(spark, sf):
    """Cut spans, and those whose text still has blanks at an end."""
    b = _t(spark, sf, "benchmark")
    s = study.anchored_spans(b, "item_id", "text", [". ", ", "]).join(b, "item_id")
    part = F.expr("substring(text, char_start + 1, char_end - char_start)")
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(part != tx.strip(part)).alias("untrimmed"))


QUERIES, ORACLES = Q, O
