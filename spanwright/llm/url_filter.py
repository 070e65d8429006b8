"""URL filters: rules indexed by their rarest literal token, candidates fetched by URL tokens.

Every rule has regular expressions and the literal tokens that any URL it fits must
have, which are read off its own text. The corpus decides which token of a rule is rarest; the
rule is indexed under that token alone. A URL fetches the rules under its own tokens and only
their expressions run. All of it is joins and SQL functions; URLs that repeat are judged once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import ascii_lower, without

#: Rules up to this many are broadcast to the URL side; more are joined by a shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``rank`` orders the rules that fit one URL (largest first, then ``name``).

    A rule fits if each of its expressions is found: ``host`` and ``path`` in those parts, ``url`` in
    the whole; an empty one is found anywhere.
    """

    name: str
    verdict: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool
    host: str = ""
    path: str = ""
    url: str = ""


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; longer rules win."""
    tokens = tuple(re.findall(r"[a-z0-9]+", host)) + tuple(t[:-1].lower() for t in re.findall(r"[A-Za-z0-9]+[^A-Za-z0-9]", path))
    return Rule(host + path, verdict, tokens, 1_000_000 + len(host + path), True, host=rf"(?s)^(.*\.)?{re.escape(host)}\z", path=rf"(?s)^{re.escape(path)}")


def filter_rule(line: str) -> Rule:
    """A line of the common filter syntax of ad blockers, ranked below every prefix rule.

    ``||`` is the start of a host or of one of its labels, ``|`` an end of the URL, ``^`` a separator or the
    end, ``*`` anything; letters match in both cases. ``@@`` in front allows, all else blocks; of the
    rules that fit, the longest wins. Options, comments and element rules are refused, as are
    lines without a literal token, that is, letters and digits with a delimiter at both sides.
    """
    body = line.removeprefix("@@")
    if not body or body[0] in "![" or "$" in body or "##" in body:
        raise ValueError(f"not a URL pattern: {line}")
    start, end = re.match(r"\|{0,2}", body)[0], "|" if body.endswith("|") else ""
    core = body[len(start) : len(body) - len(end)].lower()
    pieces = {"*": ".*", "^": "([^a-z0-9_.%-]|$)"}
    pattern = {"": "", "|": "^", "||": r"^[^:/?#]+://([^/?#]*\.)?"}[start] + "".join(pieces.get(c) or re.escape(c) for c in core) + ("$" if end else "")
    # a token has to end within the pattern, or the URL may go on with more letters
    fenced = (" " if start else "*") + core + (" " if end else "*")
    tokens = tuple(re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", fenced))
    return Rule(line, "allow" if line.startswith("@@") else "block", tokens, len(core), False, url=f"(?is){pattern}")


#: Default list: (verdict, host, path).
PREFIX_RULES = (
    prefix_rule("allow", "com", "/"),
    prefix_rule("block", "example.com", "/en/"),
    prefix_rule("allow", "www.example.com", "/en/"),
    prefix_rule("block", "net", "/es/"),
    prefix_rule("block", "net", "/fr/"),
)

#: Default patterns, for URLs that no prefix rule fits: mirrors of mobile sites, advertisements, trackers and gambling.
FILTER_LINES = ("||m.*.html|", "||ads.", "||adserver.", "||banner.", "||tracker.", "||pixel.", "/pixel.gif^", "/ads/", "/banner/", "||casino.", "/casino/", "@@/ads/txt/")
PATTERN_RULES = tuple(map(filter_rule, FILTER_LINES))


def url_parts(url):
    """(host, path): what follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``.

    Both are empty where the URL is null or has no ``://``.
    """
    rest = F.contains(url, F.lit("://"))
    after = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.when(rest, ascii_lower(F.regexp_extract(after, r"(?s)^[^/?#]*", 0))).otherwise("")
    path = F.when(rest, F.regexp_extract(F.regexp_replace(after, r"(?s)^[^/?#]*", ""), r"(?s)^[^?#]*", 0)).otherwise("")
    return host, path


def _tokens(subject):
    return F.array_distinct(F.regexp_extract_all(ascii_lower(subject), F.lit(r"[a-z0-9]+"), F.lit(0)))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = PREFIX_RULES + PATTERN_RULES, *, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` (a listed rule or null), ``pattern`` and ``verdict``.

    Of the rules that fit, the largest rank decides, of equal ones the larger name; without any,
    ``default`` holds. Null and malformed URLs have empty host and path, fit no prefix rule and get the
    default where no pattern fits. URLs are read whole, line feeds and all. Repeated rows are all
    judged; columns named as the new ones are replaced; an empty table stays empty. A rule without a
    literal token is refused, since nothing could fetch it.
    """
    if bare := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token: {bare}")
    spark = pages.sparkSession
    pages = without(pages, ["host", "path", "rule", "pattern", "verdict"])
    urls = pages.select(F.col(url_col).alias("url")).filter(F.col("url").isNotNull()).distinct()
    host, path = url_parts(F.col("url"))
    urls = urls.select("url", host.alias("host"), path.alias("path"))
    words = urls.select("url", "host", "path", F.explode(_tokens(F.col("url"))).alias("token"))
    rows = [(i, r.name, r.verdict, r.host, r.path, r.url, r.rank, r.listed, t) for i, r in enumerate(rules) for t in r.tokens]
    listed = spark.createDataFrame(rows, "no int, name string, verdict string, in_host string, in_path string, in_url string, rank int, listed boolean, token string")
    small = len(rules) <= BROADCAST_RULES
    sized = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    seen = words.join(sized(listed.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = (
        listed.join(sized(seen), "token", "left")
        .groupBy("no", "name", "verdict", "in_host", "in_path", "in_url", "rank", "listed")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .drop("no")
        .withColumn("token", F.col("rarest.token"))
    )
    fits = words.join(sized(index), "token").filter(F.expr("host rlike in_host and path rlike in_path and url rlike in_url"))
    best = fits.groupBy("url").agg(F.max(F.struct("rank", "name", "verdict", "listed")).alias("__best"))
    judged = pages.join(best.withColumnRenamed("url", "__url"), F.col(url_col) == F.col("__url"), "left")
    host, path = url_parts(F.col(url_col))
    return judged.select(
        *[F.col(f"`{c}`") for c in pages.columns],
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("__best.listed"), F.col("__best.name")).alias("rule"),
        F.when(~F.col("__best.listed"), F.col("__best.name")).alias("pattern"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )
