"""URL filters: pattern rules indexed by their rarest literal token, fetched by the tokens of a URL.

A rule is compiled on the driver to one regular expression and the literal tokens that every match must hold. The
index key of a rule is the token that the fewest URLs hold. URLs are reduced to distinct ones, exploded to distinct
tokens and joined with the index; only fetched rules run their regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import ascii_lower, packed, table, unpacked


@dataclass(frozen=True)
class Rule:
    """verdict 'allow' or 'block'. With a host, a host/path prefix rule; else a pattern rule.

    Patterns: `||` start of a host label, `^` an end or a character other than letter, digit, `_`, `-`, `.`, `%`;
    `*` anything; all else literal. Pattern rules ignore A-Z case; paths of host rules don't.
    """

    verdict: str
    pattern: str = ""
    host: str = ""
    path: str = ""

    @property
    def name(self) -> str:
        return self.host + self.path if self.host else self.pattern

    @property
    def regex(self) -> str:
        if self.host:
            return rf"^(?:[^/?#]*\.)?{re.escape(self.host)}{re.escape(self.path)}"
        body, head = self.pattern, ""
        if body.startswith("||"):
            body, head = body[2:], r"^(?:[^/?#]*\.)?"
        parts = {"*": ".*", "^": r"(?:[^\w.%-]|$)"}
        return "(?is)" + head + "".join(parts.get(c) or re.escape(c) for c in body)

    @property
    def tokens(self) -> list[str]:
        """Tokens that are whole in every URL that fits: bounded by a literal non-alphanumeric, an anchor or `^`."""
        text = f".{self.host}{self.path}" if self.host else self.pattern.replace("||", ".", 1)
        found = re.finditer(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", text)
        return sorted({m[0].lower() for m in found})


#: Host/path rules of the production query.
SITE_RULES = (
    Rule("allow", host="org", path="/"),
    Rule("block", host="example.org", path="/es/"),
    Rule("block", host="example.org", path="/en/1"),
    Rule("allow", host="com", path="/fr/"),
    Rule("block", host="com", path="/de/"),
)
#: Pattern rules of the production query, for URLs that no host/path rule fits: advertising and tracking hosts and paths,
#: gambling, pharmacy, adult and malware sites, and pages that hold no text of their own.
PATTERN_RULES = tuple(
    Rule("block", pattern=p)
    for p in (
        "||ads.", "||ads-", "||ad.", "||adserver.", "||tracker.", "||tracking.", "||metrics.", "||banner.", "/adclick^", "/ads/", "/banners/*.gif^", "^affiliate_id=", "/doubleclick/", "/pixel.gif^",
        "||casino.", "||casino-", "-casino.", "/casino/", "||free-bets.", "||bet-", "-bets.", "||poker-", "/poker/", "/slots/",
        "||cheap-pills.", "-pills.", "-pharmacy.", "/viagra^", "||xxx.", "||porn.", "||porn-", "/porn/", "/xxx/", "||adult-",
        "||spam-", "/phishing/", "/malware/", "||warez.", "/warez/", "/crack/*/keygen^", "||win-prize.", "-prize.", "||earn-money.", "/get-rich/",
        "*/wp-login.php^", "/wp-admin/", "/xmlrpc.php^", "/cgi-bin/", "/login^", "/signin^", "/cart/*/checkout^", "^sessionid=", "^replytocom=", "/feed/^", "/search^q=",
    )
) + tuple(Rule("allow", pattern=p) for p in ("||casino-museum.", "/login/help/*/article^", "-pills.*/leaflet/"))
#: More rules than this are joined by a shuffle.
MAX_BROADCAST_RULES = 50_000


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, target): see the module's contract; target is the lower-cased host with all that follows it."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    after = F.substr(rest, F.length(host) + 1)
    return host, F.regexp_extract(after, r"^[^?#]*", 0), F.concat(host, after)


def _tokens(target: Column) -> Column:
    """Distinct lower-case tokens."""
    return F.array_remove(F.array_distinct(F.split(ascii_lower(target), "[^a-z0-9]+")), "")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.name, r.verdict, bool(r.host), len(r.name), r.regex, r.tokens) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id long, rule string, verdict string, is_site boolean, length int, regex string, tokens array<string>")


def index_rules(spark: SparkSession, rules: list[Rule], tokens: DataFrame) -> DataFrame:
    """One row per rule that has a token: token (of its tokens that which the fewest URLs hold), regex, rank columns."""
    made = rule_table(spark, rules)
    literal = made.select("rule_id", F.explode("tokens").alias("token"))
    wanted = literal.select("token").distinct()
    counts = tokens.join(_small(wanted, len(rules)), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = literal.join(counts, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("key"))
    return made.join(ranked, "rule_id").select(F.col("key").alias("token"), "rule", "verdict", "is_site", "length", "regex")


def _small(df: DataFrame, rules: int) -> DataFrame:
    return F.broadcast(df) if rules <= MAX_BROADCAST_RULES else df


def judge(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule, pattern and verdict.

    The longest fitting host/path rule decides (of equal names the first block, else allow); else the longest fitting
    pattern rule (ties: block first); else `default`. Null URLs and URLs without `://` have empty host and path and
    get the default. Repeated URLs are judged once; rows stay as many as they are. Columns of df that bear one of the
    five names are replaced.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "pattern", "verdict")]
    host, path, target = url_parts(F.col("_url"))
    urls = df.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct().select("_url", target.alias("target")).where(F.col("target") != "")
    tokens = urls.select("_url", "target", F.explode(_tokens(F.col("target"))).alias("token"))
    indexed, free = [r for r in rules if r.tokens], [r for r in rules if not r.tokens]
    index = index_rules(spark, indexed, tokens.select("token"))
    fits = F.expr("target RLIKE regex")
    ranks = ("_url", "is_site", "length", "rule", "verdict")
    hits = tokens.join(_small(index, len(indexed)), "token").where(fits).select(*ranks)
    for i in range(0, len(free), MAX_BROADCAST_RULES):  # rules without a token run on every URL, which stays where it is
        block = rule_table(spark, free[i : i + MAX_BROADCAST_RULES]).withColumn("token", F.lit(""))
        hits = hits.unionByName(urls.withColumn("token", F.lit("")).join(F.broadcast(block), "token").where(fits).select(*ranks))
    rank = F.struct("is_site", "length", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    best = hits.groupBy("_url").agg(F.max(rank).alias("best"))
    found = df.select(packed(df, kept), F.col(url_col).alias("_url")).join(best, "_url", "left")
    return found.select(
        *unpacked(kept), host.alias("host"), path.alias("path"),
        F.when(F.col("best.is_site"), F.col("best.rule")).alias("rule"),
        F.when(~F.col("best.is_site"), F.col("best.rule")).alias("pattern"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, [*SITE_RULES, *PATTERN_RULES]).select("page_id", "host", "path", "rule", "pattern", "verdict")


def _sql() -> str:
    """The same verdicts in DuckDB: every rule against every URL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    q = lambda s: "'" + s.replace("'", "''") + "'"
    site = ", ".join(f"({q(r.host)}, {q(r.path)}, {q(r.verdict)})" for r in SITE_RULES)
    pats = ", ".join(f"({q(r.pattern)}, {q(r.regex)}, {q(r.verdict)})" for r in PATTERN_RULES)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
  substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS after FROM u),
site(rhost, rpath, v) AS (VALUES {site}), pats(pattern, regex, v) AS (VALUES {pats}),
s AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM p JOIN site ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
m AS (SELECT page_id, max_by(pattern, (length(pattern), v = 'block', pattern)) AS pattern, max_by(v, (length(pattern), v = 'block', pattern)) AS v
  FROM p JOIN pats ON regexp_matches(host || after, regex) GROUP BY page_id)
SELECT p.page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern, coalesce(s.v, m.v, 'allow') AS verdict
FROM p LEFT JOIN s ON p.page_id = s.page_id LEFT JOIN m ON p.page_id = m.page_id"""


SQL = _sql()
