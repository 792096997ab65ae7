"""URL filters: host and path rules, and regular-expression rules that are indexed by their rarest literal token.

A pattern rule's literal tokens follow from its regular expression: runs of letters and digits that every URL it matches
holds, as whole tokens where the pattern says so, else as pieces of GRAM characters. The rarest of them in the table at
hand indexes the rule; a URL's tokens and pieces fetch candidate rules by an equality join, and only those run their
regular expression. Host rules work alike: the domains that a host ends in are looked up, and the longest rule wins.

Defined results: a null URL, or one without ://, has an empty host and path, fits no host rule and no pattern; of host
rules of one length the last in code point order wins; repeated rows each get their result; very long URLs are read
whole; an empty table gives an empty result; other columns, whatever their names, are left out. A pattern without a
literal of GRAM letters or digits, or a whole token, is refused.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SMALL, UPPER, ascii_lower, join_hot, materialize, table


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """Blocks URLs that `pattern` matches, letters in lower case."""

    pattern: str

    @property
    def keys(self) -> frozenset[str]:
        """What each match holds: whole tokens, and pieces (marked by a leading ~) of literals that may be parts of longer tokens."""
        whole, pieces = set(), set()
        for run in _literals(self.pattern):
            for m in re.finditer(TOKEN, run):
                if 0 < m.start() and m.end() < len(run):
                    whole.add(m[0])
                pieces |= {"~" + m[0][i : i + GRAM] for i in range(len(m[0]) - GRAM + 1)}
        if not whole | pieces:
            raise ValueError(f"no literal to index {self.pattern!r} by")
        return frozenset(whole | pieces)


def _literals(pattern: str) -> list[str]:
    """The literal runs that each match of the pattern holds: what is left of it outside groups, classes and optional parts."""
    flat = re.sub(r"\[(?:\\.|[^\]\\])*\]", "\0", pattern)  # classes
    while "(" in flat.replace(r"\(", ""):  # groups, from the inside
        less = re.sub(r"(?<!\\)\((?:\\.|[^()\\])*\)", "\0", flat)
        if less == flat:
            break
        flat = less
    if "|" in flat.replace(r"\|", ""):
        return []
    flat = re.sub(r"(?:\\.|[^\\])(?:[*?]|\{0?,\d*\})", "\0", flat)  # what may be missing
    flat = re.sub(r"[+]|\{\d+(?:,\d*)?\}", "\0", flat)
    flat = re.sub(r"\\[A-Za-z]|(?<!\\)[.^$]", "\0", flat)
    return [x.replace("\\", "") for x in flat.split("\0") if x]


HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
#: Fixed lists that the pattern rules are made from: names of spam hosts, of query parameters that mark feeds and
#: sessions, of pages that no text is on, and of files that are not text.
SPAM_WORDS = "casino poker roulette jackpot betting lottery viagra cialis pharmacy payday forex dating escort xxx porn camgirls warez torrent keygen replica".split()
SPAM_PAIRS = "spam-farm cheap-pills free-gift fast-loan quick-money work-home miracle-cure weight-loss".split()
FEEDS = "utm_source=feed utm_medium=rss phpsessid jsessionid sessionid replytocom add-to-cart orderby gclid fbclid".split()
NO_TEXT = "wp-login wp-admin cgi-bin xmlrpc checkout signin register password-reset shopping-cart search-results".split()
FILES = "exe apk msi dmg iso zip rar torrent mp3 mp4 avi".split()
TOKEN, GRAM = r"[a-z0-9]+", 3
PATTERN_RULES = (
    *(PatternRule(rf"^https?://([a-z0-9-]+\.)*{w}[a-z0-9-]*\.") for w in SPAM_WORDS),
    *(PatternRule(rf"^https?://([a-z0-9-]+\.)*{re.escape(w)}\.") for w in SPAM_PAIRS),
    *(PatternRule(rf"[?&]{re.escape(w)}(=|&|#|$)") for w in FEEDS),
    *(PatternRule(rf"^https?://[^?#]*/{re.escape(w)}(\.php)?([/?#]|$)") for w in NO_TEXT),
    *(PatternRule(rf"^https?://[^?#]+\.{w}([?#]|$)") for w in FILES),
    PatternRule(r"^https?://m\.[^/?#]+/[a-z]{2}/[0-9]+\.html?$"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)



def host_verdicts(rows: DataFrame, rules: Sequence[HostRule] = HOST_RULES) -> DataFrame:
    """Add `rule` and `rule_verdict` of the longest rule that fits. The rules, a list in the program, are its only bound;
    they become a map from host to its rules, and a row looks up each domain that its host ends in."""
    by_host: dict[str, list[HostRule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_verdict", F.lit(None).cast("string"))
    entry = lambda r: F.struct(F.lit(len(r.name)).alias("n"), F.lit(r.name).alias("name"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict"))
    index = F.map_from_arrays(F.array(*map(F.lit, by_host)), F.array(*[F.array(*map(entry, rs)) for rs in by_host.values()]))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(domains, lambda d: F.try_element_at(index, d)), lambda x: x.isNotNull())), lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(fits)
    return rows.withColumn("__best", best).withColumn("rule", F.col("__best.name")).withColumn("rule_verdict", F.col("__best.verdict")).drop("__best")


def pattern_hits(urls: DataFrame, rules: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """(key) of the rows of `urls` (key, url) that some pattern rule matches.

    Tokens and pieces that no rule names are left before they are counted, so that the count has as many rows as the
    rules have keys, and the index one row for each rule.
    """
    spark = urls.sparkSession
    if not rules:
        return urls.select("key").limit(0)
    lower = urls.select("key", ascii_lower(F.col("url")).alias("url"))
    named = F.array(*map(F.lit, sorted(set().union(*(r.keys for r in rules)))))
    pieces = F.transform(F.regexp_extract_all("url", F.lit(f"(?=([a-z0-9]{{{GRAM}}}))"), F.lit(1)), lambda p: F.concat(F.lit("~"), p))
    held = F.array_intersect(F.concat(F.regexp_extract_all("url", F.lit(TOKEN), F.lit(0)), pieces), named)
    tokens = materialize(lower.select("key", "url", F.explode(held).alias("token")), "tokens")
    seen = dict(tokens.groupBy("token").count().collect())
    index = spark.createDataFrame([(min(r.keys, key=lambda t: (seen.get(t, 0), t)), r.pattern) for r in rules], "token string, pattern string")
    index = F.broadcast(index) if len(rules) <= SMALL else index
    return tokens.join(index, "token").where(F.rlike(F.col("url"), F.col("pattern"))).select("key").distinct()


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: Sequence[HostRule] = HOST_RULES, pattern_rules: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """(id, host, path, rule, verdict): the verdict of the longest host rule; else block if a pattern rule matches, else allow.

    Rows with one URL share its verdict, so the tokens and regular expressions run once for each distinct URL.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    judged = host_verdicts(rows, host_rules)
    undecided = F.col("rule").isNull() & (F.col("host") != "")
    distinct = judged.where(undecided).groupBy("url").agg(F.count("*").alias("n"))
    bad = pattern_hits(distinct.select(F.col("url").alias("key"), "url"), pattern_rules).select(F.col("key").alias("bad"))
    verdicts = distinct.join(bad, distinct["url"] == bad["bad"], "left").select("url", "n", F.when(F.col("bad").isNotNull(), "block").otherwise("allow").alias("verdict"))
    decided = judged.where(~undecided).select("id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"))
    rest = join_hot(judged.where(undecided).select("id", "url", "host", "path", "rule"), materialize(verdicts, "verdicts"), "url").select("id", "host", "path", "rule", "verdict")
    return decided.unionByName(rest).withColumnRenamed("id", id_col)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in HOST_RULES)
_BLOCKED = " OR ".join(f"regexp_matches(lower_url, '{r.pattern}')" for r in PATTERN_RULES)
OP10_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_RULES}),
parts AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS lower_url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, lower_url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
best AS (SELECT page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY page_id)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, CASE WHEN s.host <> '' AND ({_BLOCKED}) THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN best b USING (page_id)
"""
