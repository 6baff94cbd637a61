"""URL filters: longest-rule verdicts by hashed host-suffix and path-prefix expressions.

A rule is (verdict, host, path). It fits a URL if the URL's host is the rule's or a subdomain of it and the URL's path
starts with the rule's; of the rules that fit, the longest (host plus path; then the longer host) decides.

Distinct (host, path) pairs are expanded to the expressions that any rule could have: for each shape (number of
labels, path length) that occurs among the rules, the host's last labels and the path's first characters. Expressions
meet rules by an equi-join on the first 8 hex digits of their SHA-256; the full digest confirms. Rules are broadcast
when they are at most ``BROADCAST_RULES``; beyond that the join shuffles by the short hash. Verdicts of distinct pairs
are staged and joined back, a join that adaptive execution can split where one host or URL holds many rows.

Only DataFrame functions are used. Edge cases: a null URL or one without ``://`` has an empty host and path and gets the
default verdict; repeated rows and ties give equal rows; very long URLs cost no more than the rules' longest path;
an empty rule table gives the default to all, an empty page table no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import ascii_lower, bounded, staged

ALLOW, BLOCK = "allow", "block"
#: The production rules.
RULES = [
    (ALLOW, "org", "/"),
    (BLOCK, "example.org", "/es/"),
    (BLOCK, "example.org", "/en/1"),
    (ALLOW, "com", "/fr/"),
    (BLOCK, "com", "/de/"),
]
BROADCAST_RULES = 100_000
SHORT = 8


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path).cast("binary"), 256)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for each distinct (host, path) of ``urls`` that a rule fits."""
    rules = rules.select("verdict", ascii_lower(F.col("rule_host")).alias("rule_host"), "rule_path").dropna()
    labels = F.size(F.split("rule_host", "\\."))
    # the shapes of rules: few, whatever the number of rules; labels and path lengths are short
    shapes = [tuple(r) for r in rules.select(labels.alias("n"), F.length("rule_path").alias("m")).distinct().collect()]
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    rules = rules.select("verdict", "rule_host", "rule_path", digest.alias("digest"), F.substring(digest, 1, SHORT).alias("short"))
    rules = F.broadcast(rules) if bounded(rules, BROADCAST_RULES) else rules
    pairs = urls.select("host", "path").distinct().withColumn("labels", F.split("host", "\\."))
    wanted = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in shapes]) if shapes else F.expr("array()").cast("array<struct<n:int,m:int>>")
    fits = F.filter(wanted, lambda s: (s["n"] <= F.size("labels")) & (s["m"] <= F.length("path")))
    suffix = lambda s: F.array_join(F.slice("labels", F.size("labels") - s["n"] + 1, s["n"]), ".")
    prefix = lambda s: F.substring(F.col("path"), F.lit(1), s["m"])
    found = pairs.select("host", "path", F.explode(F.transform(fits, lambda s: _digest(suffix(s), prefix(s)))).alias("url_digest"))
    found = found.join(rules, (F.substring("url_digest", 1, SHORT) == F.col("short")) & (F.col("url_digest") == F.col("digest")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(rule.alias("rule"), "verdict"), F.struct(F.length(rule), F.length("rule_host"), rule, "verdict"))
    return found.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    best = staged(match_rules(rows, rules), "url-rules")
    joined = rows.join(best, ["host", "path"], "left")
    return joined.select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


#: The same in DuckDB, rule by rule.
ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, h, q) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT p.page_id, p.host, p.path, h || q AS rule, verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(h || q) DESC, length(h) DESC) AS n
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""
