"""URL rules by hash-prefix lookup.

A rule is a host and the beginning of a path; it fits that host, its subdomains and every path that begins so. Each URL is
expanded into expressions: every suffix of its host at a dot of a number of labels that some rule's host has, times every
prefix of its path of a length that some rule's path has (such numbers are few, whatever the number of rules). The first eight hex digits of an expression's SHA-256 are
joined with those of the rules; where they meet, the full digests are compared, and of the rules that truly fit the longest
(then that with the longer host, then a blocking one) decides.

Distinct URLs are expanded, so repeated URLs cost one lookup, and a URL's matches meet by partial aggregation. The side of
the rules is broadcast where Spark finds it small enough; else both sides are shuffled on the hash prefix, and adaptive
execution splits a crowded one (a third of all URLs of one host, say).

Defined results: null URLs and those without :// have empty host and path, no rule and the default verdict; an empty host
fits no rule; rules with a null host, path or action are left out; repeated rows stay; an empty table gives an empty
result, and with no rules every verdict is the default; other columns pass through, and a clashing name goes to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Fixed rules of the query: action, host, beginning of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """(host suffix, path prefix) of every pair; labels are the numbers of labels of the rules' hosts, lengths those of their
    paths. So a URL has as many expressions as there are such pairs, however long its host."""
    own = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(F.array(*[F.when(own >= n, F.substring_index(host, ".", -n)) for n in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to rows with a url. rules: action, host, path (which begins with a slash or is empty)."""
    known = rules.where("host is not null and path is not null and action is not null and host <> ''")
    known = known.select(F.concat("host", "path").alias("rule"), F.length("host").alias("of_host"), F.length("path").alias("of_path"), F.size(F.split("host", r"\.")).alias("of_labels"), "action").distinct()
    # One number for each length of a path and of a host, not for each rule.
    lengths, labels = (sorted(r[0] for r in known.select(c).distinct().collect()) for c in ("of_path", "of_labels"))
    known = known.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = pages.where("host <> ''").select("host", "path").distinct()
    if not lengths:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    spread = urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("expression"))
    spread = spread.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    met = spread.alias("u").join(known.alias("r"), "short").where("u.digest = r.digest")
    rank = F.struct(F.length("r.rule").alias("n"), F.col("r.of_host").alias("h"), (F.col("r.action") == "block").alias("b"), F.col("r.rule").alias("rule"), F.col("r.action").alias("action"))
    best = met.groupBy(F.col("u.host").alias("_h"), F.col("u.path").alias("_p")).agg(F.max(rank).alias("_best"))
    out = pages.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.action"), F.lit(default))}).drop("_h", "_p", "_best")


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rules = spark.createDataFrame(list(RULES), "action string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH rules(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's'), '') AS path
  FROM pages),
fit AS (
  SELECT c.page_id, c.url, c.host, c.path, r.host || r.path AS rule, r.action,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM cut c LEFT JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE k = 1
"""
