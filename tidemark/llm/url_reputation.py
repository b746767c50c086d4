"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host.

Labelled pages count as successes or failures of their host. Each host's rate is shrunk to its registered domain, that to
its public suffix, that to the whole table; the strength of each prior is the beta-binomial moment estimate over that
level. A host passes when the lower bound of its beta posterior reaches the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, staged, table

#: Fixed values: (verdict, host, path) of the contract's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Common public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "com.mx", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(raw), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)


def first_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; both null where none does. The rules are a short list of code."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest becomes the outermost condition
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host; of a host of one label, the host itself."""
    two = F.substring_index(host, ".", -2)
    suffix = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two), suffix


def strength(children: DataFrame, low: float = 2.0, high: float = 1000.0) -> float:
    """Prior strength of one level: children has n, good and rate, the rate of the parent. A moment estimate, one row."""
    v = F.col("rate") * (1 - F.col("rate"))
    r = children.filter("n > 0").agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col("rate")) ** 2).alias("s"), F.sum(v).alias("v1"), F.sum(v * F.col("n")).alias("vn")
    ).first()
    if not r or not r.vn or r.vn <= r.v1 or r.s <= r.v1:
        return high
    rho = (r.s - r.v1) / (r.vn - r.v1)
    return min(high, max(low, (1 - rho) / rho))


def host_reputation(pages: DataFrame, z: float = 1.645) -> DataFrame:
    """pages: host and good (1, 0 or null for unlabelled). One row for each host: n, good, mean and bound of its posterior."""
    domain, suffix = levels(F.col("host"))
    hosts = pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = staged(hosts.withColumns({"domain": domain, "suffix": suffix}), "url-hosts")  # a row a host; all that follows reads only these
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    top = suffixes.agg(*sums).first()
    base = ((top.good or 0) + 1) / ((top.n or 0) + 2)
    s0 = strength(suffixes.withColumn("rate", F.lit(base)))
    suffixes = suffixes.select("suffix", ((F.col("good") + s0 * base) / (F.col("n") + s0)).alias("rate"))
    domains = domains.join(suffixes, "suffix")
    s1 = strength(domains)
    domains = domains.select("domain", "suffix", ((F.col("good") + s1 * F.col("rate")) / (F.col("n") + s1)).alias("rate"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    s2 = strength(hosts)
    a, b = F.col("good") + s2 * F.col("rate"), F.col("n") - F.col("good") + s2 * (1 - F.col("rate"))
    hosts = hosts.select("host", "n", "good", (a / (a + b)).alias("mean"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))
    return hosts.select("host", F.col("n").alias("host_labelled"), F.col("good").alias("host_good"), F.col("mean").alias("host_mean"), (F.col("mean") - z * F.col("sd")).alias("host_bound"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """Judges every url of pages (page_id, url): page_id, host, path, rule, verdict, host_labelled, host_good, host_mean, host_bound.

    outcomes: (doc_id, quality, toxic); a page stands for the document whose number its path holds, and is good with
    quality 1 and toxic 0. Without a label a page counts for nothing, and a host without any gets its domain's prior. A
    url that is null or has no :// has an empty host, which is a host like any other. Repeated rows are judged each, and
    each counts. Other columns are not read. Hot hosts: counts are summed before the shuffle, and the join's hot partitions are
    split at run time, as one side has one row for each host."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("number", F.regexp_extract("path", r"/([0-9]{1,18})(?:[^0-9]|$)", 1).try_cast("long"))
    labels = outcomes.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("number")).agg((F.min("quality") * (1 - F.max(F.coalesce("toxic", F.lit(0))))).cast("long").alias("good"))
    reputation = host_reputation(judged.join(labels, "number", "left"), z)
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    return judged.join(reputation, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("host_bound") >= threshold, "allow").otherwise("block")).alias("verdict"), "host_labelled", "host_good", "host_mean", "host_bound"
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("host_mean", "host_bound")


def _strength_sql(of: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(vn, 0) = 0 OR vn <= v1 OR s <= v1 THEN 1000.0 ELSE least(1000.0, greatest(2.0, (1 - (s - v1) / (vn - v1)) / ((s - v1) / (vn - v1)))) END AS k
 FROM (SELECT sum(n * pow(good / n - rate, 2)) AS s, sum(rate * (1 - rate)) AS v1, sum(rate * (1 - rate) * n) AS vn FROM {of} WHERE n > 0))"""


_TWO = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
ORACLE = rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM a),
c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
l AS (SELECT doc_id, min(quality) * (1 - max(coalesce(toxic, 0))) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
p AS (SELECT c.*, l.good FROM c LEFT JOIN l ON TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:[^0-9]|$)', 1) AS BIGINT) = l.doc_id),
h0 AS (SELECT host, count(good) AS n, CAST(coalesce(sum(good), 0) AS BIGINT) AS good, string_split(host, '.') AS parts FROM p GROUP BY host),
h1 AS (SELECT *, array_to_string(parts[-2:], '.') AS two FROM h0),
h2 AS (SELECT host, n, good, CASE WHEN two IN ({_TWO}) THEN array_to_string(parts[-3:], '.') ELSE two END AS domain, CASE WHEN two IN ({_TWO}) THEN two ELSE parts[-1] END AS suffix FROM h1),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h2 GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d0 GROUP BY ALL),
t AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS base FROM s0),
s1 AS (SELECT s0.*, base AS rate FROM s0, t),
s2 AS (SELECT suffix, (good + k.k * rate) / (n + k.k) AS rate FROM s1, {_strength_sql("s1")} k),
d1 AS (SELECT d0.*, s2.rate FROM d0 JOIN s2 USING (suffix)),
d2 AS (SELECT domain, suffix, (good + k.k * rate) / (n + k.k) AS rate FROM d1, {_strength_sql("d1")} k),
h3 AS (SELECT h2.*, d2.rate FROM h2 JOIN d2 USING (domain, suffix)),
h4 AS (SELECT host, n, good, good + k.k * rate AS a, n - good + k.k * (1 - rate) AS b FROM h3, {_strength_sql("h3")} k),
h5 AS (SELECT host, n, good, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h4),
j AS (SELECT c.*, h5.n, h5.good, h5.bound, ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') AS r1, ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') AS r2,
 ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') AS r3, ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') AS r4, ('.' || host) LIKE '%.com' AND starts_with(path, '/') AS r5 FROM c JOIN h5 USING (host))
SELECT page_id, host, path, CASE WHEN r1 THEN 'www.example.com/en/' WHEN r2 THEN 'example.com/en/' WHEN r3 THEN 'net/es/' WHEN r4 THEN 'net/fr/' WHEN r5 THEN 'com/' END AS rule,
 CASE WHEN r1 THEN 'allow' WHEN r2 OR r3 OR r4 THEN 'block' WHEN r5 OR bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, n AS host_labelled, good AS host_good FROM j
"""
