"""URL filters: dated list entries become validity intervals, and an as-of join finds those active at fetch time.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?:[:/?#]|$)", 1), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(host, path, action, since, until) of entries(host, path, action, since): each holds until the next of its host and path.

    Of entries of the same time the last by action holds. Entries without host or time are ignored; a null path is "".
    """
    e = entries.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action", "since").where("host IS NOT NULL AND since IS NOT NULL").distinct()
    until = F.lead("since").over(W.partitionBy("host", "path").orderBy("since", F.col("action").asc_nulls_first()))
    return e.withColumn("until", until).where("until IS NULL OR since < until")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """captures with ``rule`` (host, path, since, action of the deciding entry, or null) and ``blocked``. Replaces such columns.

    An entry applies to its host and all hosts below it, to paths that begin with its path, and at times in its interval
    [since, until). Of those that apply, the longest host decides, then the longest path; ``blocked`` if its action is
    "block". Each distinct (host, path, time) is judged once: equal captures of a busy host are one row in the join,
    whose host side adaptive execution can split, as the entries of a host are few. Null URLs and times match nothing.
    Rows are neither lost nor doubled, repeated ones included.
    """
    c = captures.drop("rule", "blocked").withColumns({"__host": host_of(F.col(url_col)), "__path": path_of(F.col(url_col))})
    asked = c.select(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col(time_col).alias("time")).where("time IS NOT NULL AND host <> ''").distinct()
    labels = F.split("host", r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = asked.select("host", "path", "time", F.explode(below).alias("suffix"))
    e = intervals(entries).select(F.col("host").alias("e_host"), F.col("path").alias("e_path"), "action", "since", "until")
    met = probes.join(e, (F.col("suffix") == F.col("e_host")) & (F.col("time") >= F.col("since")) & (F.col("until").isNull() | (F.col("time") < F.col("until"))) & F.col("path").startswith(F.col("e_path")))
    best = met.groupBy("host", "path", "time").agg(F.max(F.struct(F.length("e_host").alias("n"), F.length("e_path").alias("m"), "e_host", "e_path", "since", "action")).alias("b"))
    best = best.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("time").alias("r_time"), F.struct(F.col("b.e_host").alias("host"), F.col("b.e_path").alias("path"), F.col("b.since").alias("since"), F.col("b.action").alias("action")).alias("rule"))
    out = c.join(best, (F.col("__host") == F.col("r_host")) & (F.col("__path") == F.col("r_path")) & (F.col(time_col) == F.col("r_time")), "left")
    return out.withColumn("blocked", F.coalesce(F.col("rule.action") == "block", F.lit(False))).drop("__host", "__path", "r_host", "r_path", "r_time")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of a day that its id gives, against dated lists made of the pages' own hosts."""
    start = F.lit("2024-01-01").cast("date")
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched", F.date_add(start, (F.col("page_id") % 730).cast("int")))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("m", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    entry = lambda path, action, days, where: F.when(where, F.struct(F.lit(path).alias("path"), F.lit(action).alias("action"), F.date_add(start, days).alias("since")))
    m = F.col("m")
    per_host = F.array(entry("", "block", m % 700, m % 3 > 0), entry("", "allow", m % 700 + 150, m % 6 == 1), entry("/en", "allow", m % 500, m % 4 == 0), entry("/fr", "block", m % 600, m % 5 == 0))
    entries = hosts.select("host", F.explode(F.filter(per_host, lambda x: x.isNotNull())).alias("e")).select("host", "e.*")
    domains = spark.sql("SELECT * FROM VALUES ('example.net', '', 'block', DATE'2024-07-01'), ('example.net', '', 'allow', DATE'2025-06-01'), ('example.org', '/de', 'block', DATE'2024-03-01') AS t(host, path, action, since)")
    out = judge(pages, entries.unionByName(domains))
    return out.select("page_id", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "rule.host", "rule.path", "rule.action", F.date_format("rule.since", "yyyy-MM-dd").alias("since"), "blocked")


SQL = r"""
WITH p AS (SELECT page_id, DATE '2024-01-01' + (page_id % 730)::INT AS fetched, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*?)\.?(?:[:/?#]|$)', 1), '') AS host, coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::INT AS m FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
e AS (SELECT host, '' AS path, 'block' AS action, DATE '2024-01-01' + m % 700 AS since FROM h WHERE m % 3 > 0
  UNION SELECT host, '', 'allow', DATE '2024-01-01' + (m % 700 + 150) FROM h WHERE m % 6 = 1
  UNION SELECT host, '/en', 'allow', DATE '2024-01-01' + m % 500 FROM h WHERE m % 4 = 0
  UNION SELECT host, '/fr', 'block', DATE '2024-01-01' + m % 600 FROM h WHERE m % 5 = 0
  UNION VALUES ('example.net', '', 'block', DATE '2024-07-01'), ('example.net', '', 'allow', DATE '2025-06-01'), ('example.org', '/de', 'block', DATE '2024-03-01')),
i AS (SELECT *, lead(since) OVER (PARTITION BY host, path ORDER BY since, action) AS until FROM e),
r AS (SELECT p.page_id, i.host, i.path, i.action, i.since, row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.host) DESC, length(i.path) DESC) AS n FROM p JOIN i ON (p.host = i.host OR ends_with(p.host, '.' || i.host)) AND p.fetched >= i.since AND (i.until IS NULL OR p.fetched < i.until) AND starts_with(p.path, i.path))
SELECT p.page_id, strftime(p.fetched, '%Y-%m-%d') AS fetched, r.host, r.path, r.action, strftime(r.since, '%Y-%m-%d') AS since, coalesce(r.action = 'block', false) AS blocked FROM p LEFT JOIN r ON p.page_id = r.page_id AND r.n = 1
"""
