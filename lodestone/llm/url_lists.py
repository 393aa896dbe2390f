"""URL filters by dated lists: a temporal join.

List entries are dated: a key (a host, which stands for its subdomains too, or a host with a path
prefix that ends in /) is added or removed on a day. Per key the days become validity intervals [from, to): runs of equal
actions count once, a key removed and added on one day is removed. A capture is evaluated against the
entries that were active when it was fetched: its URL gives the keys that could match (its host, its
parent domains, its path prefixes), an equi-join on the key finds their intervals, and the as-of
condition keeps that in force. The longest matching key decides; ties cannot occur, as keys are unique.

A null or relative URL has no host and a null fetch time has no moment: neither is blocked. Entries with a null
key, action or day are ignored; repeated entries count once; actions other than add and remove are
ignored. Repeated captures each get their row. Empty lists block nothing. Only the named columns are
read from either table, so extra columns with any names are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import free, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    """Lower-cased host without port, user or final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def keys(url: Column) -> Column:
    """All keys that would match the URL: each suffix of its host at a dot, each prefix of its path at a slash."""
    name = host(url)
    labels = F.split(name, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(name, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.when(name != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """key, valid_from, valid_to (null: still listed) from entries (key, action, day)."""
    e = entries.select("key", "action", F.col("day").cast("date").alias("day")).filter("key is not null and day is not null and action in ('add', 'remove')")
    # of one day's actions removal is the last
    e = e.groupBy("key", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("key").orderBy("day")
    e = e.withColumn("was", F.lag("action").over(w)).filter("was is null or was <> action")
    e = e.withColumn("valid_to", F.lead("day").over(w)).filter("action = 'add'")
    return e.select("key", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with blocked, matched_key, listed_from, n_matches, by the entries in force when fetched.

    The distinct (URL, time) pairs are joined, so a repeated capture costs one probe; hot hosts are keys
    whose side of the join AQE splits: the other side is a table of its own with few rows a key.
    """
    seen = captures.select(F.col(url).alias("url_"), F.col(fetched).alias("fetched_")).filter("url_ is not null and fetched_ is not null").distinct()
    listed = table(intervals(entries), "intervals")
    # a host key of so many labels as no entry has, such as a bare top-level domain, need not be probed
    labels = lambda key: F.size(F.split(key, r"\."))
    counts = [r[0] for r in listed.filter(~F.endswith("key", F.lit("/"))).select(labels(F.col("key"))).distinct().collect()]  # a few numbers
    held = F.filter(keys(F.col("url_")), lambda k: F.endswith(k, F.lit("/")) | (labels(k).isin(counts) if counts else F.lit(False)))
    probes = seen.withColumn("key", F.explode(held))
    day = F.col("fetched_").cast("date")
    met = probes.join(listed, "key").filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))))
    best = F.max(F.struct(F.length("key").alias("n"), "key", "valid_from")).alias("best")
    hits = table(met.groupBy("url_", "fetched_").agg(best, F.count(F.lit(1)).alias("n")), "hits")
    out = captures.drop("blocked", "matched_key", "listed_from", "n_matches")
    hit = free(out, "hit")
    hits = hits.select(F.struct("url_", "fetched_", "best", "n").alias(hit))
    h = lambda name: F.col(f"{hit}.{name}")
    out = out.join(hits, (F.col(f"`{url}`") == h("url_")) & (F.col(f"`{fetched}`") == h("fetched_")), "left")
    return out.withColumns({"blocked": h("best").isNotNull(), "matched_key": h("best.key"), "listed_from": h("best.valid_from"), "n_matches": F.coalesce(h("n"), F.lit(0)).cast("bigint")}).drop(hit)


# ---- the registered query: a synthetic list over the hosts of pages


def _draw(of: Column, n: int, at: int) -> Column:
    return (F.conv(F.substring(F.md5(of.cast("binary")), at, 6), 16, 10).cast("bigint") % n).cast("int")


def example_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for a third of all hosts, some of them removed and listed again, for paths, and for one domain."""
    hosts = pages.select(host(F.col("url")).alias("h")).filter("h <> ''").distinct()
    start = F.lit("2024-01-01").cast("date")
    some = hosts.filter(_draw(F.col("h"), 3, 1) == 0).withColumn("d", F.date_add(start, _draw(F.col("h"), 200, 7)))
    out = some.select(F.col("h").alias("key"), F.lit("add").alias("action"), F.col("d").alias("day"))
    out = out.unionByName(some.filter(_draw(F.col("h"), 2, 13) == 0).select(F.col("h").alias("key"), F.lit("remove").alias("action"), F.date_add("d", 40).alias("day")))
    out = out.unionByName(some.filter(_draw(F.col("h"), 4, 13) == 0).select(F.col("h").alias("key"), F.lit("add").alias("action"), F.date_add("d", 90).alias("day")))
    out = out.unionByName(hosts.select(F.concat("h", F.lit("/de/")).alias("key"), F.lit("add").alias("action"), F.date_add(start, _draw(F.col("h"), 365, 19)).alias("day")))
    domain = hosts.sparkSession.sql("select * from values ('example.net', 'add', date'2024-03-01'), ('example.net', 'remove', date'2024-06-01'), ('example.net', 'add', date'2024-06-01') as t(key, action, day)")
    return out.unionByName(domain)


def example(pages: DataFrame) -> DataFrame:
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")).alias("fetched"))
    got = evaluate(captures, example_entries(pages))
    return got.select("page_id", F.col("fetched").cast("string").alias("fetched"), "blocked", "matched_key", F.col("listed_from").cast("string").alias("listed_from"), "n_matches")


SQL = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + (((page_id * 7919) % 366 + 366) % 366)::INT AS fetched,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS h,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS p
  FROM pages),
hosts AS (SELECT DISTINCT h, md5(h) AS m FROM c WHERE h <> ''),
draws AS (SELECT h, ('0x' || substr(m, 1, 6))::BIGINT % 3 AS a, ('0x' || substr(m, 7, 6))::BIGINT % 200 AS b,
                 ('0x' || substr(m, 13, 6))::BIGINT AS x, ('0x' || substr(m, 19, 6))::BIGINT % 365 AS e FROM hosts),
entries AS (
  SELECT h AS key, 'add' AS action, DATE '2024-01-01' + b::INT AS day FROM draws WHERE a = 0
  UNION ALL SELECT h, 'remove', DATE '2024-01-01' + (b + 40)::INT FROM draws WHERE a = 0 AND x % 2 = 0
  UNION ALL SELECT h, 'add', DATE '2024-01-01' + (b + 90)::INT FROM draws WHERE a = 0 AND x % 4 = 0
  UNION ALL SELECT h || '/de/', 'add', DATE '2024-01-01' + e::INT FROM draws
  UNION ALL SELECT * FROM (VALUES ('example.net', 'add', DATE '2024-03-01'), ('example.net', 'remove', DATE '2024-06-01'), ('example.net', 'add', DATE '2024-06-01'))),
days AS (SELECT key, day, max(action) AS action FROM entries GROUP BY key, day),
was AS (SELECT *, lag(action) OVER (PARTITION BY key ORDER BY day) AS was FROM days),
runs AS (SELECT key, action, day, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM was WHERE was IS NULL OR was <> action),
listed AS (SELECT key, day AS valid_from, until FROM runs WHERE action = 'add'),
met AS (
  SELECT c.page_id, c.url, c.fetched, l.key, l.valid_from
  FROM c JOIN listed l ON l.valid_from <= c.fetched AND (l.until IS NULL OR c.fetched < l.until)
    AND (c.h = l.key OR (l.key NOT LIKE '%/' AND ends_with(c.h, '.' || l.key)) OR (l.key LIKE '%/' AND starts_with(c.h || c.p, l.key)))
  WHERE c.h <> ''),
best AS (SELECT page_id, max_by(key, length(key)) AS key, max_by(valid_from, length(key)) AS valid_from, count(*) AS n FROM met GROUP BY page_id)
SELECT c.page_id, c.fetched::VARCHAR AS fetched, best.key IS NOT NULL AS blocked, best.key AS matched_key, best.valid_from::VARCHAR AS listed_from, coalesce(best.n, 0)::BIGINT AS n_matches
FROM c LEFT JOIN best USING (page_id)
"""
