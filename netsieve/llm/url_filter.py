"""URL filters as a temporal list join (DataFrame only).

List entries are dated: an ``add`` puts a pattern on a list, a ``remove`` takes
it off again. Per (list, kind, pattern) they become validity intervals, and every
capture is held against the entries that were active when it was fetched, not
against today's list.

Kinds of pattern: ``host`` (this host), ``domain`` (this host and all below it),
``prefix`` (host and leading path segments). A capture offers each of its host,
host suffixes and path prefixes as a key, so matching is an equi-join. Intervals
are split over time buckets and the bucket is part of the join key; a popular
host's captures spread over its buckets, a long list history is compared with the
captures of the same bucket only, and Spark can split what is still uneven.

Defined results: scheme, user, port, query, fragment, letter case of the host and
a trailing dot do not matter; captures with NULL or unparseable url or NULL time
match nothing and stay, not blocked; an entry without pattern, kind or date is
ignored; events of one pattern at one instant apply adds first, so a remove wins;
repeated entries change nothing; repeated captures are all returned; an empty
list blocks nothing. Other columns of the captures are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from netsieve.llm.common import read

BUCKET_SEC = 30 * 86400
FOREVER = (1 << 62)
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of a url; NULL if there is none."""
    h = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(h != "", h)


def segments_of(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``[valid_from, valid_to)`` of (list, kind, pattern).

    ``entries``: list, kind, pattern, action ('add'/'remove'), ts (seconds)."""
    e = entries.where("list is not null and kind in ('host','domain','prefix') and pattern <> '' "
                      "and action in ('add','remove') and ts is not null").select(
        "list", "kind", F.lower("pattern").alias("pattern"), "action", F.col("ts").cast("long").alias("ts")).distinct()
    # one event a second: the remove wins
    e = e.groupBy("list", "kind", "pattern", "ts").agg(F.max("action").alias("action"))
    by = W.partitionBy("list", "kind", "pattern").orderBy("ts")
    e = e.withColumn("valid_to", F.coalesce(F.lead("ts").over(by), F.lit(FOREVER)))
    return e.where("action = 'add'").select("list", "kind", "pattern", F.col("ts").alias("valid_from"), "valid_to")


def capture_keys(captures: DataFrame, depth: DataFrame) -> DataFrame:
    """(url, fetch_ts, kind, pattern) for every key a capture offers. ``depth``
    has one row: the number of segments of the longest prefix pattern."""
    c = captures.select("url", "fetch_ts").where("url is not null and fetch_ts is not null").distinct()
    c = c.select("url", "fetch_ts", host_of(F.col("url")).alias("host"), segments_of(F.col("url")).alias("segs")).where("host is not null")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    n = F.least(F.size("segs"), F.coalesce("depth", F.lit(0)))
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat(F.col("host"), F.lit("/"), F.lower(F.array_join(F.slice("segs", F.lit(1), i), "/"))).alias("pattern")))
    whole = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")))
    keys = F.explode(F.concat(whole, suffixes, prefixes)).alias("k")
    return c.crossJoin(F.broadcast(depth)).select("url", "fetch_ts", keys).select("url", "fetch_ts", "k.kind", "k.pattern")


def matches(captures: DataFrame, entries: DataFrame, bucket_sec: int = BUCKET_SEC) -> DataFrame:
    """One row per distinct (url, fetch_ts) that an active entry covers:
    n_entries and the sorted names of the lists."""
    valid = intervals(entries)
    span = captures.agg(F.min("fetch_ts").alias("lo"), F.max("fetch_ts").alias("hi"))
    bucket = lambda c: F.floor(c / bucket_sec)
    clipped = (valid.crossJoin(F.broadcast(span)).where("valid_from <= hi and valid_to > lo")
               .select("list", "kind", "pattern", "valid_from", "valid_to", F.explode(F.sequence(
                   bucket(F.greatest("valid_from", "lo")), bucket(F.least(F.col("valid_to") - 1, F.col("hi"))))).alias("bucket")))
    depth = valid.agg(F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)).alias("depth"))
    keys = capture_keys(captures, depth).withColumn("bucket", bucket(F.col("fetch_ts")))
    hit = keys.join(clipped, ["kind", "pattern", "bucket"]).where("valid_from <= fetch_ts and fetch_ts < valid_to")
    # (url, time, list) first: the final sets hold list names, of which there are few
    per_list = hit.groupBy("url", "fetch_ts", "list").agg(F.count("*").alias("n"))
    return per_list.groupBy("url", "fetch_ts").agg(
        F.sum("n").alias("n_entries"), F.array_join(F.array_sort(F.collect_list("list")), ",").alias("lists"))


def filter_urls(captures: DataFrame, entries: DataFrame, bucket_sec: int = BUCKET_SEC) -> DataFrame:
    """Captures (url, fetch_ts in seconds, ...) with host, blocked, n_entries, lists."""
    drop = [c for c in ("host", "blocked", "n_entries", "lists") if c in captures.columns]
    captures = captures.drop(*drop).withColumn("fetch_ts", F.col("fetch_ts").cast("long"))
    m = matches(captures, entries, bucket_sec).withColumnsRenamed({"url": "m_url", "fetch_ts": "m_ts", "n_entries": "m_n", "lists": "m_lists"})
    return (captures.join(m, (F.col("url") == F.col("m_url")) & (F.col("fetch_ts") == F.col("m_ts")), "left")
            .withColumns({"host": host_of(F.col("url")), "blocked": F.col("m_n").isNotNull(),
                          "n_entries": F.coalesce("m_n", F.lit(0)), "lists": F.coalesce("m_lists", F.lit(""))})
            .drop("m_url", "m_ts", "m_n", "m_lists"))


# ---- query: captures and a dated list derived from ``pages`` ----
# The tables have neither fetch times nor lists. A page's fetch second follows
# from its id; the list's entries follow from md5 of the hosts that occur.

BASE_TS = 1704067200  # 2024-01-01
YEAR = 31536000


def _h(col: Column, salt: str, mod: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), col).cast("binary")), 1, 12), 16, 10).cast("long") % mod


def derived_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(BASE_TS) + (F.col("page_id") * 7919) % YEAR).alias("fetch_ts"))


def derived_entries(pages: DataFrame) -> DataFrame:
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.element_at(segments_of(F.col("url")), 1).alias("seg")).where("host is not null").distinct()
    host = hosts.select("host").distinct()
    day = lambda salt: F.lit(BASE_TS) + 86400 * _h(F.col("host"), salt, 300)
    kinds = (host.where(_h(F.col("host"), "a", 4) == 0).select(F.lit("adult").alias("list"), F.lit("host").alias("kind"), F.col("host").alias("pattern"), "host")
             .unionAll(host.where((_h(F.col("host"), "b", 6) == 0) & (F.size(F.split("host", r"\.")) > 2)).select(
                 F.lit("spam"), F.lit("domain"), F.regexp_replace("host", r"^[^.]*\.", ""), "host"))
             .unionAll(hosts.where((_h(F.col("host"), "c", 3) == 0) & F.col("seg").isNotNull()).select(
                 F.lit("legal"), F.lit("prefix"), F.concat("host", F.lit("/"), "seg"), "host")))
    events = F.array(
        F.struct(F.lit("add").alias("action"), day("t").alias("ts")),
        F.struct(F.lit("remove").alias("action"), (day("t") + 86400 * (20 + _h(F.col("host"), "u", 60))).alias("ts")),
        F.struct(F.lit("add").alias("action"), F.when(_h(F.col("host"), "v", 2) == 0, day("t") + 86400 * 120).alias("ts")))
    return kinds.select("list", "kind", "pattern", F.explode(events).alias("e")).select("list", "kind", "pattern", "e.action", "e.ts")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(derived_captures(pages), derived_entries(pages)).select("page_id", "url", "host", "fetch_ts", "blocked", "n_entries", "lists")


OP3_SQL = r"""
WITH p AS (SELECT page_id, url, CAST(1704067200 + (page_id * 7919) % 31536000 AS BIGINT) AS fetch_ts,
    nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
    [x FOR x IN string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/') IF x <> ''] AS segs FROM pages),
hs AS (SELECT DISTINCT host, segs[1] AS seg FROM p WHERE host IS NOT NULL),
h AS (SELECT DISTINCT host FROM hs),
k AS (SELECT 'adult' AS list, 'host' AS kind, host AS pattern, host FROM h WHERE CAST('0x' || substr(md5('a' || host), 1, 12) AS BIGINT) % 4 = 0
  UNION ALL SELECT 'spam', 'domain', regexp_replace(host, '^[^.]*\.', ''), host FROM h WHERE CAST('0x' || substr(md5('b' || host), 1, 12) AS BIGINT) % 6 = 0 AND len(string_split(host, '.')) > 2
  UNION ALL SELECT 'legal', 'prefix', lower(host || '/' || seg), host FROM hs WHERE seg IS NOT NULL AND CAST('0x' || substr(md5('c' || host), 1, 12) AS BIGINT) % 3 = 0),
t AS (SELECT *, 1704067200 + 86400 * (CAST('0x' || substr(md5('t' || host), 1, 12) AS BIGINT) % 300) AS t0 FROM k),
ev AS (SELECT list, kind, pattern, 'add' AS action, t0 AS ts FROM t
  UNION SELECT list, kind, pattern, 'remove', t0 + 86400 * (20 + CAST('0x' || substr(md5('u' || host), 1, 12) AS BIGINT) % 60) FROM t
  UNION SELECT list, kind, pattern, 'add', t0 + 86400 * 120 FROM t WHERE CAST('0x' || substr(md5('v' || host), 1, 12) AS BIGINT) % 2 = 0),
e1 AS (SELECT list, kind, pattern, ts, max(action) AS action FROM ev GROUP BY ALL),
iv AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY list, kind, pattern ORDER BY ts), 4611686018427387904) AS valid_to FROM e1),
m AS (SELECT p.url, p.fetch_ts, iv.list FROM (SELECT DISTINCT url, fetch_ts, host, segs FROM p WHERE host IS NOT NULL AND fetch_ts IS NOT NULL) p
  JOIN iv ON iv.action = 'add' AND iv.ts <= p.fetch_ts AND p.fetch_ts < iv.valid_to AND (
    (iv.kind = 'host' AND iv.pattern = p.host)
    OR (iv.kind = 'domain' AND (iv.pattern = p.host OR ends_with(p.host, '.' || iv.pattern)))
    OR (iv.kind = 'prefix' AND starts_with(p.host || '/' || lower(array_to_string(p.segs, '/')) || '/', iv.pattern || '/')))),
g AS (SELECT url, fetch_ts, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists FROM m GROUP BY ALL)
SELECT p.page_id, p.url, p.host, p.fetch_ts, g.n IS NOT NULL AS blocked, coalesce(g.n, 0) AS n_entries, coalesce(g.lists, '') AS lists
FROM p LEFT JOIN g ON p.url = g.url AND p.fetch_ts = g.fetch_ts
"""
