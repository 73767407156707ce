"""URL filtering against dated lists: entries become validity intervals, captures join those active when fetched.

A list entry is (list, kind, value, verdict, ts, action): from `ts` on, `action` "add" or "remove" holds for that value.
kind "domain" covers a host and its subdomains; kind "prefix" covers host + path up to a "/" or the end. Every capture
is keyed by all its host suffixes and path prefixes. The most specific active entry decides; at equal length "allow"
beats "block", then list and value.

The as-of join: the span of fetch times is cut into SLICES equal slices; an interval is clipped to it and goes to each
slice that it touches, a capture to the one it falls in. Both meet by an equality join on (kind, value, slice), in which
a capture sees only what holds at some time of its slice, and the exact bounds decide. So neither a value that changes
again and again nor a host with a third of all captures is joined as a whole.

Hosts are lower case, without port, user and final dots, in captures and entries; paths keep their case, and empty
steps ("//", a final "/") do not count in either. A host that is an IP address (four numbers, or in brackets) has no
suffixes; a prefix entry without a path covers its host alone.

Scale: captures are reduced to distinct (url, time) before they are expanded; the interval side is at most SLICES rows
per interval. The joins are shuffles by keys of which adaptive execution splits the hot ones. Nothing is broadcast by
hand; only the first and last fetch time reach the driver.

Edge cases: a null or unparsable url, or a null time, matches nothing (verdict "none"); entries with a null value, time
or unknown action are ignored; of several changes of a value at one time the removal holds; repeated captures each get
a row; other columns are kept, but for one named `list_match`, which the result replaces; empty tables give no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.columns import packed, unpacked
from corpusloom.session import cut

#: Fixed entries for the query: (list, kind, value, verdict, time, action).
DATED_LIST = [
    ("spam", "domain", "spam-farm.example.org", "block", "2024-01-15 00:00:00", "add"),
    ("spam", "domain", "spam-farm.example.org", "block", "2024-06-01 00:00:00", "remove"),
    ("spam", "domain", "spam-farm.example.org", "block", "2024-09-01 12:00:00", "add"),
    ("pharma", "domain", "cheap-pills.example.com", "block", "2024-02-01 00:00:00", "add"),
    ("pharma", "domain", "www.cheap-pills.example.com", "allow", "2024-08-01 00:00:00", "add"),
    ("pharma", "domain", "www.cheap-pills.example.com", "allow", "2024-10-01 00:00:00", "remove"),
    ("net", "domain", "example.net", "block", "2024-11-20 00:00:00", "add"),
    ("net", "domain", "example.net", "block", "2024-12-01 00:00:00", "remove"),
    ("blogs", "prefix", "blog.ththan.example.net/en", "allow", "2024-11-01 00:00:00", "add"),
    ("blogs", "prefix", "WWW.cheap-pills.example.com.:443//en/", "block", "2024-03-01 00:00:00", "add"),
]
FOREVER = "9999-12-31 00:00:00"
SLICES = 64
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"
ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL without final dots, "" if it has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def _steps(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def entry_value(kind: Column, value: Column) -> Column:
    """An entry's value in the form of `keys`: host lower case, without port and final dots, path steps as they are."""
    bare = F.regexp_replace(F.lower(F.regexp_extract(value, r"^(\[[^\]]*\]|[^/:]*)", 1)), r"\.+$", "")
    steps = F.filter(F.slice(F.split(value, "/"), F.lit(2), F.greatest(F.size(F.split(value, "/")) - 1, F.lit(0))), lambda s: s != "")
    return F.when(kind == "prefix", F.array_join(F.concat(F.array(bare), steps), "/")).otherwise(bare)


def keys(url: Column) -> Column:
    """Array of (kind, value) under which list entries may match the URL."""
    h = host(url)
    labels = F.split(h, r"\.")
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    domains = F.when(h.rlike(ADDRESS), F.array(key("domain", h))).otherwise(suffixes)
    steps = _steps(F.regexp_extract(url, PATH, 1))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: key("prefix", F.array_join(F.concat(F.array(h), F.slice(steps, F.lit(1), i)), "/")))
    return F.when(h != "", F.array_distinct(F.concat(domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals [since, until) of each entry, from its dated additions and removals."""
    key = ["list", "kind", "value", "verdict"]
    clean = entries.filter("value IS NOT NULL AND ts IS NOT NULL AND action IN ('add', 'remove')")
    moves = clean.withColumn("value", entry_value(F.col("kind"), F.col("value"))).groupBy(*key, "ts").agg(F.max("action").alias("action"))
    w = Window.partitionBy(*key).orderBy("ts")
    turns = moves.withColumn("before", F.lag("action", 1, "remove").over(w)).filter("action <> before")
    spans = turns.withColumn("until", F.lead("ts").over(w))
    return spans.filter("action = 'add'").select(*key, F.col("ts").alias("since"), F.coalesce("until", F.lit(FOREVER).cast("timestamp_ntz")).alias("until"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", ts: str = "fetch_ts", slices: int = SLICES) -> DataFrame:
    """captures with a struct `list_match` (host, verdict, list, value, since, n_active)."""
    probes = captures.select(F.col(url).alias("u"), F.col(ts).cast("timestamp_ntz").alias("t")).filter("u IS NOT NULL AND t IS NOT NULL")
    second = lambda t: F.unix_micros(t.cast("timestamp"))
    first, last = probes.agg(F.min(second(F.col("t"))), F.max(second(F.col("t")))).first()
    first, width = first or 0, max(((last or 0) - (first or 0)) // slices + 1, 1)
    at = lambda t: F.floor((second(t) - F.lit(first)) / F.lit(width)).cast("long")
    probes = probes.distinct().select("u", "t", at(F.col("t")).alias("slice"), F.explode(keys(F.col("u"))).alias("k")).select("u", "t", "slice", "k.kind", "k.value")
    spans = intervals(entries).select("*", F.greatest(at(F.col("since")), F.lit(0).cast("long")).alias("a"), F.least(at(F.col("until")), F.lit(slices - 1).cast("long")).alias("z")).filter("a <= z")
    spans = cut(spans.select("list", "kind", "value", "verdict", "since", "until", F.explode(F.sequence("a", "z")).alias("slice")))
    hits = probes.join(spans, ["kind", "value", "slice"]).filter("t >= since AND t < until")
    best = F.max_by(F.struct("verdict", "list", "value", "since"), F.struct(F.length("value"), F.when(F.col("verdict") == "allow", 1).otherwise(0), "list", "value", "since"))
    found = cut(hits.groupBy("u", "t").agg(F.count(F.lit(1)).alias("n_active"), best.alias("best")))
    c, f = captures.select(packed(captures), F.col(url).alias("u"), F.col(ts).cast("timestamp_ntz").alias("t")).alias("c"), found.alias("f")
    out = c.join(f, (F.col("c.u") == F.col("f.u")) & (F.col("c.t") == F.col("f.t")), "left")
    match = F.struct(
        host(F.col("c.u")).alias("host"),
        F.coalesce("f.best.verdict", F.lit("none")).alias("verdict"),
        F.col("f.best.list").alias("list"),
        F.col("f.best.value").alias("value"),
        F.col("f.best.since").alias("since"),
        F.coalesce("f.n_active", F.lit(0)).cast("long").alias("n_active"),
    )
    return out.select(*unpacked(captures, "list_match"), match.alias("list_match"))


def seen_hosts_list(captures: DataFrame) -> DataFrame:
    """Dated entries for the query that grow with the input: a sixteenth of the hosts, blocked from a day to a later one."""
    hosts = captures.select(host(F.col("url")).alias("value")).filter("value <> ''").distinct().withColumn("h", F.md5("value")).filter("substr(h, 1, 1) = '0'")
    day = F.conv(F.substring("h", 2, 4), 16, 10).cast("int") % 300
    start = F.expr("timestamp_ntz '2024-01-01 00:00:00'")
    at = lambda n: (start + F.make_dt_interval(n)).cast("timestamp_ntz")
    moves = F.array(F.struct(at(day).alias("ts"), F.lit("add").alias("action")), F.struct(at(day + 60).alias("ts"), F.lit("remove").alias("action")))
    return hosts.select(F.lit("seen").alias("list"), F.lit("domain").alias("kind"), "value", F.lit("block").alias("verdict"), F.explode(moves).alias("m")).select("list", "kind", "value", "verdict", "m.ts", "m.action")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture; the table has no fetch time, so a second of 2024 is derived from page_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    second = F.make_dt_interval(secs=F.expr("(page_id * 7919) % 31622400").cast("decimal(18,6)"))
    captures = pages.withColumn("fetch_ts", (F.expr("timestamp_ntz '2024-01-01 00:00:00'") + second).cast("timestamp_ntz"))
    fixed = spark.sql(f"SELECT list, kind, value, verdict, CAST(ts AS timestamp_ntz) AS ts, action FROM VALUES {', '.join(map(str, DATED_LIST))} AS x(list, kind, value, verdict, ts, action)")
    out = filter_urls(captures, fixed.unionByName(seen_hosts_list(pages)))
    return out.select("page_id", "url", "fetch_ts", "list_match.*")


_ENTRIES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}', '{f}')" for a, b, c, d, e, f in DATED_LIST)
_HOST = r"regexp_replace(lower(coalesce(regexp_extract({}, '{}', 1), '')), '\.+$', '')"
SQL = rf"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_seconds((page_id * 7919) % 31622400) AS t,
           {_HOST.format('url', HOST)} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host AS value, md5(host) AS h FROM c WHERE host <> '' AND substr(md5(host), 1, 1) = '0'),
e AS (SELECT * FROM (VALUES {_ENTRIES}) AS x(list, kind, value, verdict, ts, action)
      UNION ALL SELECT 'seen', 'domain', value, 'block', TIMESTAMP '2024-01-01' + to_days((('0x' || substr(h, 2, 4))::BIGINT % 300)::INT), 'add' FROM h
      UNION ALL SELECT 'seen', 'domain', value, 'block', TIMESTAMP '2024-01-01' + to_days((('0x' || substr(h, 2, 4))::BIGINT % 300)::INT + 60), 'remove' FROM h),
e1 AS (SELECT * REPLACE (CASE WHEN kind = 'prefix' THEN array_to_string(list_concat([{_HOST.format('value', r'^(\[[^\]]*\]|[^/:]*)')}], list_filter(string_split(value, '/')[2:], lambda x: x <> '')), '/')
       ELSE {_HOST.format('value', r'^(\[[^\]]*\]|[^/:]*)')} END AS value) FROM e),
m AS (SELECT list, kind, value, verdict, ts, max(action) AS action FROM e1 GROUP BY ALL),
m1 AS (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY list, kind, value, verdict ORDER BY ts) AS prior FROM m),
m2 AS (SELECT *, lead(ts) OVER (PARTITION BY list, kind, value, verdict ORDER BY ts) AS nxt FROM m1 WHERE action <> prior),
iv AS (SELECT list, kind, value, verdict, ts AS since, coalesce(nxt, TIMESTAMP '{FOREVER}') AS until FROM m2 WHERE action = 'add'),
p AS (SELECT DISTINCT url, t, host, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN [host] ELSE string_split(host, '.') END AS ls, list_filter(string_split(path, '/'), lambda x: x <> '') AS st FROM c WHERE host <> ''),
k AS (SELECT url, t, 'domain' AS kind, unnest(list_transform(range(1, len(ls) + 1), lambda i: array_to_string(ls[i:], '.'))) AS value FROM p
      UNION SELECT url, t, 'prefix', unnest(list_transform(range(0, len(st) + 1), lambda i: array_to_string(list_concat([host], st[1:i]), '/'))) FROM p),
j AS (SELECT k.url, k.t, iv.*, row_number() OVER (PARTITION BY k.url, k.t ORDER BY length(iv.value) DESC, (verdict = 'allow') DESC, list DESC, iv.value DESC, since DESC) AS rn, count(*) OVER (PARTITION BY k.url, k.t) AS n
      FROM k JOIN iv ON k.kind = iv.kind AND k.value = iv.value AND k.t >= since AND k.t < until)
SELECT c.page_id, c.url, c.t AS fetch_ts, c.host, coalesce(j.verdict, 'none') AS verdict, j.list, j.value, j.since, coalesce(j.n, 0) AS n_active
FROM c LEFT JOIN j ON j.rn = 1 AND j.url = c.url AND j.t = c.t
"""
