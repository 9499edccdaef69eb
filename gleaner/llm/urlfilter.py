"""Temporal list join: dated list entries become validity intervals that captures are joined with as of their fetch.

An entry (list_name, kind, pattern, action, dated) adds or removes a pattern from its date on. Between one entry of
a pattern and the next lies an interval; those that begin with an `add` are active. kind `host` matches the host
and all hosts below it, kind `url` the host with a path that begins with the pattern at a slash. A capture
looks up the suffixes of its host and the prefixes of its path, at the depths that the list has, among the intervals
that may hold its fetch time.

Intervals lie in buckets of days: an interval of at most BUCKET_DAYS days in one or two buckets of that width, a
longer one in at most five of the first width, each FACTOR times the last, of which it needs no more. So an
interval is at most five rows whatever days it spans, and a pattern with a long history costs a capture
one bucket of each width in use. An interval that is still open is one row without a bucket, and a pattern has
one at most. The join's hot keys (a very common host) are rows of captures, which adaptive execution splits;
captures are reduced to one verdict each with map-side partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small

BUCKET_DAYS = 64
FACTOR = 4


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; empty if there is none."""
    return F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#].*)?$", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """Active intervals (list_name, kind, pattern, entry_id, from_day, to_day); to_day is null while the entry stands.

    Days are whole days since 1970. Of one pattern's entries on one day the last by entry_id counts. Entries
    with a null in kind, pattern, action or day, and of other actions than add and remove, don't count.
    """
    rows = entries.select("list_name", "kind", "pattern", "entry_id", "action", F.col("day").cast("int").alias("from_day"))
    rows = rows.where("kind in ('host', 'url') and pattern <> '' and action in ('add', 'remove') and from_day is not null")
    own = Window.partitionBy("list_name", "kind", "pattern").orderBy("from_day", "entry_id")
    rows = rows.withColumn("to_day", F.lead("from_day").over(own))
    return rows.where("action = 'add' and (to_day is null or to_day > from_day)").drop("action")


def _marks(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def depth(kind: Column, pattern: Column) -> Column:
    """Dots of a host pattern, slashes of a url pattern."""
    return F.when(kind == "host", _marks(pattern, ".")).otherwise(_marks(pattern, "/"))


def lookup_keys(host: Column, path: Column, depths: dict[str, list[int]]) -> Column:
    """array<struct<kind, name>> of what could list this host and path at the depths that a list has; empty without a host.

    name is the md5 of the host's suffix or of the path's prefix. Only listed depths are cut out, each in one pass.
    """
    whole = F.concat(host, F.rtrim(path, F.lit("/")))
    address = host.rlike(r"^[0-9.]+$|^\[")

    def key(kind: str, text: Column, mark: str, d: int) -> Column:
        found = F.struct(F.lit(kind).alias("kind"), F.md5(F.substring_index(text, mark, -d - 1 if kind == "host" else d + 1)).alias("name"))
        fits = (_marks(text, mark) == d) | ((_marks(text, mark) > d) & (~address if kind == "host" else F.lit(True)))  # of an address only the whole
        return F.when((host != "") & fits, found)

    keys = [key("host", host, ".", d) for d in depths["host"]] + [key("url", whole, "/", d) for d in depths["url"]]
    return F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else F.array().cast("array<struct<kind: string, name: string>>")


def verdicts(captures: DataFrame, active: DataFrame) -> DataFrame:
    """One row per capture (capture_id, url, day): and host, blocked, list_name, entry_id, from_day of the match that decides.

    Of several matches a url pattern goes before a host, then the longer pattern, then the smaller list
    name and entry id. A capture looks up the depths that the list's patterns have, a few numbers. Captures with a null or unusable url or a null day match nothing. Captures that are
    equal in id, url and day are one. No captures: no rows; no entries: nothing is blocked.
    """
    listed = active.select("kind", depth(F.col("kind"), F.col("pattern")).alias("d")).distinct().collect()  # a number for each depth
    depths = {kind: sorted(r.d for r in listed if r.kind == kind) for kind in ("host", "url")}
    host, path = host_of(F.coalesce("url", F.lit(""))), path_of(F.coalesce("url", F.lit("")))
    # A url goes by its md5 from here on; it comes back with the capture's own row.
    captures = captures.select("capture_id", F.md5("url").alias("u"), F.col("day").cast("int").alias("day"), "url", host.alias("host"), path.alias("path"))
    keys = captures.select("capture_id", "u", "day", F.explode(lookup_keys(F.col("host"), F.col("path"), depths)).alias("key"))
    keys = keys.select("capture_id", "u", "day", "key.kind", "key.name")
    spans = active.where("to_day is null or to_day > from_day").select("kind", "pattern", "list_name", "entry_id", F.col("from_day").cast("long"), F.col("to_day").cast("long"))
    size = F.greatest(F.lit(1.0), (F.col("to_day") - F.col("from_day")) / (FACTOR * BUCKET_DAYS))
    # Widths as multiples of BUCKET_DAYS; 0: open.
    spans = spans.withColumn("width", F.when(F.col("to_day").isNull(), 0).otherwise(F.pow(F.lit(FACTOR), F.ceil(F.log(float(FACTOR), size) - 1e-9))).cast("long"))
    bucket = lambda day, width: F.floor(day / (F.lit(BUCKET_DAYS) * width)).cast("long")
    within = F.sequence(bucket(F.col("from_day"), F.greatest("width", F.lit(1))), bucket(F.col("to_day") - 1, F.greatest("width", F.lit(1))))
    spans = spans.select("*", F.explode(F.when(F.col("width") == 0, F.array(F.lit(0).cast("long"))).otherwise(within)).alias("bucket"))
    widths = [r.width for r in spans.select("width").distinct().collect()]  # 17 at most
    looked = F.explode(F.array(*(F.lit(w).cast("long") for w in widths)) if widths else F.array(F.lit(0).cast("long"))).alias("width")
    keys = keys.select("*", looked)
    keys = keys.withColumn("bucket", F.when(F.col("width") == 0, F.lit(0).cast("long")).otherwise(bucket(F.col("day"), F.greatest("width", F.lit(1)))))
    spans = spans.withColumn("name", F.md5("pattern")).withColumn("size", -F.length("pattern")).drop("pattern")
    met = keys.join(small(spans, 50_000), ["kind", "name", "width", "bucket"]).where("from_day <= day and (to_day is null or day < to_day)")
    order = F.struct((F.col("kind") == "host").alias("is_host"), "size", "list_name", "entry_id", "from_day")
    met = met.select("capture_id", "u", "day", order.alias("m"))
    own = captures.select("capture_id", "u", "day", "url", "host").unionByName(met, allowMissingColumns=True)
    out = own.groupBy("capture_id", "u", "day").agg(F.max("url").alias("url"), F.max("host").alias("host"), F.min("m").alias("m"))
    return out.select(
        "capture_id", "url", "day", "host", F.col("m").isNotNull().alias("blocked"), F.col("m.list_name").alias("list_name"),
        F.col("m.entry_id").alias("entry_id"), F.col("m.from_day").cast("int").alias("from_day"),
    )


#: Day of 2024-01-01, with which the tables' captures and entries begin.
FIRST_DAY = 19_723


def table_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch time: a day of 2024 that follows from page_id."""
    day = F.lit(FIRST_DAY) + F.pmod(F.col("page_id") * 7919, F.lit(366))
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.cast("int").alias("day"))


def table_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages table, by a rule on their md5.

    A third of the hosts enter the host list, leave it 90 days later and return after another 60; hosts
    of another rule get entries for their /en and /de paths in the url list.
    """
    hosts = pages.select(host_of(F.coalesce("url", F.lit(""))).alias("host")).where("host <> ''").distinct()
    code = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    hosts = hosts.withColumn("code", code).withColumn("start", F.lit(FIRST_DAY) + F.pmod("code", F.lit(200)))
    entry = lambda name, kind, pattern, step, action, day: F.struct(
        F.lit(name).alias("list_name"), F.lit(kind).alias("kind"), pattern.alias("pattern"),
        (F.col("code") * 8 + step).cast("long").alias("entry_id"), F.lit(action).alias("action"), day.alias("day"),
    )
    host, start = F.col("host"), F.col("start")
    by_host = F.when(F.col("code") % 3 == 0, F.array(
        entry("hosts", "host", host, 0, "add", start), entry("hosts", "host", host, 1, "remove", start + 90), entry("hosts", "host", host, 2, "add", start + 150),
    ))
    by_path = F.when(F.col("code") % 4 == 1, F.array(
        entry("paths", "url", F.concat(host, F.lit("/en")), 3, "add", start + 30), entry("paths", "url", F.concat(host, F.lit("/de")), 4, "add", start + 10),
        entry("paths", "url", F.concat(host, F.lit("/de")), 5, "remove", start + 40),
    ))
    none = F.array().cast("array<struct<list_name:string,kind:string,pattern:string,entry_id:bigint,action:string,day:int>>")
    return hosts.select(F.explode(F.concat(F.coalesce(by_host, none), F.coalesce(by_path, none))).alias("e")).select("e.*")


SQL = rf"""
WITH c AS (SELECT page_id, url, {FIRST_DAY} + (page_id * 7919) % 366 AS day, trim(coalesce(url, '')) AS u FROM pages),
c2 AS (SELECT *, regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#].*)?$', 1) AS host,
  regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM c),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 6))::INT AS code FROM (SELECT DISTINCT host FROM c2 WHERE host <> '')),
e AS (
  SELECT 'hosts' AS list_name, 'host' AS kind, host AS pattern, code * 8 + s AS entry_id, a AS action, {FIRST_DAY} + code % 200 + d AS day
    FROM h, (VALUES (0, 'add', 0), (1, 'remove', 90), (2, 'add', 150)) AS t(s, a, d) WHERE code % 3 = 0
  UNION ALL SELECT 'paths', 'url', host || p, code * 8 + s, a, {FIRST_DAY} + code % 200 + d
    FROM h, (VALUES (3, '/en', 'add', 30), (4, '/de', 'add', 10), (5, '/de', 'remove', 40)) AS t(s, p, a, d) WHERE code % 4 = 1),
v AS (SELECT *, lead(day) OVER (PARTITION BY list_name, kind, pattern ORDER BY day, entry_id) AS until FROM e),
m AS (SELECT c2.page_id, c2.url, v.* FROM c2 JOIN v ON v.action = 'add' AND v.day <= c2.day AND (v.until IS NULL OR c2.day < v.until)
  AND ((v.kind = 'host' AND (c2.host = v.pattern OR ends_with(c2.host, '.' || v.pattern)))
    OR (v.kind = 'url' AND (c2.host || c2.path = v.pattern OR starts_with(c2.host || c2.path, v.pattern || '/'))))),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY kind = 'host', -length(pattern), list_name, entry_id) = 1)
SELECT DISTINCT c2.page_id AS capture_id, c2.url, cast(c2.day AS INT) AS day, c2.host, b.entry_id IS NOT NULL AS blocked, b.list_name, cast(b.entry_id AS BIGINT) AS entry_id,
  cast(b.day AS INT) AS from_day FROM c2 LEFT JOIN b ON b.page_id = c2.page_id AND b.url = c2.url"""
