"""Operator 4, URL filters: a temporal list join.

Dated list entries (pattern, list_name, kind, day, action) become validity intervals: an `add`
opens one, the next `remove` (or the next `add`, which renews it) of the same pattern and list
closes it, and an open one never ends. Every capture is then evaluated as of its fetch time
against the intervals whose pattern is its host or a parent domain of it. An active `allow`
entry lifts the blocks of its own and of shorter patterns.

Each capture joins one row of its host's timeline, so a hot host makes no more rows than it has
captures. Timelines, of the hosts that the list knows, are there `SALTS` times and captures are
dealt over them, so a hot host's captures go to as many tasks. A timeline holds the entries of
one host's suffixes, which the list bounds, not the captures.

Edge cases: a null or unparsable url has a null host, no entries and blocked false; a null fetch
time matches nothing; entries with null pattern, day or action are no entries; of entries on the
same pattern, list and day the `remove` counts; repeated rows stay; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SALTS = 32
ADDED = ("host", "n_active", "active_lists", "blocked")


def host_of(url: Column) -> Column:
    """The lower-case host without user, port, leading `www.` and trailing dot; an address in brackets with them; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.|\.$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, list_name, kind, start, stop): stop is exclusive, null if the entry is still active."""
    known = entries.where("pattern is not null and day is not null and action in ('add', 'remove')")
    known = known.groupBy(F.lower("pattern").alias("pattern"), "list_name", "kind", F.col("day").cast("date").alias("start")).agg(F.max("action").alias("action"))
    order = Window.partitionBy("pattern", "list_name", "kind").orderBy("start")
    return known.withColumn("stop", F.lead("start").over(order)).where("action = 'add'").drop("action")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """`captures` with host, n_active, active_lists (comma-joined, sorted) and blocked, as of `fetched`; they replace columns of these names."""
    own = [f"c{i}" for i in range(len(captures.columns))]  # so that no name of `captures` clashes
    url, fetched = (own[captures.columns.index(c)] for c in (url, fetched))
    plain = captures.toDF(*own)
    seen = plain.withColumn("_host", host_of(F.col(url))).withColumn("_salt", F.pmod(F.xxhash64(*[c for c, kind in plain.dtypes if "map<" not in kind and kind != "variant"]), F.lit(SALTS)).cast("int"))
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = seen.where("_host is not null").select("_host").distinct().withColumn("pattern", F.explode(suffixes))
    timeline = (
        hosts.join(intervals(entries), "pattern")
        .groupBy("_host")
        .agg(F.collect_list(F.struct("list_name", "kind", "start", "stop", F.length("pattern").alias("width"))).alias("_timeline"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    day = F.to_date(F.col(fetched))
    active = F.filter("_timeline", lambda e: (e["start"] <= day) & (e["stop"].isNull() | (day < e["stop"])))
    allowed = F.array_max(F.transform(F.filter("_active", lambda e: e["kind"] == "allow"), lambda e: e["width"]))
    return (
        seen.join(timeline, ["_host", "_salt"], "left")
        .withColumn("_active", F.coalesce(active, F.array().cast("array<struct<list_name:string,kind:string,start:date,stop:date,width:int>>")))
        .withColumn("_allowed", F.coalesce(allowed, F.lit(-1)))
        .select(
            *[F.col(c).alias(n) for c, n in zip(own, captures.columns, strict=True) if n.lower() not in ADDED],
            F.col("_host").alias("host"),
            F.size("_active").cast("long").alias("n_active"),
            F.array_join(F.array_sort(F.array_distinct(F.transform("_active", lambda e: e["list_name"]))), ",").alias("active_lists"),
            F.exists("_active", lambda e: (e["kind"] == "block") & (e["width"] > F.col("_allowed"))).alias("blocked"),
        )
    )


#: The dated list of the registered query (pattern, list, kind, day, action).
ENTRIES = [
    ("casino-win.example.com", "gambling", "block", "2024-01-10", "add"),
    ("casino-win.example.com", "gambling", "block", "2024-05-01", "remove"),
    ("casino-win.example.com", "gambling", "block", "2024-08-15", "add"),
    ("free-bets.example.com", "gambling", "block", "2024-02-01", "add"),
    ("cheap-pills.example.com", "pharma", "block", "2024-03-01", "add"),
    ("cheap-pills.example.com", "spam", "block", "2024-03-20", "add"),
    ("cheap-pills.example.com", "spam", "block", "2024-09-01", "remove"),
    ("example.org", "parked", "block", "2024-06-01", "add"),
    ("example.org", "parked", "block", "2024-07-01", "remove"),
    ("blog.ththth.example.org", "partners", "allow", "2024-06-10", "add"),
    ("tionsh.example.net", "spam", "block", "2024-04-01", "add"),
    ("tionsh.example.net", "spam", "block", "2024-10-01", "remove"),
    ("m.ththha.example.net", "partners", "allow", "2024-01-01", "add"),
    ("example.net", "parked", "block", "2024-11-01", "add"),
]
FIRST_DAY, DAYS, STRIDE = "2024-01-01", 366, 7919
