"""URL rules by a sort-merge range join.

A host is written label by label from its end (``www.example.net`` becomes
``net.example.www.``), so "this host and all its subdomains" is a prefix of the
key, that is an interval of the sorted keys.  Rules and addresses are sorted
together, and a sweep over the sorted keys keeps the stack of active nested
rules: one slot per nesting depth, each holding the last rule of that depth
that began.  A slot is active when its rule is a prefix of the key.
(If p is the prefix of key k with depth d, every key between p and k starts
with p, so the last rule of depth d before k is p itself or p is no rule.)

The sweep runs twice: over distinct hosts, and over distinct (rule host, path)
for path prefixes.  Both work on distinct keys, so a hot host is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.common import own_names, write_table

_SEP = "\u0001"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    low = F.translate(_host_raw(url), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def _host_raw(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*", 0)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substr(_rest(url), F.length(_host_raw(url)) + 1)
    return F.coalesce(F.regexp_extract(rest, "^[^?#]*", 0), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def sweep(probes: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """(key, stack): for every distinct ``key`` of ``probes`` the active ``rules``, outermost first.

    ``rules`` has key, depth (of nesting; equal depths never nest) and payload (comparable
    and the same for one key).  Depths are few (labels of a host, lengths of rule paths), and
    only they reach the driver.  Keys are range-partitioned into blocks; each block sweeps on its
    own and takes the stack at its start from one row per block.
    """
    depths = [r[0] for r in rules.select("depth").distinct().orderBy("depth").collect()]
    kind = rules.schema["payload"].dataType
    if not depths:
        none = F.array().cast(f"array<struct<key:string,payload:{kind.simpleString()}>>")
        return probes.select("key", none.alias("stack"))
    events = rules.select("key", F.lit(0).alias("_probe"), "depth", "payload").unionByName(
        probes.select("key", F.lit(1).alias("_probe"), F.lit(None).cast(rules.schema["depth"].dataType).alias("depth"), F.lit(None).cast(kind).alias("payload"))
    )
    # written, so that the block numbers are the same for every reader
    blocks, _ = write_table(
        events.repartitionByRange("key", "_probe").withColumn("_block", F.spark_partition_id()), f"{name}-blocks"
    )
    slot = {d: F.when(F.col("depth") == d, F.struct("key", "payload")) for d in depths}
    # carry: the last rule of each depth in the blocks before; one row per block, so one small task
    tops = blocks.groupBy("_block").agg(*[F.max(slot[d]).alias(f"t{i}") for i, d in enumerate(depths)])
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select("_block", *[F.last(f"t{i}", ignorenulls=True).over(earlier).alias(f"c{i}") for i in range(len(depths))])
    begun = Window.partitionBy("_block").orderBy("key", "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = blocks.select(
        "key", "_probe", "_block", *[F.last(slot[d], ignorenulls=True).over(begun).alias(f"s{i}") for i, d in enumerate(depths)]
    )
    stack = F.filter(
        F.array(*[F.coalesce(f"s{i}", f"c{i}") for i in range(len(depths))]),
        lambda s: s.isNotNull() & F.col("key").startswith(s["key"]),
    )
    return swept.where("_probe = 1").join(carry, "_block").select("key", stack.alias("stack"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names are replaced).

    ``rules`` has rule (``host/path``; no slash: empty path) and verdict.  A rule fits its
    host and all subdomains when the page's path starts with the rule's; the longest rule
    string wins, then the longer host.  Of equal rules with two verdicts the greater (block)
    holds; null rules are ignored.  A null url, or one without ``://``, has empty host and path,
    fits no rule and gets ``default``.  Repeated urls are judged once and joined back.
    """
    own = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    cut = F.instr("rule", "/")
    own = own.select(
        "rule", "verdict",
        F.when(cut > 0, F.substr("rule", F.lit(1), cut - 1)).otherwise(F.col("rule")).alias("_host"),
        F.when(cut > 0, F.substr("rule", cut)).otherwise(F.lit("")).alias("_path"),
    ).where("_host <> ''").withColumn("_hkey", host_key(F.col("_host")))
    split = pages.select(url_host(F.col(url_col)).alias("_host"), url_path(F.col(url_col)).alias("_path"))
    places = split.where("_host <> ''").distinct()

    by_host = own.select(
        F.col("_hkey").alias("key"), F.size(F.split("_hkey", "[.]", -1)).alias("depth"), F.col("_host").alias("payload")
    ).distinct()
    hosts = places.select("_host").distinct().withColumn("key", host_key(F.col("_host")))
    active = sweep(hosts.select("key"), by_host, "url-hosts")
    # the rule hosts over each host: at most one per label
    over = hosts.join(active, "key").select("_host", F.explode("stack.key").alias("_hkey"))
    tries = places.join(over, "_host").withColumn("key", F.concat("_hkey", F.lit(_SEP), "_path"))

    by_path = own.select(
        F.concat("_hkey", F.lit(_SEP), "_path").alias("key"),
        F.length("_path").alias("depth"),
        F.struct(F.length("rule").alias("n"), F.length("_host").alias("h"), "rule", "verdict").alias("payload"),
    )
    fits = sweep(tries.select("key").distinct(), by_path, "url-paths").where(F.size("stack") > 0)
    host, path, found = own_names("host", "path", "best")
    best = (
        tries.join(fits.select("key", F.try_element_at("stack", F.lit(-1))["payload"].alias("best")), "key")
        .groupBy(F.col("_host").alias(host), F.col("_path").alias(path))
        .agg(F.max("best").alias(found))
    )
    judged = pages.drop("host", "path", "rule", "verdict").withColumns(
        {"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))}
    )
    on = (F.col("host") == F.col(host)) & (F.col("path") == F.col(path))
    return (
        judged.join(best, on, "left")
        .withColumns({"rule": F.col(f"{found}.rule"), "verdict": F.coalesce(f"{found}.verdict", F.lit(default))})
        .drop(host, path, found)
    )
