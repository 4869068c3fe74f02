"""URL filters as a sort-merge range join, in DataFrame functions only.

A rule (host, path) covers its host and all subdomains where the URL's path
starts with the rule's. Every URL is a point under each of its ancestor hosts
that has a rule; the canonical key is the reversed ancestor host, ``/`` and the
path, so a rule covers exactly the keys that start with its own key: an
interval. Rule starts, rule ends and points are dealt by range of the key and
sorted; a running count of open intervals is the depth of the stack, and the
rule on top of it is the last one opened at that depth. What is open where a
range begins comes from counts per range (one row per range and depth), so no
range waits for another and one host may fill many ranges.

Defined results
---------------
* null url or url without ``://``: host and path are empty.
* no rule fits: rule null, the default verdict.
* several rules fit: the longest (host and path together); of equal length the
  longer host.
* repeated rules count once; the same rule with both verdicts blocks. Rules
  with a null or empty host fit nothing; a null path is the empty path, which
  fits every path. Any character may stand in a path, U+10FFFF too.
* repeated pages keep one row each. Empty tables: empty result, or the default
  verdict everywhere. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import saved

ALLOW, BLOCK = "allow", "block"


def split_url(url):
    """(host, path) columns of a url column: after the first ://, A-Z of the host lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host):
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def key(host, path):
    """Canonical key, as bytes: no host holds a ``/``, so keys of one host are neighbours and prefixes of paths are prefixes of keys."""
    return F.encode(F.concat(reversed_host(host), F.lit("/"), path), "UTF-8")


def ancestors(host):
    """The host and the hosts above it: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def on_top(events: DataFrame) -> DataFrame:
    """Points with the rule on top of the stack.

    ``events``: key, kind (0 rule ends, 1 rule starts, 2 point), rule, host,
    path. Keys are UTF-8 bytes. An end has the key of its rule followed by 0xFF,
    a byte that no text holds, so it sorts after every key the rule covers.
    """
    # the hash lets points of one key fill several ranges
    dealt = events.repartitionByRange(F.col("key"), F.col("kind"), F.col("rank"), F.xxhash64("host", "path"))
    dealt = saved(dealt.withColumn("part", F.spark_partition_id()), "url-events")
    in_order = Window.partitionBy("part").orderBy("key", "kind", "rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)
    # depth at which each range begins: one row per range, so small enough to broadcast
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opened = (dealt.groupBy("part").agg(F.sum(step).alias("net"))
              .select("part", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("base")))
    deep = (dealt.join(F.broadcast(opened), "part")
            .withColumn("depth", F.col("base") + F.sum(step).over(in_order)))
    same_depth = Window.partitionBy("part", "depth").orderBy("key", "kind", "rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    started = F.when(F.col("kind") == 1, F.struct("rule_host", "rule_path"))
    local = deep.withColumn("top", F.last(started, ignorenulls=True).over(same_depth))
    # the last rule opened at each depth before a range: ranges times depths rows
    rules = deep.where("kind = 1").groupBy("part", "depth").agg(
        F.max_by(F.struct("rule_host", "rule_path"), F.struct("key", "rank")).alias("last"))
    grid = (deep.where("kind = 2 AND depth > 0").select("part", "depth").distinct()
            .withColumn("last", F.lit(None).cast("struct<rule_host:string,rule_path:string>"))
            .withColumn("asks", F.lit(1)).unionByName(rules.withColumn("asks", F.lit(0))))
    earlier = Window.partitionBy("depth").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    carried = (grid.withColumn("carried", F.last("last", ignorenulls=True).over(earlier))
               .where("asks = 1").select("part", "depth", "carried"))
    return (local.where("kind = 2 AND depth > 0").join(carried, ["part", "depth"], "left")
            .select("host", "path", F.coalesce("top", "carried").alias("rule")))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``rules`` holds host, path, verdict."""
    host, path = split_url(F.col("url"))
    seen = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rules = (rules.where("host IS NOT NULL AND host <> ''")
             .select(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
             .groupBy("rule_host", "rule_path")
             .agg(F.when(F.max((F.col("verdict") == BLOCK).cast("int")) == 1, BLOCK).otherwise(ALLOW).alias("verdict")))
    points = seen.where("host <> ''").distinct()
    hosts = rules.select(F.col("rule_host").alias("above")).distinct()
    under = (points.withColumn("above", F.explode(ancestors(F.col("host")))).join(hosts, "above")
             .select(key(F.col("above"), F.col("path")).alias("key"), F.lit(2).alias("kind"), F.lit(0).alias("rank"),
                     F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("string").alias("rule_path"),
                     "host", "path"))
    start = key(F.col("rule_host"), F.col("rule_path"))
    none = F.lit(None).cast("string")
    # starts of one key: shorter rules first (keys differ unless the rules are equal)
    opens = rules.select(start.alias("key"), F.lit(1).alias("kind"), F.length("rule_path").alias("rank"),
                         "rule_host", "rule_path", none.alias("host"), none.alias("path"))
    # ends of one key: the deepest rule closes first
    closes = rules.select(F.concat(start, F.lit(b"\xff")).alias("key"), F.lit(0).alias("kind"),
                          (-F.length("rule_path")).alias("rank"),
                          "rule_host", "rule_path", none.alias("host"), none.alias("path"))
    found = on_top(under.unionByName(opens).unionByName(closes))
    longest = (found.select("host", "path", "rule.*")
               .groupBy("host", "path")
               .agg(F.max_by(F.struct("rule_host", "rule_path"),
                             F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("r"))
               .select("host", "path", "r.*").join(rules, ["rule_host", "rule_path"])
               .select("host", "path", F.concat("rule_host", "rule_path").alias("rule"), "verdict"))
    return seen.join(longest, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


# The rules of the registered query: (host, path, verdict).
RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK),
         ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK)]

RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

ORACLE = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {RULES_SQL}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fits AS (
  SELECT p.page_id, p.host, p.path, r.rule_host, r.rule_path, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host) + length(r.rule_path) DESC NULLS LAST,
                            length(r.rule_host) DESC) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, '{ALLOW}') AS verdict
FROM fits WHERE place = 1
"""
