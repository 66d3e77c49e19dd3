"""URL allow and block rules by a sort-merge range join on reversed-host keys.

A rule ``host/path`` fits its host and all subdomains, where the url's path starts with the rule's. The canonical
key of (host, path) is the host's labels in reverse, ``/``, and the path; keys compare as bytes. A rule is the interval
of keys that start with its own key, so intervals are disjoint or nested. A url asks once for each domain above its host. Asked
keys and interval ends are sorted together in key ranges, and one sweep over each range keeps the stack of active
rules: the running depth, and for each depth the rule that opened it last. The top of the stack is the longest fitting
rule of that domain; the longest over a url's domains wins (then the longer host, then block before allow).

DataFrame functions only. Distinct (host, path) pairs are swept, so a url that many pages share is one key; range
bounds come from a sample of at most ``SAMPLE`` keys; a rule that spans ranges is opened in each.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule, and the default verdict; so has a
url that no rule fits. Repeated pages are kept. Of rules with one key the verdict block stays. Null rules are
ignored. Empty tables give empty results or default verdicts. Other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are sampled for the bounds of ranges.
SAMPLE = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; path up to ``?``, ``#`` or end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _bytes(s: Column) -> Column:
    return s.cast("binary")


def rule_intervals(rules: DataFrame) -> DataFrame:
    """(rule, verdict, rule_host, key, stop) of rules (rule string, verdict string), one for each key."""
    host = F.translate(F.regexp_extract("rule", r"^[^/]*", 0), UPPER, LOWER)
    path = F.expr("substring(rule, length(regexp_extract(rule, '^[^/]*', 0)) + 1)")
    named = rules.where("rule is not null and verdict is not null").select("rule", "verdict", host.alias("rule_host"), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("/"), path).alias("name"))
    one = named.groupBy("name", "rule_host").agg(F.max_by(F.struct("rule", "verdict"), F.struct("verdict", "rule")).alias("r"))
    return one.select("r.rule", "r.verdict", "rule_host", _bytes(F.col("name")).alias("key"), F.concat(_bytes(F.col("name")), F.lit(bytearray(b"\xff"))).alias("stop"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    spark = pages.sparkSession
    host, path = host_path(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    pairs = parsed.select("host", "path").distinct()
    labels = F.reverse(F.split("host", r"\."))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    asked = pairs.select("host", "path", F.explode(domains).alias("domain")).select("host", "path", _bytes(F.concat("domain", F.lit("/"), "path")).alias("pos"))
    sample = asked.select("pos").orderBy(F.xxhash64("pos"), "pos").limit(SAMPLE).collect()
    keys = sorted({bytes(r["pos"]) for r in sample})
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    bounds = [keys[i * len(keys) // parts] for i in range(1, parts) if keys]
    bounds = sorted(set(bounds))
    lows = F.array(F.lit(bytearray(b"")), *[F.lit(bytearray(b)) for b in bounds])
    range_of = lambda c: F.size(F.filter(lows, lambda b: b <= c)) - 1

    spans = rule_intervals(rules).select("*", range_of(F.col("key")).alias("r0"), range_of(F.col("stop")).alias("r1"))
    opened = spans.select("rule", "verdict", "rule_host", "key", "stop", "r0", "r1", F.explode(F.sequence("r0", "r1")).alias("part"))
    none = F.lit(None).cast("string")
    opens = opened.select("part", F.greatest("key", F.get(lows, F.col("part"))).alias("pos"), F.lit(1).alias("kind"), F.length("key").alias("size"), "rule", "verdict", "rule_host", none.alias("host"), none.alias("path"))
    closes = spans.select(F.col("r1").alias("part"), F.col("stop").alias("pos"), F.lit(0).alias("kind"), (-F.length("key")).alias("size"), none.alias("rule"), none.alias("verdict"), none.alias("rule_host"), none.alias("host"), none.alias("path"))
    edges = opens.unionByName(closes)
    sweep = Window.partitionBy("part").orderBy("pos", "kind", "size").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)).over(sweep)
    deepest = edges.select(depth.alias("d")).agg(F.max("d")).first()[0] or 0
    if not deepest:
        return parsed.select(id_col, "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    urls = asked.select(range_of(F.col("pos")).alias("part"), "pos", F.lit(2).alias("kind"), F.lit(0).alias("size"), none.alias("rule"), none.alias("verdict"), none.alias("rule_host"), "host", "path")
    swept = edges.unionByName(urls).withColumn("depth", depth)
    opener = F.struct("rule", "verdict", "rule_host")
    stack = [F.last(F.when((F.col("kind") == 1) & (F.col("depth") == d), opener), ignorenulls=True).over(sweep) for d in range(1, deepest + 1)]
    top = reduce(lambda rest, d: F.when(F.col("depth") == d + 1, stack[d]).otherwise(rest), range(deepest), F.lit(None).cast("struct<rule:string,verdict:string,rule_host:string>"))
    fitting = swept.select("kind", "host", "path", top.alias("top")).where("kind = 2 and top is not null")
    order = F.struct(F.length("top.rule"), F.length("top.rule_host"), F.col("top.verdict"), F.col("top.rule"))
    best = fitting.groupBy("host", "path").agg(F.max_by("top", order).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
