"""URL filters: a sort-merge range join of urls with prefix rules.

A host is written as a canonical key of its labels in reverse order, each ended by a dot (``www.example.org`` ->
``org.example.www.``). A rule for a host and all its subdomains is then the interval of keys that begin with the
rule's key, and intervals nest or are disjoint. Urls and rules are dealt out by ranges of (key, path, id): range
borders come from a small sample (they affect the balance only), a rule goes to every range that its interval
meets, and each range is sorted and swept once. The sweep keeps the stack of the rules whose intervals are open;
for a url it asks each open host for the longest of its rule paths that begins the url's path.

A hot host is split, since the borders also look at the path and the row's id.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import ascii_lower
from pairforge.session import ensure_checkpoint_dir

TOP = "\U0010ffff"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _borders(rows: DataFrame, parts: int, per_part: int = 64) -> list[str]:
    """At most ``parts - 1`` range borders from a sample of about ``per_part * parts`` sort keys."""
    n = rows.count()
    if parts <= 1 or n == 0:
        return []
    got = rows.sample(min(1.0, per_part * parts / n), seed=7).select("_s").limit(4 * per_part * parts).collect()
    keys = sorted(r[0] for r in got)
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def _deal_rules(rules: DataFrame, borders: list[str]) -> DataFrame:
    """Each rule once for every range that its interval meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pid, at = [], []
            for i, key in enumerate(b.column("_s").to_pylist()):
                for p in range(bisect.bisect_right(borders, key), bisect.bisect_left(borders, key + TOP) + 1):
                    pid.append(p)
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), *b.take(pa.array(at, pa.int64())).columns],
                                             names=["_pid", *b.schema.names])
    return rules.mapInArrow(run, "_pid int, _s string, _kind int, _id long, _host string, _path string, _verdict string")


def _deal_urls(urls: DataFrame, borders: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pid = [bisect.bisect_right(borders, s) for s in b.column("_s").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), *b.columns], names=["_pid", *b.schema.names])
    return urls.mapInArrow(run, "_pid int, _s string, _kind int, _id long, _host string, _path string, _verdict string")


class _Open:
    """The rules of one open host: paths by text, and their lengths, longest first."""

    def __init__(self, key: str):
        self.key, self.rules, self.lengths = key, {}, []

    def add(self, path: str, host: str, verdict: str) -> None:
        old = self.rules.get(path)
        self.rules[path] = (host, min(verdict, old[1], key=lambda v: v != "block") if old else verdict)
        if not old and len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> tuple[int, str, str] | None:
        for n in self.lengths:
            if n <= len(path) and (hit := self.rules.get(path[:n])):
                return n + len(hit[0]), hit[0] + path[:n], hit[1]
        return None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[_Open] = []
    pid = None
    for b in batches:
        ids, hosts, paths, rules, verdicts = [], [], [], [], []
        for p, s, kind, i, host, path, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if p != pid:
                stack, pid = [], p
            while stack and not s.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != s:
                    stack.append(_Open(s))
                stack[-1].add(path, host, verdict)
                continue
            # a longer rule wins; among equally long ones the deeper host, which is later in the stack
            best = None
            for o in stack if host else ():
                hit = o.longest(path)
                if hit and (best is None or hit[0] >= best[0]):
                    best = hit
            ids.append(i)
            hosts.append(host)
            paths.append(path)
            rules.append(best and best[1])
            verdicts.append(best and best[2])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))],
                                         names=["id", "host", "path", "rule", "verdict"])


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Judge every url by the longest fitting rule.

    ``rules`` has (host, path, verdict). A rule fits a url whose host is the rule's or a subdomain of it and whose path
    begins with the rule's; the longest text ``host + path`` wins, then the deeper host, and of two equal rules
    the one that blocks. Rules with a null or empty host fit nothing; a null rule path counts as empty, a null
    verdict as ``block``. A url that is null or has no ``://`` has an empty host and path, and no rule fits an empty
    host. Urls without a rule get ``rule`` null and the ``default`` verdict. Repeated rows are judged each; empty
    tables give empty results; a null id stays null. Only the named columns are read.

    Returns (id_col, host, path, rule, verdict).
    """
    spark = urls.sparkSession
    ensure_checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    u = urls.select(F.col(id_col).cast("long").alias("_id"), url_host(F.col(url_col)).alias("_host"),
                    url_path(F.col(url_col)).alias("_path"))
    sort_key = F.concat(host_key(F.col("_host")), F.lit("\t"), F.col("_path"), F.lit("\t"),
                        F.lpad(F.coalesce(F.col("_id"), F.lit(0)).cast("string"), 20, "0"))
    u = u.select(sort_key.alias("_s"), F.lit(1).alias("_kind"), "_id", "_host", "_path", F.lit(None).cast("string").alias("_verdict"))
    r = rules.select(ascii_lower(F.col("host")).alias("_host"), F.coalesce(F.col("path"), F.lit("")).alias("_path"),
                     F.coalesce(F.col("verdict"), F.lit("block")).alias("_verdict")).filter(F.coalesce(F.col("_host"), F.lit("")) != "")
    r = r.select(host_key(F.col("_host")).alias("_s"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_id"),
                 "_host", "_path", "_verdict")
    borders = _borders(u, parts)
    dealt = _deal_urls(u, borders).unionByName(_deal_rules(r, borders))
    # ranges are sorted and swept whole; a partition may hold several ranges, told apart by _pid
    swept = (dealt.repartition(parts, "_pid").sortWithinPartitions("_pid", "_s", "_kind", "_path")
             .mapInArrow(_sweep, "id long, host string, path string, rule string, verdict string"))
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
