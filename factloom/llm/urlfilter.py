"""URL rules by a sort-merge range join over reversed-host keys.

A host's key is its labels from last to first, each closed by ``CLOSE``, a character below all that labels
hold (lower ones are escaped); so the keys of a host and its subdomains are one interval, and intervals are nested or apart. Rules
and URLs are dealt out by ranges of keys and sorted; a sweep keeps a stack of the rules' hosts whose
intervals are open, and asks them for the longest rule whose path the URL's path begins with.

Ranges come from a bounded sample of the URLs' keys and only balance the work. Keys are followed by a hash
of the row, so one host with a third of all rows is spread over many ranges; a rule goes to every range
that its interval meets, which beyond the first is as many as are nested at the ranges' bounds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE, AFTER = "\x01", "\x02"  # a key's prefix k spans [k, k with its last CLOSE as AFTER)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Characters up to U+0003 in a host are written as U+0003 and a digit, so none of them reads as ``CLOSE`` or ``AFTER``."""
    plain = host
    for digit, char in (("3", "\x03"), ("0", "\x00"), ("1", CLOSE), ("2", AFTER)):
        plain = F.replace(plain, F.lit(char), F.lit("\x03" + digit))
    labels = F.reverse(F.split(F.when(host.rlike(r"[\x00-\x03]"), plain).otherwise(host), r"\."))
    return F.concat(F.array_join(labels, CLOSE), F.lit(CLOSE))


def _bounds(keys: DataFrame, ranges: int, sample: int) -> list[tuple[str, int]]:
    """Up to ``ranges - 1`` bounds (key, spread), from about ``sample`` rows."""
    n = keys.count()
    if ranges < 2 or not n:
        return []
    rows = sorted(tuple(r) for r in keys.sample(fraction=min(1.0, sample / n), seed=7).limit(2 * sample).collect())
    return sorted({rows[len(rows) * i // ranges] for i in range(1, ranges)}) if rows else []


def _range_of(bounds: list, kind: str) -> Callable:
    """Adds ``range`` to each row; a rule comes out once for each range that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            if kind == "url":
                at = [bisect_right(bounds, place) for place in zip(keys, batch.column("spread").to_pylist(), strict=True)]
                pick = None
            else:
                spans = [(bisect_left(bounds, (k,)), bisect_left(bounds, (k[:-1] + AFTER,))) for k in keys]
                at = [r for a, b in spans for r in range(a, b + 1)]
                pick = [i for i, (a, b) in enumerate(spans) for _ in range(a, b + 1)]
            out = batch if pick is None else batch.take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *out.columns], ["range", *out.schema.names])

    return run


class _Active:
    """The rules of one host: verdict by path, and the lengths that occur."""

    def __init__(self, key: str):
        self.end, self.rules, self.lengths = key[:-1] + AFTER, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.rules:
            self.rules[path] = (rule, verdict)
            self.lengths = sorted({*self.lengths, len(path)}, reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        for n in self.lengths:
            if n <= len(path) and (found := self.rules.get(path[:n])):
                return found
        return None


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, key and kind (rules first) -> id, host, path, rule and verdict of each URL."""
    stack: list[tuple[str, _Active]] = []
    at = None
    for batch in batches:
        col = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        out: list[list] = [[], [], [], [], []]
        for i, key in enumerate(col["key"]):
            if col["range"][i] != at:
                at, stack = col["range"][i], []
            while stack and key >= stack[-1][1].end:
                stack.pop()
            if col["rule"][i] is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, _Active(key)))
                stack[-1][1].add(col["path"][i], col["rule"][i], col["verdict"][i])
                continue
            fits = [found for _, active in stack if (found := active.longest(col["path"][i]))]
            rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))  # of equal lengths the outer host's
            for values, value in zip(out, (col["id"][i], col["host"][i], col["path"][i], rule, verdict), strict=True):
                values.append(value)
        kinds = [batch.schema.field("id").type] + [pa.string()] * 4
        yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["id", "host", "path", "rule", "verdict"])


def filter_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", ranges: int | None = None, sample: int = 20_000
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` for each row of ``pages``.

    ``rules`` has host, path and verdict; a rule fits its host and all subdomains where the URL's path begins
    with its path. The longest rule text (host and path) wins, of equally long ones the shorter host's; of
    the same rule given twice the least verdict. Rules with a null host, path or verdict are left out. Null
    URLs and those without ``://`` have an empty host and path, which a rule with an empty host fits alone.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col).cast("string")
    urls = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("spread", F.xxhash64("id", "path", F.monotonically_increasing_id()))  # equal rows spread too
    none = F.lit(None).cast("string")
    urls = urls.select("key", "spread", "id", "host", "path", none.alias("rule"), none.alias("verdict"))
    kind = pages.schema[id_col].dataType
    clean = rules.where("host is not null and path is not null and verdict is not null")
    clean = clean.groupBy(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
    told = clean.select(
        host_key(F.col("host")).alias("key"), F.lit(None).cast("long").alias("spread"), F.lit(None).cast(kind).alias("id"),
        "host", "path", F.concat("host", "path").alias("rule"), "verdict",
    )
    bounds = _bounds(urls.select("key", "spread"), ranges, sample)
    schema = f"range int, key string, spread long, id {kind.simpleString()}, host string, path string, rule string, verdict string"
    both = urls.mapInArrow(_range_of(bounds, "url"), schema).unionByName(told.mapInArrow(_range_of(bounds, "rule"), schema))
    dealt = both.repartition(ranges, "range").sortWithinPartitions("range", "key", F.col("rule").isNull())
    judged = dealt.mapInArrow(_sweep, f"id {kind.simpleString()}, host string, path string, rule string, verdict string")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
