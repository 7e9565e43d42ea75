"""URL filters by a sort-merge range join (operator 3).

A host reversed label by label turns "this domain and all below it" into one interval of keys: rule ``example.com`` owns
every key from ``com.example.`` up to the next sibling. Pages and rules are sorted by that key; one sweep over the pages
of a task keeps a stack of the rules whose interval holds the present key (intervals nest or are disjoint) and takes the
longest one whose path the page's path starts with.

Pages are sorted inside their own partitions, so nothing is shuffled and a host with a third of all rows stays spread. The
sort feeds the sweep itself, so no plan above can drop it. Rules are broadcast in sorted blocks of at most MOST_RULES; of
several blocks a worker holds one at a time, for a batch of pages, and the longest match of all wins.

Edge cases: a null url or one without ``://`` has an empty host and path and matches no rule; among equally long fitting
rules a block wins over an allow; repeated rows and null ids are judged alike; an empty rule table gives every page the
default verdict, an empty page table an empty result; rules with a null host or verdict are ignored, a null path is empty;
long urls are judged whole; columns named host, path, rule or verdict are replaced, all others are kept.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import by_block, share_block, small_batches, unused

#: Rules in one broadcast block (about 300 bytes each).
MOST_RULES = 200_000
#: Verdict of a page that no rule fits.
DEFAULT = "allow"
#: (verdict, host, path) that op3 applies.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host(url: Column) -> Column:
    h = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key(host: Column) -> Column:
    """Reversed host: com.example.www. (every label followed by a dot, so a prefix ends at a label)."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def prepared(rules: list[tuple[str, str, str, str]]) -> list[tuple[bytes, list[int], dict]]:
    """Rules (key, host, path, verdict) by key, sorted: (key, lengths of paths from the longest, path: (size, block?, rule, verdict))."""
    by_key: dict[bytes, dict[str, tuple]] = {}
    for k, h, p, v in rules:
        own = by_key.setdefault(k.encode(), {})
        own[p] = max(own.get(p, (0,)), (len(h) + len(p), v == "block", h + p, v))
    return [(k, sorted({len(p) for p in own}, reverse=True), own) for k, own in sorted(by_key.items())]


class Sweep:
    """Prepared rules, and a stack of those that hold the last key asked for."""

    def __init__(self, rules: list[tuple[bytes, list[int], dict]]):
        self.rules, self.at, self.last, self.stack = rules, None, b"", []

    def start(self, k: bytes) -> None:
        """Goes to a key: the rules up to it are found by bisection, those that hold it by the labels that it begins with."""
        find = lambda x: bisect.bisect_right(self.rules, x, key=lambda r: r[0])
        self.at, self.stack = find(k), []
        for n in (i + 1 for i, c in enumerate(k) if c == 46):
            i = find(k[:n]) - 1
            if i >= 0 and self.rules[i][0] == k[:n]:
                self.stack.append(self.rules[i])

    def fit(self, key: str, p: str) -> tuple[int, bool, str, str] | None:
        """(size, block?, rule, verdict) of the longest rule for key and path; keys come in ascending order (of their UTF-8)."""
        k = key.encode()
        if self.at is None or k < self.last:
            self.start(k)
        self.last = k
        while self.at < len(self.rules) and self.rules[self.at][0] <= k:
            while self.stack and not self.rules[self.at][0].startswith(self.stack[-1][0]):
                self.stack.pop()
            self.stack.append(self.rules[self.at])
            self.at += 1
        while self.stack and not k.startswith(self.stack[-1][0]):
            self.stack.pop()
        best = None
        for _, lengths, own in self.stack:
            found = next((x for n in lengths if n <= len(p) and (x := own.get(p[:n]))), None)
            if found and (best is None or found[:2] > best[:2]):
                best = found
        return best


def _sweep(batches: Iterator[pa.RecordBatch], blocks: list, default: str) -> Iterator[pa.RecordBatch]:
    """Rule and verdict of rows sorted by their last column, the key; the one before it is the path."""
    held = None
    for b in batches:
        keys, paths = (b.column(b.num_columns - k).to_pylist() for k in (1, 2))
        best: list = [None] * len(keys)
        for rules in by_block(blocks):
            if held is None or len(blocks) > 1:
                held = Sweep(rules)
            for i, (k, p) in enumerate(zip(keys, paths, strict=True)):
                x = held.fit(k, p)
                if x and (best[i] is None or x[:2] > best[i][:2]):
                    best[i] = x
        more = [pa.array([x and x[2] for x in best], pa.string()), pa.array([x[3] if x else default for x in best], pa.string())]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], [*b.schema.names[:-1], "rule", "verdict"])


def judge(spark: SparkSession, urls: DataFrame, url: str, rules: DataFrame, default: str = DEFAULT, most_rules: int = MOST_RULES) -> DataFrame:
    """urls with host, path, rule and verdict (these names replace columns of the same name).

    rules: columns verdict, host, path.
    """
    small_batches(spark)
    r = rules.filter(F.col("host").isNotNull() & F.col("verdict").isNotNull())
    r = r.select(key(F.col("host")).alias("k"), "host", F.coalesce("path", F.lit("")).alias("path"), "verdict").orderBy("k")
    blocks = [share_block(spark, prepared(b)) for b in _blocks(r, most_rules)]
    out = urls.select(*(F.col(f"`{c}`") for c in urls.columns if c not in ("host", "path", "rule", "verdict")), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    schema = T.StructType([*out.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    place = len(out.columns)  # the key goes last, whatever other columns are called
    out = out.select("*", key(F.col("host")).alias(unused(out.columns, "key")))
    return out.sortWithinPartitions(out.columns[place]).mapInArrow(lambda b: _sweep(b, blocks, default), schema)


def _blocks(rules: DataFrame, most: int) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    for r in rules.toLocalIterator():
        if len(block) == most:
            yield block
            block = []
        block.append(tuple(r))
    yield block


def op3(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page under RULES."""
    return judge(spark, pages.select("page_id", "url"), "url", spark.createDataFrame(RULES, "verdict string, host string, path string")).drop("url")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.*, row_number() OVER () AS n FROM p),
j AS (
  SELECT m.n, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM m JOIN r ON (m.host = r.h OR ends_with(m.host, '.' || r.h)) AND starts_with(m.path, r.p) GROUP BY m.n)
SELECT page_id, host, path, j.rule AS rule, coalesce(j.verdict, 'allow') AS verdict FROM m LEFT JOIN j USING (n)
"""
