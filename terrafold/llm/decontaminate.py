"""Benchmark decontamination: a broadcast hash set of test n-grams against the windows of every document (operator 10).

Words are runs of letters, digits and non-ASCII bytes of the text with A-Z lower-cased. Edge cases: null and wordless
texts have no words and no hits; a benchmark item of fewer than ``n`` words is one window, one without words none; null
item ids are left out of the list of items but their windows still hit; of repeated item ids one is listed; repeated rows
and null ids of documents are judged alike; an empty benchmark hits nothing, an empty document table gives an empty result;
texts are read whole; other columns than those named are kept by ``decontaminate`` and ignored by ``op10``.

The set is broadcast in blocks of at most MOST_WORDS benchmark words (and one item). Of several blocks a worker holds one at
a time, for some BLOCK bytes of text; their hits are united per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import by_block, share_block, small_batches

#: Words of a window; benchmark words in a broadcast block (about 200 bytes each).
N, MOST_WORDS = 10, 500_000
#: Characters of text that are looked at together, about.
BLOCK = 1 << 23
_TO = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SPAN = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO).split() if text else []


class Windows:
    """Windows of one block of benchmark items, by length: sorted hashes first, then exact word ids."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int = N):
        self.vocab: dict[bytes, int] = {}
        self.by_len: dict[int, dict[bytes, list[str]]] = {}
        for item, ws in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.uint32)
            m = min(n, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                found = self.by_len.setdefault(m, {}).setdefault(ids[i : i + m].tobytes(), [])
                if item is not None and item not in found:
                    found.append(item)
        self.hashes = {m: np.unique(np.array([self.roll(np.frombuffer(k, np.uint32), m)[0] for k in d], np.uint64)) for m, d in self.by_len.items()}

    @staticmethod
    def roll(ids: np.ndarray, m: int) -> np.ndarray:
        h = np.zeros(max(0, len(ids) - m + 1), np.uint64)
        for k in range(m):
            h = h * _MUL + ids[k : len(ids) - m + 1 + k]
        return h ^ (h >> np.uint64(31))

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint spans of hit words and the items whose windows occur."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in ws), np.uint32, len(ws))
        hits, items = [], set()
        for m, known in self.hashes.items():
            if len(ids) < m:
                continue
            gaps = np.concatenate([[0], np.cumsum(ids == 0)])
            at = np.flatnonzero(gaps[m:] == gaps[:-m])  # windows of benchmark words only
            if not len(at):
                continue
            h = self.roll(ids, m)[at]
            near = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            for i in at[near].tolist():
                found = self.by_len[m].get(ids[i : i + m].tobytes())
                if found is not None:
                    hits.append((i, i + m))
                    items.update(found)
        return union(hits), items


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, most_words: int = MOST_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Benchmark items in blocks of a bounded number of words, streamed through the driver one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        ws = words(r.text)
        if block and size + len(ws) > most_words:
            yield block
            block, size = [], 0
        block.append((r.i, ws))
        size += len(ws)
    yield block


def _together(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch, some BLOCK characters at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t.as_py())
        size += len(some[-1] or "")
        if size >= BLOCK:
            yield some
            some, size = [], 0
    if some:
        yield some


def hits(spark: SparkSession, benchmark: DataFrame, text: Column, n: int = N, most_words: int = MOST_WORDS) -> Column:
    """A struct column for a text column: its number of words, hit spans and the items whose windows occur."""
    small_batches(spark)
    shared = [share_block(spark, Windows(b, n)) for b in blocks(benchmark, most_words)]

    @F.arrow_udf(HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.string()))])
        for texts in batches:
            out = []
            for some in _together(texts):
                split = [words(t) for t in some]
                spans: list[list] = [[] for _ in split]
                items: list[set] = [set() for _ in split]
                for known in by_block(shared):
                    for i, ws in enumerate(split):
                        a, b = known.find(ws)
                        spans[i] += a
                        items[i] |= b
                out += [{"n_words": len(ws), "spans": [{"a": a, "b": b} for a, b in union(x)], "items": sorted(y)} for ws, x, y in zip(split, spans, items, strict=True)]
            yield pa.array(out, kind)

    return find(text)


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words in the given word spans; what stands between kept words stays."""
    if not text or not spans:
        return text
    raw = text.encode("utf-8", "replace")
    flat = raw.translate(_TO)
    at, pos = [], 0
    for w in flat.split():
        pos = flat.index(w, pos)
        at.append((pos, pos + len(w)))
        pos += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


@F.arrow_udf(T.StringType())
def strip_hits(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Text without its hit spans."""
    return pa.array([remove_spans(t, [(x["a"], x["b"]) for x in s or ()]) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, remove: str = "document") -> DataFrame:
    """docs, same columns, without contaminated documents (remove="document") or without their hit words ("span")."""
    h = hits(spark, benchmark, F.col("text"))
    if remove == "document":
        return docs.filter(F.size(h["spans"]) == 0)
    return docs.withColumn("text", strip_hits(F.col("text"), h["spans"]))


def op10(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (in words) of every document."""
    d = docs.select("doc_id", hits(spark, benchmark, F.col("text")).alias("h"))
    n_hit = F.aggregate("h.spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return d.select(
        "doc_id", F.col("h.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("h.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("h.items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("h.spans") > 0).alias("contaminated"),
        F.array_join(F.transform("h.spans", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"))), ",").alias("spans"),
    )


OP10_SQL = r"""
WITH f AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, f),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, f),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT n, m, i, array_to_string(w[i:i+m-1], ' ') AS g
  FROM (SELECT n, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT n, dw.m AS m, i, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
cov AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + m)) AS p FROM hit) GROUP BY n),
it AS (SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT n, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY n),
m AS (
  SELECT n, p, p - row_number() OVER (PARTITION BY n ORDER BY p) AS run FROM (SELECT DISTINCT n, unnest(range(i, i + m)) AS p FROM hit)),
sp AS (SELECT n, string_agg((a - 1) || ':' || b, ',' ORDER BY a) AS spans FROM (SELECT n, min(p) AS a, max(p) AS b FROM m GROUP BY n, run) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN cov USING (n) LEFT JOIN it USING (n) LEFT JOIN sp USING (n)
"""
