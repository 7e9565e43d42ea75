r"""Near-duplicates with an LSH forest over MinHash signatures (operator 2).

A document's set holds its distinct 5-word shingles (64-bit hashes). Documents with equal sets form a class at once. Each
class representative gets TREES labels of DEPTH minima; a tree is the list of all labels in sorted order. Neighbours in a
tree share its longest common prefixes, and the depth adapts itself to each region: a label's depth is the least number of
minima, from LEAST_DEPTH on, that at most REGION labels share with it, and all pairs of that region are candidates. The
sorted orders are dealt by range of (label, id), so a label shared by a third of all rows is spread over many tasks; the
rows at the borders of the ranges are swept once more, together. The number of candidates grows with the number of
documents only. Every candidate is confirmed on the full sets.

A pair of similarity 0.75 shares d minima of a label with probability 0.75 ** d, so the depths of a document tell the
probability that all TREES trees miss one of its links. Where all depths are LEAST_DEPTH that is 2e-9. Documents of dense
regions, for which it exceeds MISS (or whose regions stay large at DEPTH), are open: links between two open documents are
found by an exact pass, so no region has a window or a cap. The forest's candidates only join most of such a region cheaply.

The exact pass is a prefix filter. The shingles of an open set are put in one global order, rarest of a sample first; two
sets of similarity 0.75 share one of the first quarter (and one more) of each. Documents that meet at such a shingle and lie
in different components are paired unless their sizes, the places of the shingle in both orders or, at a common shingle, the
counts of their shingles in BUCKETS buckets rule a link out; each is an upper bound of the overlap, so no link is lost. The
order is right whatever the sample; the sample only keeps common passages out of the prefixes. A shingle that is common and
yet in prefixes is cut into blocks of documents, and each pair of blocks is a unit of work of its own.

Components are found by passing minima along the links, in rounds that are cut by written tables. No join has a hot key: a
set with a third of all rows and a hub of links are dealt over SALTS tasks.

Edge cases: null, empty and wordless texts have an empty set and link with nothing; a text of fewer than five words is one
shingle; exact copies and repeated rows share a class; rows with one id count as one document with any of its texts; a null
id takes part through its class, and is its own component if it has none; texts are read whole, whatever their length; of
ties the smallest id stands for a component; other columns than doc_id and text are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from terrafold.llm.common import SALTS, drop, keep, near_share, semi, small_batches, spread

#: Words of a shingle; similarity of a link in percent; trees, minima in a label, least shared minima, labels of a region.
SHINGLE, PERCENT, TREES, DEPTH, LEAST_DEPTH, REGION = 5, 75, 24, 5, 2, 9
#: Probability of a missed link from which a document is open.
MISS = 1e-6
#: Buckets of the counts that bound an overlap; runs longer than this are paired class by class; pairs made at a time.
BUCKETS, LONG_RUN, AT_ONCE = 256, 64, 1 << 20
#: Open documents whose shingles give the global order; shingles that count as common there, at most.
SAMPLE_ROWS, COMMON = 4000, 100_000
#: Documents of a block of a common shingle, about; blocks at most (more only make blocks larger).
BLOCK_ROWS, MOST_BLOCKS = 500, 64
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SKETCH = "doc_id bigint, n_shingles bigint, set binary, keys array<binary>"
SWEPT = "kind string, a bigint, b bigint, key binary"


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    ws = text.encode("utf-8", "replace").lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    k = min(k, len(ws))
    s = np.full(len(ws) - k + 1, k, np.uint64)
    for j in range(k):
        s *= _MUL
        s += h[j : len(ws) - k + 1 + j]
    s ^= s >> np.uint64(29)
    s *= _MIX
    s ^= s >> np.uint64(32)
    return np.unique(s)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, TREES * DEPTH) 32-bit minima of non-empty sets."""
    mul, xor = _functions()
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    for a, b in _runs([len(s) for s in sets], 1 << 16):
        h = np.concatenate(sets[a:b])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[a:b]])])[:-1]
        v = np.empty_like(h)
        for k in range(TREES * DEPTH):
            np.bitwise_xor(h, xor[k], out=v)
            np.multiply(v, mul[k], out=v)
            out[a:b, k] = np.minimum.reduceat(v, at) >> np.uint64(32)
    return out


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` in sum."""
    a = n = 0
    for i, s in enumerate(sizes):
        n += s
        if n >= most:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def common_shingles(sets: DataFrame, n: int) -> tuple[np.ndarray, float]:
    """Sorted hashes of the most common shingles of a bounded sample of the n sets, with their counts: (2, k); the share sampled."""
    share = min(1.0, SAMPLE_ROWS / max(1, n))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s.as_py(), np.int64))], ["s"])

    found = sets.filter(near_share(sets, "id", share)).select("s").mapInArrow(task, "s bigint").groupBy("s").agg(F.count("*").alias("n"))
    top = found.filter("n > 2").orderBy(F.desc("n"), "s").limit(COMMON).collect()
    found = np.array([(r.s, r.n) for r in top], np.int64).reshape(-1, 2).T.copy().view(np.uint64)
    return found[:, np.argsort(found[0])], share


def _times(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """How often each shingle was in the sample, 0 for one that isn't common."""
    if not common.shape[1]:
        return np.zeros(len(s), np.uint64)
    i = np.minimum(np.searchsorted(common[0], s), common.shape[1] - 1)
    return np.where(common[0][i] == s, common[1][i], 0)


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a non-empty set in the global order, of which two linked sets share one."""
    return s[np.lexsort((s, _times(s, common)))][: len(s) - -(-PERCENT * len(s) // 100) + 1]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = np.arange(TREES, dtype=">u4")
    for b in batches:
        texts = b.column(1)
        for lo in range(0, len(texts), 256):
            part = texts.slice(lo, 256)
            sets = [shingles(t.as_py()) for t in part]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list[list[bytes] | None] = [None] * len(sets)
            for i, sig in zip(some, signatures([sets[i] for i in some]), strict=True):
                rows = np.concatenate([tree[:, None], sig.reshape(TREES, DEPTH).astype(">u4")], 1).tobytes()
                keys[i] = [rows[j : j + 4 * DEPTH + 4] for j in range(0, len(rows), 4 * DEPTH + 4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, 256), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.binary()))],
                ["doc_id", "n_shingles", "set", "keys"],
            )


class _Order:
    """A stretch of a sorted order of (key, id) rows, and the region of each row in it."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        self.keys, self.ids, n = keys, ids, len(ids)
        #: number of minima that a row shares with the one before it; -1 for another tree
        self.shared = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(1) - 1 if n > 1 else np.zeros(0, np.int64)
        #: least depth at which a row's region is small, 0 if there is none; first and last row of that region
        self.depth, self.first, self.last = np.zeros(n, np.int64), np.arange(n), np.arange(n)
        for d in range(DEPTH, LEAST_DEPTH - 1, -1):
            cut = np.concatenate([np.ones(min(n, 1), bool), self.shared < d])
            run = np.cumsum(cut) - 1
            first = np.flatnonzero(cut)
            last = np.append(first[1:], [n] * min(n, 1)).astype(np.int64) - 1
            small = (last - first + 1 <= REGION)[run]
            self.depth[small], self.first[small], self.last[small] = d, first[run[small]], last[run[small]]

    def pairs(self, lo: int, hi: int) -> np.ndarray:
        """Pairs of each of the rows lo to hi with the earlier ones of its region; with its neighbour where that is large."""
        i = np.arange(lo, hi)
        out = [np.stack([self.ids[j - r], self.ids[j]], 1) for r in range(1, REGION) if len(j := i[(self.depth[i] > 0) & (i - r >= self.first[i])])]
        j = i[(self.depth[i] == 0) & (i > 0)]
        j = j[self.shared[j - 1] >= LEAST_DEPTH]
        p = np.concatenate([*out, np.stack([self.ids[j - 1], self.ids[j]], 1)])
        p.sort(axis=1)
        return p


def _swept(kind: str, a: np.ndarray, b: np.ndarray, keys: list[bytes] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys or [None] * len(a), pa.binary())], ["kind", "a", "b", "key"])


def _sweep(batches: Iterator[pa.RecordBatch], border: bool = False) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id) in sorted order: candidate pairs ("pair", ids), depths other than the least ("depth", id, depth or 0)
    and the first and last rows ("border", id, whether its region goes to the end of this stretch, key).

    border: the rows are those of the borders of all stretches, with that mark as a third column; only marked rows' depths
    are given.
    """
    words, around = DEPTH + 1, REGION + 1
    held = _Order(np.zeros((0, words), ">u4"), np.zeros(0, np.int64))
    marks = np.zeros(0, bool)
    done = at = 0  # rows of the buffer that are settled; rows that left it

    def settle(lo: int, hi: int, n: int | None) -> Iterator[pa.RecordBatch]:
        """What is known of rows lo to hi of the buffer; n: rows of the whole stretch, where its end is in sight."""
        if hi <= lo:
            return
        p = held.pairs(lo, hi)
        if len(p):
            yield _swept("pair", p[:, 0], p[:, 1])
        i = np.arange(lo, hi)
        # a small region that goes to an end of the stretch may be larger than it looks
        late = (held.depth[i] > 0) & ((at + held.first[i] == 0) | (at + held.last[i] + 1 == (n if n is not None else -1)))
        told = i[marks[i] if border else ~late]
        told = told[held.depth[told] != LEAST_DEPTH]
        if len(told):
            yield _swept("depth", held.ids[told], held.depth[told])
        if not border:
            end = (at + i < around) | ((at + i >= n - around) if n is not None else False)
            if len(k := i[end]):
                yield _swept("border", held.ids[k], late[end].astype(np.int64), [x.tobytes() for x in held.keys[k]])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u4").reshape(-1, words)
        held = _Order(np.concatenate([held.keys, keys]), np.concatenate([held.ids, batch.column(1).to_numpy()]))
        if border:
            marks = np.concatenate([marks, batch.column(2).to_numpy() > 0])
        # a row is settled when as many rows as a region has, and those of a border, are known behind it
        upto = max(done, len(held.ids) - 2 * around)
        yield from settle(done, upto, None)
        out = max(0, upto - around)
        held, marks = _Order(held.keys[out:], held.ids[out:]), marks[out:]
        done, at = upto - out, at + out
    yield from settle(done, len(held.ids), at + len(held.ids))


def _entries(batches: Iterator[pa.RecordBatch], common: np.ndarray, share: float) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a prefix: unit of work, id, component, set size and place; the buckets at a common one.

    The unit is the shingle; for one with more than BLOCK_ROWS documents, by the sample, it is a pair of blocks of them, and
    a document stands in all pairs of its block. block: -1 in a unit where all pairs count, else only those of two blocks do.
    """
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            sets = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
            ids = part.column(0).to_numpy()
            firsts = [prefix(s, common) for s in sets]
            long = np.array([len(f) for f in firsts])
            s = np.concatenate(firsts)
            of = np.repeat(np.arange(len(firsts)), long)
            at = np.arange(len(s)) - np.repeat(np.cumsum(long) - long, long)
            place = np.array([len(x) for x in sets])[of] << 32 | at
            times = _times(s, common)
            blocks = np.clip(np.ceil(times / share / BLOCK_ROWS), 1, MOST_BLOCKS).astype(np.int64)
            own = (ids.view(np.uint64) * _MUL >> np.uint64(40)).astype(np.int64)[of] % blocks
            copies = np.repeat(np.arange(len(s)), blocks)
            other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            x, y = np.minimum(own[copies], other), np.maximum(own[copies], other)
            unit = s[copies] + (x * MOST_BLOCKS + y).astype(np.uint64) * _MIX
            block = np.where(x == y, -1, own[copies])
            counted = [np.bincount((v % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).clip(max=255).astype(np.uint8).tobytes() for v in sets]
            buckets = pa.array(counted, pa.binary()).take(pa.array(of[copies], mask=times[copies] == 0))
            take = lambda c: part.column(c).take(pa.array(of[copies]))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), take(0), take(1), pa.array(place[copies]), buckets, pa.array(block)], ["s", "id", "comp", "place", "buckets", "block"])


def _may_link(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n and m whose first common shingle is at places at and bt can be linked."""
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & ((100 + PERCENT) * np.minimum(n - at, m - bt) >= PERCENT * (n + m))


def _long_run(ids: np.ndarray, comp: np.ndarray, place: np.ndarray, block: np.ndarray, buckets: list[bytes | None]) -> Iterator[np.ndarray]:
    """Pairs of a long run. Members with equal sizes and places are ruled out together; the largest component isn't paired with itself."""
    kinds, counts = np.unique(comp, return_counts=True)
    if len(kinds) == 1:
        return
    own = comp == kinds[counts.argmax()]
    vec = np.frombuffer(b"".join(buckets), np.uint8).reshape(-1, BUCKETS) if None not in buckets else None
    full = vec.max(1) == 255 if vec is not None else None
    classes, of = np.unique(place, return_inverse=True)
    members = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
    n, at = classes >> 32, classes & 0xFFFFFFFF
    for c, rows in enumerate(members):
        left = rows[~own[rows]]
        if not len(left):
            continue
        right = np.concatenate([members[d] for d in np.flatnonzero(_may_link(n[c], at[c], n, at))] or [rows[:0]])
        step = max(1, (AT_ONCE >> (7 if vec is not None else 0)) // max(1, len(right)))
        for lo in range(0, len(left), step):
            x = left[lo : lo + step, None]
            i, j = np.nonzero((comp[x] != comp[right]) & (own[right] | (x < right)) & ((block[x] != block[right]) | (block[x] < 0)))
            i, j = left[lo + i], right[j]
            if vec is not None:
                ok = np.empty(len(i), bool)
                for k in range(0, len(i), 1 << 14):
                    u, v = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                    most = np.minimum(vec[u], vec[v]).sum(1, dtype=np.int64)
                    ok[k : k + (1 << 14)] = ((100 + PERCENT) * most >= PERCENT * ((place[u] >> 32) + (place[v] >> 32))) | full[u] | full[v]
                i, j = i[ok], j[ok]
            if len(i):
                yield np.stack([ids[i], ids[j]], 1)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components that meet at a shingle of both prefixes, in rows sorted by unit, if a link is possible."""

    def out(p: np.ndarray) -> pa.RecordBatch:
        p.sort(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

    def runs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        s, ids, comp, place, block = (t.column(c).to_numpy() for c in (0, 1, 2, 3, 5))
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        sizes = np.diff(np.append(starts, len(s)))
        size = np.repeat(sizes, sizes)
        n, at = place >> 32, place & 0xFFFFFFFF
        for r in range(1, min(LONG_RUN, int(sizes.max()))):
            i = np.flatnonzero((s[r:] == s[:-r]) & (comp[r:] != comp[:-r]) & (size[r:] <= LONG_RUN) & ((block[r:] != block[:-r]) | (block[r:] < 0))) + r
            i = i[_may_link(n[i], at[i], n[i - r], at[i - r])]
            if len(i):
                yield out(np.stack([ids[i - r], ids[i]], 1))
        for a, k in zip(starts[sizes > LONG_RUN], sizes[sizes > LONG_RUN], strict=True):
            for p in _long_run(ids[a : a + k], comp[a : a + k], place[a : a + k], block[a : a + k], t.column(4).slice(a, k).to_pylist()):
                yield out(p)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and b.column(0)[b.num_rows - 1] == held[0].column(0)[0]:
            held.append(b)  # one run goes on
            continue
        s = b.column(0).to_numpy()
        cut = int(np.flatnonzero(s != s[-1]).max(initial=-1)) + 1
        if held or cut:
            yield from runs(pa.Table.from_batches([*held, b.slice(0, cut)]))
        held = [b.slice(cut)]
    if held:
        yield from runs(pa.Table.from_batches(held))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["id", "s"])


@F.arrow_udf(T.BooleanType())
def _linked(x: pa.Array, y: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(x, y, strict=True):
        a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
        if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
            out.append(False)
            continue
        n = len(a) + len(b)
        union = len(np.union1d(a, b))
        out.append(100 * (n - union) >= PERCENT * union)
    return pa.array(out, pa.bool_())


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, s): the full sets of the documents of n ids or fewer, kept."""
    return keep(semi(docs.select(F.col("doc_id").alias("id"), "text"), ids, "id", n).mapInArrow(_sets, "id bigint, s binary"), "sets")


def confirmed(sets: DataFrame, pairs: DataFrame, n: int | None = None) -> DataFrame:
    """Those of the (n) pairs (a, b) that are linked by their full sets, kept."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return keep(both.filter(_linked("x", "y")).select("a", "b").distinct(), "links", n)


def components(links: DataFrame) -> DataFrame:
    """A kept table (id, component): the smallest id that each id of a written table of links (a, b) reaches.

    In each round every node tells its neighbours the smallest id in sight, and links are redrawn to it, until nothing
    changes; links are a set, so their number never exceeds twice the first one.
    """
    n = 2 * links.count()
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, state = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges", n), None
    while True:
        told = spread(both(now), "a", "b", "m", "b").withColumn("m", F.least("a", "m"))
        told = told.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        new = keep(told.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", n)
        drop(now)
        now, of = new, new.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.count_distinct("a")).first()
        if tuple(of) == state and of[0] == of[2]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        state = tuple(of)


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidate pairs (a, b) of the forest and the open documents (id); reps: id, keys."""
    n = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = reps.select(F.explode("keys").alias("key"), "id").repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    swept = keep(order.mapInArrow(_sweep, SWEPT), "swept")
    ends = swept.filter("kind = 'border'").select("key", F.col("a").alias("id"), F.col("b").alias("mark"))
    ends = ends.repartition(1).sortWithinPartitions("key", "id")  # a few rows of each task of the sweep
    swept = swept.filter("kind <> 'border'").union(ends.mapInArrow(lambda b: _sweep(b, True), SWEPT))
    pairs = swept.filter("kind = 'pair'").select("a", "b").distinct()
    more = F.when(F.col("b") == 0, 0.0).otherwise(F.log1p(-F.pow(F.lit(PERCENT / 100), F.col("b"))))
    miss = F.sum(more) + (TREES - F.count("*")) * float(np.log1p(-((PERCENT / 100) ** LEAST_DEPTH)))
    left = swept.filter("kind = 'depth'").groupBy("a").agg(miss.alias("miss")).filter(F.col("miss") > float(np.log(MISS)))
    return pairs, keep(left.select(F.col("a").alias("id")), "open")


def exact_pairs(sets: DataFrame, comp: DataFrame, left: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of the n open documents (left) of different components that an upper bound lets be linked."""
    own = semi(sets, left, "id", n)
    common, share = common_shingles(own, n)
    shared = sets.sparkSession.sparkContext.broadcast(common)
    meet = own.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("comp"), "s")
    meet = meet.mapInArrow(lambda b: _entries(b, shared.value, share), "s bigint, id bigint, comp bigint, place bigint, buckets binary, block bigint")
    parts = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return meet.repartition(parts, "s").sortWithinPartitions("s").mapInArrow(_meet, "a bigint, b bigint").distinct()


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    sketch = keep(docs.mapInArrow(_sketch, SKETCH), "sketch")
    # (set, salt): the rows of a set are dealt over SALTS salts, which meet in a row each
    salted = sketch.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    sets = salted.filter("set IS NOT NULL").groupBy("set", "salt").agg(F.min("doc_id").alias("least"))
    sets = keep(sets.withColumn("class", F.min("least").over(Window.partitionBy("set"))), "classes")
    reps = sets.filter("least = class").groupBy(F.col("class").alias("id")).agg(F.min("set").alias("own"))
    reps = sketch.withColumnRenamed("doc_id", "id").join(reps, "id").filter("set = own").dropDuplicates(["id"]).select("id", "keys")
    pairs, left = candidates(reps)

    n_pairs, n_left = pairs.count(), left.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(left).distinct()
    full = sets_of(docs, ids, 2 * n_pairs + n_left)
    links = confirmed(full, pairs, n_pairs)
    comp = components(links)
    more = confirmed(full, exact_pairs(full, comp, left, n_left))
    drop(full, left)
    if not more.isEmpty():
        comp = components(keep(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "edges"))
    sets = sets.join(comp.select(F.col("id").alias("class"), "component"), "class", "left").select("set", "salt", F.coalesce("component", "class").alias("component"))
    out = salted.select("doc_id", "n_shingles", "set", "salt").join(sets, ["set", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return cluster(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs, same columns, with one document of each component: that with the smallest id.

    Rows without text stay; so do rows with a null id, and all rows of an id that is repeated, as ids decide.
    """
    gone = keep(op2(docs).filter(~F.col("kept")).select("doc_id").filter("doc_id IS NOT NULL").distinct(), "gone")
    return semi(docs, gone, "doc_id", gone.count(), "left_anti").select(*docs.columns)


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], chr(31)) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id AND r.c < l.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
