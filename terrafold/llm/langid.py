"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 9).

A text is lower-cased, runs of other characters than letters count as one space, and n-grams of ORDERS characters go to
2 ** BITS buckets. The log-probabilities of buckets by language are broadcast; a batch of texts becomes a sparse matrix of
counts (text, bucket, count), which is multiplied with them. Languages are learned and broadcast in blocks of LANGS columns;
a worker holds one block at a time, so their number isn't bounded.

Edge cases: a null text or one without a letter gets ``und`` and score 0; with nothing to learn from, every text does.
Rows with a null id or null lang are never learned from. Repeated rows count as often as they occur; of languages with
equal scores the first by name wins. A long text is read in pieces that give the same n-grams as the whole; other columns
than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import by_block, crc_mod, near_share, share_block, small_batches

#: Buckets of the feature hash; n-gram orders; pseudo-count; labelled rows learned from per language, about.
BITS, ORDERS, ALPHA, ROWS_PER_LANG = 15, (1, 2, 3), 0.5, 1500
#: Languages in a block: a matrix of 2**BITS x LANGS x 4 bytes at most (33 MB).
LANGS = 256
#: Characters and texts turned into counts at a time.
BLOCK, TOGETHER = 1 << 18, 32
RESULT = "struct<lang_pred:string,score:double>"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(chars: np.ndarray, of: np.ndarray, old: int, bits: int) -> np.ndarray:
    """Text << bits | bucket of each n-gram of kept characters that ends after the first ``old`` ones."""
    out = [np.zeros(0, np.int64)]
    for n in ORDERS:
        at = max(0, old - n + 1)
        part, whose = chars[at:], of[at:]
        if len(part) < n:
            continue
        code = np.zeros(len(part) - n + 1, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) + part[k : len(part) - n + 1 + k] + np.uint32(n)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        last = whose[n - 1 :]
        out.append((last << bits | (code >> np.uint32(32 - bits)))[last == whose[: len(part) - n + 1]])
    return np.concatenate(out)


def _code_points(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)


def _several(texts: list[str], bits: int) -> np.ndarray:
    """Counts of n-grams, texts x buckets, of a bounded number of texts."""
    chars = _code_points("".join(f" {t} " for t in texts))
    size = np.array([len(t) + 2 for t in texts])
    start = np.cumsum(size) - size
    letter = _letters()[chars]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[start] = True
    some = np.add.reduceat(letter, start, dtype=np.int64) > 0
    kept &= np.repeat(some, size)
    of = np.repeat(np.arange(len(texts)), size)[kept]
    return np.bincount(_grams(np.where(letter, chars, 32)[kept].astype(np.uint32), of, 0, bits), minlength=len(texts) << bits)


def _long(t: str, bits: int) -> np.ndarray:
    """As _several for one text, in pieces: the last characters of a piece go before the next one."""
    total, tail, was, first = np.zeros(1 << bits, np.int64), np.array([32], np.uint32), False, True
    for at in range(0, len(t), BLOCK):
        chars = _code_points(t[at : at + BLOCK] + " " * (at + BLOCK >= len(t)))
        letter = _letters()[chars]
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[0] |= was
        was = bool(letter[-1])
        new = np.where(letter, chars, 32)[kept].astype(np.uint32)
        if len(new):
            arr = np.concatenate([tail, new])
            total += np.bincount(_grams(arr, np.zeros(len(arr), np.int64), 0 if first else len(tail), bits), minlength=1 << bits)
            tail, first = arr[-(max(ORDERS) - 1) :], False
    return total


def sparse(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the n-grams of texts as a sparse matrix by rows: text, bucket, count; a text without a letter has none."""
    keys, counts, at, i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    low = [t.lower() for t in texts]
    while at < len(low):
        i, size = at, 0
        while i < len(low) and i - at < TOGETHER and size + len(low[i]) <= BLOCK:
            size += len(low[i])
            i += 1
        n = _several(low[at:i], bits) if i > at else _long(low[i], bits)
        found = np.flatnonzero(n)
        keys.append(found + (at << bits))
        counts.append(n[found])
        at = max(i, at + 1)
    key = np.concatenate(keys)
    return key >> bits, key & ((1 << bits) - 1), np.concatenate(counts)


def counts(rows: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """N-gram counts by language of a bounded set of rows; a vector of 2**BITS for each language and task comes back."""

    def task(batches):
        found: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            of, bucket, n = sparse(b.column(0).to_pylist())
            for x in set(langs):
                own = np.array([y == x for y in langs])[of]
                found[x] = found.get(x, 0) + np.bincount(bucket[own], n[own], 1 << BITS).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(found), pa.string()), "n": pa.array([v.tobytes() for v in found.values()], pa.binary())})

    total: dict[str, np.ndarray] = {}
    for r in rows.select(F.col(text), F.col(lang)).repartition(8).mapInArrow(task, "lang string, n binary").toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.n, np.int64)
    return total


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows_per_lang: int = ROWS_PER_LANG) -> Iterator[tuple[list[str], np.ndarray]]:
    """Blocks of (languages, log-probabilities of 2**BITS buckets x languages), in the order of the languages' names.

    Learned from about ``rows_per_lang`` rows of each language, chosen by a hash of the id; priors are equal.
    """
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    sizes = sorted((r[0], r[1]) for r in known.groupBy(lang).count().collect())
    for at in range(0, len(sizes), LANGS):
        wanted = F.lit(False)
        for x, n in sizes[at : at + LANGS]:
            wanted |= (F.col(lang) == F.lit(x)) & near_share(known, doc_id, rows_per_lang / n)
        found = counts(known.filter(wanted), text, lang)
        if langs := sorted(found):
            m = np.stack([found[x] for x in langs], 1) + ALPHA
            yield langs, np.log(m / m.sum(0)).astype(np.float32)


def score(texts: list[str], blocks) -> tuple[list[str], list[float]]:
    """The best language of each text and its posterior probability; ``und`` and 0 without letters; blocks as of fit."""
    of, bucket, n = sparse(texts)
    row, start = np.unique(of, return_index=True)
    best, top, total = np.full(len(texts), "und", object), np.full(len(texts), -np.inf), np.zeros(len(texts))
    for langs, logp in blocks if len(row) else ():
        ll = np.zeros((len(row), len(langs)))
        for k in range(0, len(row), TOGETHER):
            a, b = start[k], start[k + TOGETHER] if k + TOGETHER < len(row) else len(of)
            ll[k : k + TOGETHER] = np.add.reduceat(logp[bucket[a:b]].astype(np.float64) * n[a:b, None], start[k : k + TOGETHER] - a, axis=0)
        win = ll.argmax(1)
        high = ll[np.arange(len(row)), win]
        old = top[row]
        new = np.maximum(old, high)
        total[row] = total[row] * np.exp(old - new) + np.exp(ll - new[:, None]).sum(1)
        best[row[high > old]] = np.array(langs, object)[win[high > old]]
        top[row] = new
    sure = np.divide(1.0, total, out=np.zeros(len(texts)), where=total > 0)
    return best.tolist(), sure.tolist()


def predict(spark: SparkSession, model, text: Column) -> Column:
    """A struct column (lang_pred, score): the best language and its posterior probability; model: the blocks of fit."""
    shared = [share_block(spark, x) for x in model]

    @F.arrow_udf(RESULT)
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            best, sure = score([t or "" for t in texts.to_pylist()], by_block(shared))
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])

    return told(text)


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; a null id is never held out nor learned from."""
    small_batches(spark)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = fit(docs.filter(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), predict(spark, model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def reject(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told: null texts and those without a letter go.

    The posterior isn't asked: over whole texts it is near 1 for any text with letters, so it can't tell junk from prose.
    """
    small_batches(spark)
    model = fit(docs.filter(F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(False))))
    return docs.filter(predict(spark, model, F.col("text"))["lang_pred"] != "und")
