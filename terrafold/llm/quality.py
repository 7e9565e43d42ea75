r"""Quality rules as a short-circuit cascade, in DataFrame expressions only (operator 1).

Words are runs of other characters than space and \t to \r. Every text is measured whole. The base measures decide
``base_failed``; the cascade of RULES then decides ``kept`` for the others. On a bounded sample the time that each rule
takes and the rows that it rejects are measured; of the rules not yet placed, that with the most rejections per second
among the rows that are left goes next. A row leaves the cascade at its first failed rule. The order changes the cost, never
the verdict.

The sample holds about SAMPLE_ROWS rows of a few files of the input, as many from each; where the files aren't known, of the
whole input. No other file is read for it, and nothing but the sample itself is moved.

Edge cases: a null or empty text has no words and fails the base rule; null and repeated ids and repeated rows are kept and
judged alike; a rule that ties with another goes by name; an empty table gives an empty result and rules go by name; only
doc_id and text are read, so extra columns are harmless; a long text is measured whole in one row. Windows are compared by
a 64-bit hash of their five words.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import drop, keep, let

#: Characters between words; words of a window; rows of the sample that orders the rules, about; files that it is taken from.
SPACE, WINDOW, SAMPLE_ROWS, SAMPLE_FILES = " \t\n\x0b\x0c\r", 5, 2000, 4
#: Least time of a rule over the sample, in seconds: shorter ones can't be told from the time a job takes.
LEAST_S = 0.002
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measures and ``t`` (the text)."""

    name: str
    fails: str


#: All but the base rules.
RULES = [
    Rule("digits", "5 * regexp_count(t, '[0-9]') > 2 * word_chars"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("placeholder", "locate('lorem ipsum', lower(t)) > 0"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed != "", F.split(trimmed, r"[ \t-\r]+")).otherwise(F.array().cast("array<string>"))


def repeated(w: Column, k: int = WINDOW) -> Column:
    """Number of words that stand in a k-word window found twice or more in the array of words w."""

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = let(by_hash, lambda z: F.filter(z, lambda e, i: (F.get(z, i - 1)["h"] == e["h"]) | (F.get(z, i + 1)["h"] == e["h"])))
        at = F.sort_array(F.transform(twins, lambda e: e["i"]))
        each = let(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))))
        return F.aggregate(each, F.lit(0), lambda s, x: s + x)

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
    return F.when(F.size(w) > k, let(windows, of)).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of MEASURES (long) for a text column; zeros for null."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def of(w: Column, ln: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"), F.size(ln).cast("long").alias("n_lines"), repeated(w).cast("long").alias("n_repeat_words"),
        )

    return let(words(t), lambda w: let(lines, lambda ln: of(w, ln)))


BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES) -> DataFrame:
    """About ``rows`` rows of docs, of a few evenly spaced files where docs is a table of files."""
    names = sorted({x.rsplit("/", 1)[-1] for x in docs.inputFiles()})
    few = docs
    if len(names) > files and "_metadata" not in docs.columns:
        try:
            few = docs.filter(F.col("_metadata.file_name").isin(names[:: -(-len(names) // files)]))
        except AnalysisException:  # docs isn't a plain scan
            pass
    return few.sample(min(1.0, rows / max(1, few.count())), seed=7)


def ordered(measured: DataFrame, rules: list[Rule]) -> list[Rule]:
    """rules by rejections per second, greedily among the rows that the rules before leave; ties by name.

    measured: a written table of the text ``t`` and its measures, of a bounded number of rows; rows that the base rules
    fail don't count. The times are those of a job for each rule less that of a job without one.
    """

    def seconds(fails: str) -> float:
        took = []
        for _ in range(2):  # the second run has compiled code
            began = time.perf_counter()
            measured.filter(f"NOT {BASE_FAILED}").agg(F.count(F.when(F.expr(fails), 1)), F.sum(F.length("t"))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    none = seconds("n_words < 0")
    cost = {r.name: max(LEAST_S, seconds(r.fails) - none) for r in rules}
    found = measured.filter(f"NOT {BASE_FAILED}").groupBy(F.array(*(F.expr(r.fails) for r in rules)).alias("failed")).count().collect()
    left, out = {tuple(x.failed): x["count"] for x in found}, []
    rest = dict(enumerate(rules))
    while rest:
        hits = {k: sum(n for f, n in left.items() if f[k]) for k in rest}
        k = min(rest, key=lambda k: (-hits[k] / cost[rest[k].name], rest[k].name))
        out.append(rest.pop(k))
        left = {f: n for f, n in left.items() if not f[k]}
    return out


def cascade(rules: list[Rule]) -> Column:
    """Name of the first failed rule, null if none fails; later rules aren't evaluated for a row that failed."""
    out = None
    for r in rules:
        out = F.when(F.expr(r.fails), r.name) if out is None else out.when(F.expr(r.fails), r.name)
    return out


def op1(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every whole text."""
    few = sample(docs, sample_rows).select(F.col("text").alias("t")).repartition(1)
    few = keep(few.select("t", measures(F.col("t")).alias("m")).select("t", "m.*"), "sample")
    order = ordered(few, rules)
    drop(few)
    d = docs.select("doc_id", F.col("text").alias("t"), measures(F.col("text")).alias("m")).select("doc_id", "t", "m.*")
    kept = ~F.expr(BASE_FAILED) & cascade(order).isNull()
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), kept.alias("kept"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT n, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (
  SELECT n, i, w[i] || chr(31) || w[i+1] || chr(31) || w[i+2] || chr(31) || w[i+3] || chr(31) || w[i+4] AS g
  FROM (SELECT n, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT n, count(DISTINCT p) AS n_repeat_words FROM (SELECT n, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY n),
ln AS (
  SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT n, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY n),
m AS (
  SELECT d.n, doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(t, '[0-9]')) AS n_digits
  FROM d JOIN w USING (n) LEFT JOIN ln USING (n) LEFT JOIN cov USING (n)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (5 * n_digits > 2 * word_chars OR 2 * n_dup_lines > n_lines OR contains(lower(t), 'lorem ipsum')
         OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""
