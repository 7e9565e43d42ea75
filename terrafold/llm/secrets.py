r"""Secret scans with an incremental blob ledger, in DataFrame expressions only (operator 5).

Every version of a text is addressed by its SHA-256. A ledger table holds, for each blob, the rule versions that have been
run on it and the spans found. A scan computes the addresses, takes one row of each blob with unseen pairs of blob and rule
version, runs just those rules on it, appends to the ledger, and joins findings back to all rows (paths) with that blob.
Text is shuffled once, and only to the row that represents its blob; nothing is collected and copies are never expanded.

A rule is a Java regular expression; its matches are leftmost and non-overlapping, and matches that fail its test are
dropped. Positions come from the lengths of the pieces between matches, in code points.

Findings are joined by (blob, salt), so a blob with a third of all rows is dealt over many tasks.

Edge cases: null counts as the empty text, which has no spans; null or repeated ids are kept and get the findings of their
text; an empty table gives an empty result; spans with one start are ordered as the rules are listed. Texts are scanned
whole; the list of a text's spans is built one by one, so its cost grows with the square of the matches in one text. A
private key's header names its kind in 30 characters at most and its body has 1000 lines at most, as the Java matcher spends
stack on each; other rules have no bound on lengths. Columns other than the id and the text are kept by ``redacted``,
whatever their names, and ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.llm.common import PLAIN_FILES, ROWS_PER_TASK, shared_dir, spread_join, unused


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group that must have ``least`` characters
    least: int = 1
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: Base rules. Runs of access and hex characters are maximal, so a least length can stand in the pattern itself.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
]
#: A private key from its header to the matching END line, where no other header or END comes first; else to the end of the
#: base64 run. Repeated groups are bounded, as each turn costs the Java matcher stack; plain runs aren't.
PRIVATE_KEY = (
    r"-----BEGIN ([A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?)-----(?:[^-]*+(?:-{1,4}+(?!-)[^-]*+){0,1000}+-----END \1-----"
    r"|(?:\s*+[A-Za-z-]{3,20}: [^\n]*+){0,8}+(?:(?:[\s>]|\\[nrt]){0,20}+[A-Za-z0-9+/=]{16,}+){0,1000}+[A-Za-z0-9+/=\r\n\\]*+)"
)
#: What the method adds: hosted-repository tokens, signed web tokens, private keys, credentials in URLs.
MORE = [
    Rule("repo_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", PRIVATE_KEY, version=2),
    Rule("url_login", r"""://[^\x00-\x20/:@"'<>]+:[^\x00-\x20/:@"'<>]+@""", version=2),
]
RULES = BASE + MORE
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("rule", T.StringType())])))])
SPANS = LEDGER["spans"].dataType.simpleString()


def spans(text: Column, rule: Rule, k: int) -> Column:
    """Spans of a rule in a text: array of (start, place of the kind, end, rule version)."""
    p = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"), F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("g"),
    )
    found = F.filter(found, lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {SPANS})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["before"])
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("s"), F.lit(k).alias("k"), e.alias("e"), F.lit(rule.id).alias("rule"))).cast(SPANS)
        return F.struct(e.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(found, start, step, lambda a: a["out"])).otherwise(F.expr(f"CAST(array() AS {SPANS})"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at a path; empty where there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(versions: DataFrame, ledger: str, rules: list[Rule] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, blob) of every row of versions with the spans of all rules, by start and then by rule; the ledger grows.

    Only blobs with rule versions that the ledger doesn't have are scanned, and only for those.
    """
    spark = versions.sparkSession
    wanted = F.array(*(F.lit(r.id) for r in rules))
    v = versions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    v = v.withColumn("blob", F.sha2(F.col("t").cast("binary"), 256))
    reps = v.groupBy("blob").agg(F.min("id").alias("rep"))
    seen = read_ledger(spark, ledger)
    if not seen.isEmpty():
        old = seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("old"))
        reps = reps.join(old, "blob", "left")
    else:
        reps = reps.withColumn("old", F.lit(None).cast("array<string>"))
    reps = reps.select(F.col("blob").alias("b"), "rep", F.array_except(wanted, F.coalesce("old", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)
    rows = v.join(reps.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("blob") == F.col("b")))
    by_rule = [F.when(F.array_contains("todo", r.id), spans(F.col("t"), r, k)).otherwise(F.expr(f"CAST(array() AS {SPANS})")) for k, r in enumerate(rules)]
    fresh = rows.select("blob", F.col("todo").alias("rules"), F.concat(*by_rule).alias("spans"))
    # findings are small rows, so the ledger grows by few files, however many tasks have scanned
    fresh.repartition(-(-versions.count() // ROWS_PER_TASK) or 1).write.mode("append").options(**PLAIN_FILES).parquet(ledger)
    known = read_ledger(spark, ledger).filter(F.size("spans") > 0).select("blob", F.explode("spans").alias("x"))
    known = known.filter(F.col("x.rule").isin([r.id for r in rules])).groupBy("blob").agg(F.sort_array(F.collect_set("x")).alias("spans"))
    out = spread_join(v.select("id", "blob"), known, "blob", "id")
    return out.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.expr(f"CAST(array() AS {SPANS})")).alias("spans"))


def joined(spans: Column, rules: list[Rule]) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op5(spark: SparkSession, docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text, over a new ledger unless one is given."""
    d = scan(docs, ledger or shared_dir(spark, "secret-ledger"))
    n = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    return d.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(base, RULES).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), RULES).alias("spans"),
    )


def redact(text: Column, spans: Column, rules: list[Rule] = RULES) -> Column:
    """A text with its spans replaced by ``<kind>``; a span that begins inside an earlier one is merged into it."""
    kind = F.array(*(F.lit(r.kind) for r in rules))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("<"), F.get(kind, x["k"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def redacted(docs: DataFrame, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """docs, same columns, with the secrets in their text replaced; findings are joined by the text's address."""
    blob, found = (unused(docs.columns, x) for x in ("blob", "spans"))
    got = scan(docs, ledger, rules).filter(F.size("spans") > 0).groupBy(F.col("blob").alias(blob)).agg(F.first("spans").alias(found))
    salted = docs.withColumn(blob, F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    out = spread_join(salted, got, blob, "doc_id")
    return out.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col(found), rules))).select(*(F.col(f"`{c}`") for c in docs.columns))


#: Rules that the SQL holds in a shorter form: it marks the header of a key, so it agrees on texts without one.
SQL_PATTERNS = {"private_key": "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"}


def _kind_sql(r: Rule, k: int) -> str:
    p = SQL_PATTERNS.get(r.kind, r.pattern).replace("(?i:(password|passwd|secret|token|api_?key))", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])").replace("'", "''")
    return f"SELECT n, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS parts FROM d"


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(_kind_sql(r, k) for k, r in enumerate(RULES))}),
u AS (SELECT n, k, kind, least, unnest(range(1, len(m) + 1)) AS i, m, g, parts FROM a WHERE len(m) > 0),
p AS (
  SELECT n, k, kind, length(g[i]) >= least AS ok, length(m[i]) AS size,
         CAST(sum(length(parts[i]) + length(m[i])) OVER (PARTITION BY n, k ORDER BY i) AS BIGINT) AS e FROM u),
s AS (SELECT n, k, e - size AS s, kind || ':' || (e - size) || ':' || e AS x FROM p WHERE ok),
f AS (
  SELECT n, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM s GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (n)
"""
