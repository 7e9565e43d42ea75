"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch; ids that may be broadcast; tasks over which the rows of one key are dealt; small rows of a file.
BATCH_ROWS, MOST_IDS, SALTS, ROWS_PER_TASK = 1000, 2_000_000, 64, 500_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: For tables of our own on a file: path (other stores don't look at it): no checksum file beside each file, which without
#: Hadoop's native library costs a forked process more.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_own: list[str] = []


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder name below the checkpoint folder, which driver and executors share.

    That is spark.checkpoint.dir, or else what was set on the context. Only a local session may do without: there one
    temporary folder of this process stands in, which goes when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = of_context.get() if of_context.isDefined() else None
    if base is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="terrafold-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = _own[0]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def keep(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    rows: where it is known that df has no more, the last stage has a task for each ROWS_PER_TASK of them, so that small
    tables are few files.
    """
    path = shared_dir(df.sparkSession, tag)
    if rows is not None:
        df = df.coalesce(-(-rows // ROWS_PER_TASK) or 1)
    df.write.options(**PLAIN_FILES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*kept: DataFrame) -> None:
    """Deletes tables that ``keep`` wrote; nothing that is still to be computed may read them."""
    for df in kept:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, where the session has Spark's own limit, as long texts make large batches."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)


def semi(df: DataFrame, ids: DataFrame, key: str, n: int, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is among (left_semi) or not among (left_anti) the n rows, or fewer, of ids (one column of that name).

    Up to MOST_IDS ids (16 MB) are broadcast, so that df stays where it is; more are joined by a shuffle.
    """
    return df.join(F.broadcast(ids) if n <= MOST_IDS else ids.hint("shuffle_hash"), key, how)


def spread(rows: DataFrame, key: str, value: str, out: str, salted_by: str, agg: Callable = F.min) -> DataFrame:
    """rows with the least (or largest) value of their key as a column, whatever the share of one key.

    A key's rows are dealt over SALTS salts; they meet their key's value by (key, salt), and a key has SALTS rows at most in
    the step that joins its salts. Only a row for each key and salt is held in memory.
    """
    salt = unused(rows.columns, "salt")
    r = rows.withColumn(salt, F.pmod(F.xxhash64(salted_by), F.lit(SALTS)))
    least = r.groupBy(key, salt).agg(agg(value).alias(out))
    least = least.withColumn(out, agg(out).over(Window.partitionBy(key)))
    return r.join(least.hint("shuffle_hash"), [key, salt]).drop(salt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever the number of uses in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m


def near_share(df: DataFrame, id_col: str, share: float) -> Column:
    """A filter that keeps about ``share`` of the rows, decided by the id alone."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)


def unused(names: list[str], like: str) -> str:
    """A column name that is not among names, whatever their case."""
    low = {x.lower() for x in names}
    return next(x for k in range(len(low) + 1) if (x := f"{like}{k}") not in low)


def spread_join(rows: DataFrame, other: DataFrame, key: str, salted_by: str) -> DataFrame:
    """rows left joined with other on one key (at most one row each in other), whatever the share of one key.

    The keys and salts of rows meet other first, SALTS rows a key at most; rows then meet that by (key, salt).
    """
    salt = unused([*rows.columns, *other.columns], "salt")
    r = rows.withColumn(salt, F.pmod(F.xxhash64(salted_by), F.lit(SALTS)))
    return r.join(r.select(key, salt).distinct().join(other, key), [key, salt], "left").drop(salt)


def share_block(spark: SparkSession, value) -> Broadcast:
    """A block of a model or a set, of bounded size, for workers. The driver's Python keeps no copy."""
    return spark.sparkContext.broadcast(value)


def by_block(shared: list[Broadcast]) -> Iterator:
    """The values of blocks, in turn: a single block stays with the worker, of several each is let go for the next one."""
    for b in shared:
        yield b.value
        if len(shared) > 1 and getattr(b, "_path", None):
            b.__dict__.pop("_value", None)  # it is read from the worker's file again when it is asked for
