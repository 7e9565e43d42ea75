"""The map as a stream: one row of state per cell, folded frame by frame (section 2.13 of the survey).

``stateful`` keeps the state of each cell in Spark's state store; ``replay`` runs a file stream with one frame per
micro-batch and upserts a snapshot through foreachBatch. Both give the state that the batch fold gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrafold.operators.fold import EMPTY, EMPTY_STATE, FIELDS, observation, step, stepped

STATE_OUT = "ring int, ix bigint, iy bigint, frame int, " + ", ".join(f"{f} int" for f in FIELDS)
STATE = "frame int, " + ", ".join(f"{f} int" for f in FIELDS)


def _fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    frame, *s = state.get if state.exists else (-1, *EMPTY_STATE)
    for r in pd.concat(list(rows)).sort_values("frame").itertuples():
        frame, s = int(r.frame), stepped(tuple(s), *(int(v) for v in (r.z, r.w_sum, r.count_, r.refl_sum, r.ceiling_cm, r.cls)))
    state.update((frame, *s))
    yield pd.DataFrame([(*key, frame, *s)], columns=["ring", "ix", "iy", "frame", *FIELDS])


def stateful(cells: DataFrame) -> DataFrame:
    """The state of each cell after every micro-batch of scatter rows, kept in the state store: all fields, by the same step."""
    x = observation()
    c = cells.select("ring", "ix", "iy", x.alias("x")).select("ring", "ix", "iy", "x.frame", "x.z", "x.w_sum", F.col("x.count").alias("count_"), "x.refl_sum", "x.ceiling_cm", "x.cls")
    return c.groupBy("ring", "ix", "iy").applyInPandasWithState(_fold, STATE_OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def advance(state: DataFrame, frame_cells: DataFrame) -> DataFrame:
    """State after one more frame: a full join on the cell, the same step as the batch fold."""
    key = ["ring", "ix", "iy"]
    now = frame_cells.select(*key, observation().alias("x"), F.col("frame").alias("this_frame"))
    old = state.select(*key, "last_frame", F.struct(*FIELDS).alias("s"))
    j = old.join(now, key, "full").withColumn("s", F.coalesce("s", F.expr(EMPTY)))
    j = j.withColumn("s", F.when(F.col("x").isNotNull(), step(F.col("s"), F.col("x"))).otherwise(F.col("s")))
    return j.select(*key, F.coalesce("this_frame", "last_frame").alias("last_frame"), "s.*")


def replay(spark: SparkSession, source: str, target: str, checkpoint: str) -> str:
    """Stream scatter rows from a folder with one Parquet file per frame; returns the folder of the last snapshot."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    at = lambda epoch: f"{target}/epoch={epoch:06d}"

    def batch(df: DataFrame, epoch: int) -> None:
        # a batch that is run again after a failure starts from the same snapshot and overwrites its own
        empty = "ring int, ix bigint, iy bigint, last_frame int, " + ", ".join(f"{f} int" for f in FIELDS)
        state = spark.read.parquet(at(epoch - 1)) if epoch else spark.createDataFrame([], empty)
        advance(state, df).write.mode("overwrite").parquet(at(epoch))
        done.append(epoch)

    done: list[int] = []
    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return at(max(done))
