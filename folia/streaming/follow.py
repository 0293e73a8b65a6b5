"""Links followed as a stream that feeds itself, with the visited targets as its state.

Targets to visit arrive as files (target, depth) in a folder.  The stream keeps the
least depth of each target as keyed state and passes a target on when it is new, or
now nearer than before.  A batch hands the new targets on, finds their links in one
join, and writes what they name, one level deeper, as further files to the same
folder.  It ends when a round finds nothing new, at cycles too.

A run that was stopped goes on from its checkpoint: a batch that runs again writes
the same files under the same name, and the state drops what it knows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TARGETS = "target string, depth int"
VISITED = "target string, depth int, is_new boolean"


def _visit(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    depth = min(int(r["depth"].min()) for r in rows)
    known = state.get[0] if state.exists else None
    if known is None or depth < known:
        state.update((depth,))
        yield pd.DataFrame({"target": [key[0]], "depth": [depth], "is_new": [known is None]})


def add_seeds(seeds: DataFrame, root: str) -> None:
    """Targets to start from, or more of them later."""
    import uuid

    seeds.select(F.col("target").cast("string").alias("target"), F.lit(0).alias("depth")).where("target is not null").write.parquet(f"{root}/frontier/seeds-{uuid.uuid4().hex}")


def follow(spark: SparkSession, root: str, expand: Callable[[DataFrame], DataFrame], max_depth: int | None = 3, apply: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """target, depth: every target that the seeds reach, once, at its least depth.

    ``expand`` takes targets (column target) and gives their links (source,
    target); ``apply`` is handed the new targets of a batch.  Targets at
    ``max_depth`` are visited and not followed.
    """
    found = []

    def batch(df: DataFrame, number: int) -> None:
        at = f"{root}/visited/batch={number}"
        df.write.mode("overwrite").parquet(at)
        now = spark.read.schema(VISITED).parquet(at)
        if apply is not None and not (new := now.where("is_new").select("target")).isEmpty():
            apply(new)
        open_ = now if max_depth is None else now.where(F.col("depth") < max_depth)
        links = expand(open_.select("target")).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("next")).where("next is not null")
        after = links.join(open_.select(F.col("target").alias("source"), "depth"), "source").groupBy(F.col("next").alias("target")).agg((F.min("depth") + 1).cast("int").alias("depth"))
        to = f"{root}/frontier/from-{number}"
        after.write.mode("overwrite").parquet(to)
        found.append(not spark.read.schema(TARGETS).parquet(to).isEmpty())

    while True:
        found.clear()
        arrivals = spark.readStream.schema(TARGETS).parquet(f"{root}/frontier/*")
        visits = arrivals.groupBy("target").applyInPandasWithState(_visit, VISITED, "depth int", "append", GroupStateTimeout.NoTimeout)
        visits.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        if not any(found):
            break
    return spark.read.schema(VISITED).parquet(f"{root}/visited").groupBy("target").agg(F.min("depth").alias("depth"))
