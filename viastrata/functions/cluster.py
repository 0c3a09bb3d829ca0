"""Where loops put their rows between rounds."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pandas as pd


def _shared(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="viastrata-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder that spark.checkpoint.dir names, so that lost executors cost no more than a read.
    Only a local session may go without that setting; its folder goes when Python ends."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path, in the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(spark))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def by_tasks(rows: DataFrame, keys: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What a kernel makes of each group, dealt to as many tasks as a shuffle has or the cluster works on, as it is the kernel that
    takes the time: Spark would put little data together in one task. Groups come in sorted runs, many small ones in an Arrow
    batch, as a batch for each would cost more than most kernels. A task holds one group and one batch at a time."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(_runs(keys, kernel), schema)


def _runs(keys: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame]):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Here, so that workers of operators that do without pandas need not hold it.
        import pandas as pd

        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            now = batch[keys]
            if held:
                # The group at the end of the last batch goes on in this one, or is whole.
                before = pd.concat([held[-1][keys].iloc[-1:], now.iloc[:1]], ignore_index=True)
                if not _starts(before)[1]:
                    first = np.flatnonzero(_starts(now)[1:])
                    end = int(first[0]) + 1 if len(first) else len(batch)
                    held.append(batch.iloc[:end])
                    batch, now = batch.iloc[end:], now.iloc[end:]
                    if not len(batch):
                        continue
                yield kernel(pd.concat(held, ignore_index=True))
            cuts = [*np.flatnonzero(_starts(now)).tolist(), len(batch)]
            made = [kernel(batch.iloc[i:j].reset_index(drop=True)) for i, j in pairwise(cuts[:-1])]
            if made := [m for m in made if len(m)]:
                yield pd.concat(made, ignore_index=True)
            held = [batch.iloc[cuts[-2] :]]
        if held:
            yield kernel(pd.concat(held, ignore_index=True))

    return each


def _starts(keys: pd.DataFrame) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; nulls are alike."""
    import pandas as pd

    found = np.ones(len(keys), bool)
    found[1:] = False
    for name in keys.columns:
        a = keys[name].to_numpy()
        empty = pd.isna(a)
        found[1:] |= (a[1:] != a[:-1]) & ~(empty[1:] & empty[:-1])
    return found


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    return sizes.first()["n"] or 0


def rank_within(rows: DataFrame, by: list[str], order: list[Column], name: str = "k") -> DataFrame:
    """Rows with their rank, from 1, among those of equal `by`. Rows are dealt by ranges of by and order, ranks counted within
    ranges and then across, so a group that holds most rows is many tasks' work. The order should leave no ties."""
    dealt = checkpoint(rows.repartitionByRange(*map(F.col, by), *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select(*by, "_range", (F.sum("_n").over(so_far) - F.col("_n")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) + F.col("_start")
    return dealt.join(starts, [*by, "_range"]).withColumn(name, rank.cast("long")).drop("_range", "_start")


#: Distinct values that one task takes for a quantile.
TASK_VALUES = 1_000_000


def exact_quantile(rows: DataFrame, value: str, at: float, task_values: int = TASK_VALUES) -> DataFrame:
    """(q, most): the exact quantile over all rows, between two values by a straight line, and the greatest value; nulls do not
    count, and without values both are null. Values are counted first. Where too many differ for a task, their counts are dealt by
    ranges, and only the range or two that hold the quantile are sorted."""
    counts = checkpoint(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    sums = counts.agg(F.count("*").alias("values"), F.sum("n").alias("n")).first()
    most = F.max("v").alias("most")
    if sums["values"] <= task_values:
        return counts.agg(F.percentile("v", F.lit(at), F.col("n")).alias("q"), most)
    place = at * (sums["n"] - 1)
    low, high = math.floor(place), math.ceil(place)
    dealt = checkpoint(counts.repartitionByRange("v").withColumn("range", F.spark_partition_id()))
    so_far = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("range").agg(F.sum("n").alias("held")).withColumn("start", F.coalesce(F.sum("held").over(so_far), F.lit(0)))
    asked = starts.where((F.col("start") <= high) & (F.col("start") + F.col("held") > low)).select("range", "start")
    end = F.col("start") + F.sum("n").over(Window.partitionBy("range").orderBy("v"))
    spans = dealt.join(asked, "range").withColumn("end", end)
    holds = lambda k: F.max(F.when((F.col("end") > k) & (F.col("end") - F.col("n") <= k), F.col("v")))
    found = spans.agg(holds(low).alias("a"), holds(high).alias("b")).select((F.col("a") + (place - low) * (F.col("b") - F.col("a"))).alias("q"))
    return found.join(counts.agg(most), how="cross")


def few(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows that are broadcast if they are counted to be no more than `most`; else they are joined as any others."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
