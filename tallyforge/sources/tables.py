"""Readers of the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes below which a table is left in the tasks it is read by, and above which it never is shuffled to spread it.
SMALL, LARGE = 1_000_000, 512_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a dataset folder; a table is a file or a folder of files."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame, least: int = SMALL) -> DataFrame:
    """``df``, of ``least`` bytes or more, over all cores where its files give work to half of them or fewer, as a single small file does.

    Tables of more files than that, and all of more than LARGE bytes, are left as they are read, so what is shuffled has a
    bound. Columns and filters still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if not least <= int(str(plan.optimizedPlan().stats().sizeInBytes())) <= LARGE or 2 * plan.toRdd().getNumPartitions() > cores:
        return df
    return df.repartition(cores)
