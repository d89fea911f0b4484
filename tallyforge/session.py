"""Session helpers: a tuned local session and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine is tested under; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyforge")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names in spark.checkpoint.dir.

    A machine-local one is used only where none is named and the master runs in this process, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "tallyforge-shared")
    return named


_open: list[list[str]] = []


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``cut_lineage`` writes inside are removed at the end: a driver that lives long calls its queries in it.

    What the queries return must be written out inside too.
    """
    mine: list[str] = []
    _open.append(mine)
    try:
        yield mine
    finally:
        _open.remove(mine)
        for folder in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder, so that a lost executor costs no recomputation.

    A written table is smaller than a checkpoint, is read by the columns that are needed, and has a known size, so that
    later joins are planned by it. It is removed when the driver ends, or by ``written_tables``.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    for open_list in _open:
        open_list.append(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
