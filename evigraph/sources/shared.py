"""Written intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for applications without the setting.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's shared one; only a local session without that setting (tests) gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="evigraph-")
        found = _own_folders[app]
    return f"{found.rstrip('/')}/evigraph-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table, read again: cuts the lineage of loops and survives lost executors. ``by`` names a column of few values
    whose filters then choose files."""
    path = shared_folder(df.sparkSession, name)
    if by is None:
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns))


def unsized(df: DataFrame) -> DataFrame:
    """``df`` with a size that isn't known before it has run. Spark takes a Parquet table's columns for their types' share of its compressed files: in wide
    tables with many empty columns, ids of any number seem to be a few MB, and joins send them through the driver. The other side of such a join
    starts as a shuffle, which adaptive execution turns into a broadcast by the bytes that were made."""
    spark = df.sparkSession
    return df.union(spark.createDataFrame(spark.sparkContext.emptyRDD(), df.schema))
