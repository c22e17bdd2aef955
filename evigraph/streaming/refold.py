"""Structured Streaming over assertion logs: new lines refold only the ids they touch; and watching for changed answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.model import LOG
from evigraph.operators.fold import fold


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a log's folder."""
    r = spark.readStream.schema(LOG)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def refold(stream: DataFrame, log_path: str, state_path: str, checkpoint: str, buckets: int = 16, **trigger):
    """Keep the folded state of a growing log: a query that appends each batch to the log table and refolds its ids.

    Log and state are partitioned by a hash bucket of the id, and a batch rewrites only the buckets it touches, each from the whole stored
    log. So assertions may arrive late and out of order: the fold orders them by (at, pos), and no watermark drops any. A batch that
    runs again first replaces its own rows, which makes it idempotent.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        rows = batch.withColumns({"bucket": bucket, "batch": F.lit(number)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(log_path)
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
        if touched:
            whole = spark.read.parquet(log_path).where(F.col("bucket").isin(*touched))
            fold(whole).withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(state_path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def watch(stream: DataFrame, ask: Callable[[DataFrame], None], checkpoint: str, seconds: int = 1):
    """Call ``ask`` with each batch of new assertions, at most once in so many seconds: the change feed."""
    return stream.writeStream.foreachBatch(lambda batch, _: None if batch.isEmpty() else ask(batch)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def fingerprint(files: DataFrame) -> str:
    """A hash over (path, length, modified) of the files that answers rest on: equal as long as nothing changed."""
    r = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("path", "length", "modified")).alias("x"), F.sum(F.xxhash64("path", "length", "modified").cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{r['x']}-{r['s']}"


def stale_report(states: dict[str, list[str]], said: dict[str, list[str]], most: int = 3) -> list[str]:
    """Lines about answers that no longer stand, with up to three statements each."""
    return [line for name, s in states.items() if s != ["fresh"] for line in (f"{name}: {', '.join(s)}", *(f"  {x}" for x in said.get(name, [])[:most]))]
