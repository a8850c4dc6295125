"""Streaming forms: order totals, hourly load and query-log screening.

Results go to files in the shared folder, one folder per micro-batch that a
retry overwrites, so a batch that runs twice is counted once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tavola.operators import guard
from tavola.operators.reports import revenue
from tavola.session import cut, shared_dir


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def read_files(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream: a folder of Parquet files, or the files of `folder` whose name matches.

    `files_per_batch` bounds a micro-batch; without it, one takes all files that are there.
    """
    files, path = _path(spark, f"{folder}/{name}")
    is_folder = "*" not in name and files.exists(path) and files.getFileStatus(path).isDirectory()
    options = {} if is_folder else {"pathGlobFilter": name}
    source = f"{folder}/{name}" if is_folder else folder
    schema = spark.read.options(**options).parquet(source).schema
    if files_per_batch is not None:
        options["maxFilesPerTrigger"] = files_per_batch
    return spark.readStream.schema(schema).options(**options).parquet(source)


def order_totals(items: DataFrame) -> DataFrame:
    """Running total per order; inserts only."""
    return items.groupBy("order_id").agg(F.sum(revenue()).alias("total_amount"))


def hourly_load(orders: DataFrame, late: str | None = None) -> DataFrame:
    """Orders per location and hour window.

    Without `late` every row counts, in whatever order files arrive, and the state has one row per
    location and hour. With it, closed hours leave the state and rows further
    behind are dropped; `run` reports how many.
    """
    timed = orders.withColumn("order_time", F.col("order_time").cast("timestamp"))
    timed = timed if late is None else timed.withWatermark("order_time", late)
    return (
        timed.groupBy("restaurant_id", F.window("order_time", "1 hour").alias("hour"))
        .agg(F.count(F.lit(1)).alias("orders_count"))
        .select("restaurant_id", F.col("hour.start").alias("hour_start"), "orders_count")
    )


def screened(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Verdicts of the layers before the model; no state."""
    return guard.scan(log, sql)


def run(
    stream: DataFrame,
    mode: str = "append",
    folder: str | None = None,
    checkpoint: str | None = None,
    dropped: list[int] | None = None,
) -> str:
    """Run a stream over the input that is there and return the folder of its output.

    A repeated call with the same `checkpoint` goes on where the last one ended;
    without one, the state is removed at the end. `dropped` gets the number of
    rows that came too late for the stream's watermark.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    folder = folder or f"{base}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    if dropped is not None:
        progress = [p.stateOperators for p in query.recentProgress]
        dropped.append(sum(op.numRowsDroppedByWatermark for ops in progress for op in ops))
    if checkpoint is None:
        remove(spark, f"{base}/state")
    return folder


def run_guarded(
    stream: DataFrame, check: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, flag: str = "accepted"
) -> tuple[str, str]:
    """Run a stream of proposals over the input that is there, with two sinks that share one checkpoint.

    `check` adds `flag` to a micro-batch, for instance by joining tables as they are then. Rows where it holds
    go to the first folder returned, all others to the second. A batch that failed between the two
    is done again as a whole, and both of its folders are overwritten, so no row is in both or in neither.
    """
    good, bad = f"{folder}/{flag}", f"{folder}/rejected"

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = check(batch).persist()
        try:
            holds = F.coalesce(F.col(flag), F.lit(False))
            checked.where(holds).drop(flag).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            checked.where(~holds).drop(flag).write.mode("overwrite").parquet(f"{bad}/batch={batch_id}")
        finally:
            checked.unpersist()

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return good, bad


def remove(spark: SparkSession, folder: str) -> None:
    files, path = _path(spark, folder)
    files.delete(path, True)


def finished(stream: DataFrame, mode: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`shape` of what the stream wrote, kept as a checkpoint; the stream's folder is removed."""
    spark = stream.sparkSession
    folder = run(stream, mode)
    result = cut(shape(results(spark, folder)))
    remove(spark, folder.removesuffix("/out"))
    return result


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All rows a stream wrote, with their `batch`."""
    return spark.read.option("basePath", folder).parquet(folder)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row written per key, for streams in update mode."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*")
