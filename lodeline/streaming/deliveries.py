"""Incremental upkeep of the snapshot and of postings with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodeline.operators.audit import latest
from lodeline.runtime import folder_of, literal


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts by window with a watermark; the same plan runs on a batch."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


BUCKETS = 64


def _pointer(spark: SparkSession, target: str) -> tuple[int, dict[int, int]]:
    """The last batch that is complete and the version of each bucket; ``(-1, {})`` for a new snapshot."""
    fs, folder = folder_of(spark, target)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [int(n.removeprefix("pointer-")) for n in names if n.startswith("pointer-") and n.removeprefix("pointer-").isdigit()]
    if not done:
        return -1, {}
    rows = spark.read.schema("bucket int, version long").json(f"{target}/pointer-{max(done)}").collect()  # one row for each bucket
    return max(done), {r["bucket"]: r["version"] for r in rows}


def current_snapshot(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The newest rows as the last complete batch left them."""
    _, versions = _pointer(spark, target)
    paths = [f"{target}/bucket={b}/version={v}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_newest(key: str, order: Callable[[], list], target: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the newest row of each key.

    The snapshot is cut into buckets by the key's hash; a batch rewrites the buckets that it touches, each as a new version, and then writes a pointer
    that names the version of every bucket. Readers follow the last pointer, so they see whole batches only, and a batch that is repeated does nothing
    once its pointer stands.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last, versions = _pointer(spark, target)
        if number <= last:
            return
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = batch.withColumn("bucket", bucket)
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most `buckets` rows
        old = [f"{target}/bucket={b}/version={versions[b]}" for b in touched if b in versions]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*old)) if old else batch
        fresh = latest(rows, key, order()).withColumn("bucket", bucket).withColumn("version", F.lit(number))
        fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)
        named = [(b, number if b in touched else v) for b, v in sorted((versions | dict.fromkeys(touched, number)).items())]
        literal(spark, named, "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{target}/writing-{number}")
        fs, path = folder_of(spark, f"{target}/writing-{number}")
        fs.rename(path, folder_of(spark, f"{target}/pointer-{number}")[1])  # one step: the pointer stands as a whole or not at all

    return write


def keep_snapshot(stream: DataFrame, key: str, order: Callable[[], list], target: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(upsert_newest(key, order, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_postings(stream: DataFrame, doc: str, tokens: Callable[[], object], target: str, checkpoint: str) -> StreamingQuery:
    """Postings of arriving documents, appended exactly once by the file sink."""
    rows = stream.select(F.col(doc).alias("doc"), F.explode(tokens()).alias("term"))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
