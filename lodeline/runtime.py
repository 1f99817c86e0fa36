"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that checkpoints go to.

    A cluster names a shared folder in ``spark.checkpoint.dir``; it is used as given. Only where the
    setting is absent (tests, a local shell) a temporary folder is made.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodeline-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A table that is read several times, by columns: Parquet in the shared checkpoint folder."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


SETTLED_ROWS = 20_000


def settled(df: DataFrame, most: int = SETTLED_ROWS) -> DataFrame:
    """``df`` computed once for several readers: checkpointed, and held as a local relation of the plan if it has at most ``most`` rows.

    A local relation's size is known exactly, so what joins it is planned as a broadcast without a stage of its own. The rows are the same either way.
    """
    done = materialize(df)
    rows = done.limit(most + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, schema=done.schema) if rows.num_rows <= most else done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Repartition a small-file input for CPU-heavy Python stages; keyed by ``cols`` if given."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(c) for c in cols]) if cols else df.repartition(n)


def enough_tasks(df: DataFrame) -> DataFrame:
    """A scan of few files spread over the cores for a CPU-heavy stage; a scan with enough splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def literal(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows as a local relation of the plan: no Python partition, and the optimiser knows their size."""
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), schema=kind)


def is_literal(df: DataFrame, most_bytes: int = 8 << 20) -> bool:
    """Whether the plan stands on local relations only, whose size is exact."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    return all(leaves.apply(i).getClass().getSimpleName() in ("LocalRelation", "OneRowRelation") for i in range(leaves.size())) and int(str(plan.stats().sizeInBytes())) <= most_bytes


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """Broadcast a side after its rows were counted; more than ``most`` is an error, to be run in several calls."""
    if not is_literal(df) and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}: run them in several calls")
    return F.broadcast(df)


def folder_of(spark: SparkSession, folder: str):
    """The file system and the path of a folder, on whatever store its scheme names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a work table of the shared folder."""
    fs, path = folder_of(spark, folder)
    fs.delete(path, True)


def publish(spark: SparkSession, staged: str, target: str) -> None:
    """Rename a staged folder to its place; an existing target is an error and stays as it is."""
    fs, place = folder_of(spark, target)
    if fs.exists(place):
        raise FileExistsError(target)
    if not fs.rename(folder_of(spark, staged)[1], place):
        raise OSError(f"could not publish {staged} as {target}")
