"""Helpers for large tables: lineage cuts, written tables, distributed ranking."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share. Only under a local
    master without that setting a temporary folder is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and go on from the written table.

    Cuts lineage, survives lost executors, and gives the planner the true size of what follows.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks for each core of the cluster where rows are dealt anew for work that is many times their size.
TASKS_PER_CORE = 3


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows that much work hangs on, dealt over all cores if their files give fewer tasks than that.

    Files are split by bytes and never inside a row group, so a file of a million narrow rows is one task.
    """
    tasks = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


class RunFolder:
    """Written tables of one run, below the shared folder; all of them go when the run ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> RunFolder:
        return self

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class BucketTable:
    """A table in the shared folder whose rows lie in hash buckets of a key, sorted by it inside each file.

    There are as many buckets as shuffle partitions, so that joins and aggregations by the key read it
    without an exchange, on whichever side it stands. ``add`` appends; every file holds rows of one bucket.
    The catalog entry only serves to plan with the buckets and goes with ``close``, the files stay.
    """

    def __init__(self, spark: SparkSession, name: str, key: str):
        self.spark, self.key = spark, key
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, rows: DataFrame) -> int:
        """Append rows; their number, observed while they are written."""
        seen = Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = rows.write.format("parquet").mode("append").bucketBy(self.buckets, self.key).sortBy(self.key)
        writer.option("path", self.path).saveAsTable(self.name)
        return seen.get["rows"]

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from the written rows. The files go when
    the result is no longer referenced (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def row_ranks(df: DataFrame, order: list, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """0-based position of every row in ``order``, within ``by`` if given, without one big sort task.

    Rows are range partitioned on (by, order) and numbered inside their partition; the partition
    sizes (at most one row per group and partition) then shift the local numbers. ``order`` should
    be unique within a group, otherwise ties are numbered arbitrarily.
    """
    by = by or []
    keys = [*map(F.col, by), *order]
    placed = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy(*by, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    return (
        placed.join(starts.drop("_rows"), [*by, "_part"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_start"))
        .drop("_at", "_part", "_first", "_start")
    )
