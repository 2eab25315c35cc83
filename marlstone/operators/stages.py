"""Tables between the steps of a job, in a folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of this process, by application; those of applications that ended go with the next one.
_folders: dict[str, tuple] = {}


def shared(warehouse: str, master: str) -> str:
    """The warehouse, unless it is a folder of one machine of a cluster."""
    if warehouse.startswith(("file:", "/")) and not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is on a local disk")
    return warehouse


def stage_dir(spark: SparkSession) -> str:
    """The folder of this application's stage tables: below ``spark.checkpoint.dir``, or below the
    warehouse, which executors share too, where that is unset. A warehouse on the local disk is
    taken only where the master is local; elsewhere executors would not share it, so that raises.
    The folder is deleted when the application's JVM ends, or earlier by :func:`drop_stages`."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = shared(spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)
    path = f"{base}/stages-{app}"
    if path not in _folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        for old in [k for k in _folders if not k.endswith(app)]:
            _delete(old)
        _folders[path] = (fs, at)
    return path


def _delete(path: str) -> None:
    fs, at = _folders.pop(path)
    fs.delete(at, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete all stage tables of the application; results that still read them must be written."""
    app = spark.sparkContext.applicationId
    for path in [k for k in _folders if k.endswith(app)]:
        _delete(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go with its end, not with the driver's next garbage
    collection: once its table is written nothing reads them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the stage folder and read back: its lineage and plan end there, a lost
    executor costs only the tasks that read it, and adaptive execution sees real sizes. The files
    stay until :func:`drop_stage`, :func:`drop_stages` or the end of the application."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Remove the files behind a :func:`settled` result that nothing reads any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def dealt(rows: DataFrame, *keys: str, most: int = 100_000) -> DataFrame:
    """``rows`` in tasks of about ``most`` each, by ``keys`` where they are given, and in one for every core
    at least. Rows are counted, which takes no more than the footers of a stage table or an input
    file, so that the number of tasks grows with them and the memory of one does not."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-rows.count() // most)), *keys)


class Buckets:
    """A stage table that grows, in buckets of ``keys``: rows that are joined with it by the same
    keys are shuffled, its own are not. Its files go the way of all stage tables."""

    def __init__(self, rows: DataFrame, keys: list[str]):
        self.spark, self.keys, self.schema = rows.sparkSession, keys, rows.schema
        self.name = f"stage_{uuid.uuid4().hex}"
        self.path = f"{stage_dir(self.spark)}/{self.name}"
        self.count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.append(rows)

    def append(self, rows: DataFrame) -> None:
        # dealt as the buckets are, so that each task writes one file
        dealt = rows.repartition(self.count, *self.keys)
        with shuffles_freed(self.spark):
            dealt.write.mode("append").bucketBy(self.count, *self.keys).sortBy(*self.keys).option("path", self.path).saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """The rows go with their name."""
        drop_stage(self.close())

    def close(self) -> DataFrame:
        """The rows by their files; the name is given up."""
        self.spark.sql(f"DROP TABLE {self.name}")
        out = self.spark.read.schema(self.schema).parquet(self.path)
        out._stage_path = self.path
        return out
