"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Batches between Spark and Python workers are small, which bounds what a worker, and Spark beside its heap, hold at once.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
#: Held while a table is written: a query's shuffle files are deleted when it ends, not when the driver collects its garbage,
#: and batches are small.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **BATCHES}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a temporary folder, but only if all runs on one machine."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


@contextmanager
def settings_held(spark: SparkSession, settings: dict[str, str] = SETTINGS) -> Iterator[None]:
    """Within it ``settings`` hold; the session's own come back after it."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v.removesuffix("b"))


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches are small: for a job whose rows its caller writes, out of reach of ``settings_held``."""
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


#: Tasks for each core, at least, of jobs in ``balanced``.
TASKS_A_CORE = 4


def balanced(spark: SparkSession):
    """Within it stages have at least four tasks a core (where a task has 128 KB): with one or so a core, as Spark makes of
    small rows that take long, a stage lasts as long as the cores that have two."""
    n, merged = str(TASKS_A_CORE * spark.sparkContext.defaultParallelism), "spark.sql.adaptive.coalescePartitions"
    return settings_held(spark, {f"{merged}.minPartitionNum": n, f"{merged}.minPartitionSize": "131072", "spark.sql.files.minPartitionNum": n})


_JOBS = threading.local()


@contextmanager
def dropped_at_end(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, all intermediate tables that this thread has made within it; what it gives must be written by then."""
    jobs = _JOBS.__dict__.setdefault("open", [])
    jobs.append([])
    try:
        yield
    finally:
        for scratch in jobs.pop():
            scratch.drop_all()


class Scratch:
    """The intermediate tables of one job, in a folder of its own below the shared one.

    Each is written once and read again, so plans stay short and a lost executor costs no table that is written. A table is
    dropped as soon as what reads it is written itself.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.places: dict[int, tuple[str, DataFrame]] = {}
        if jobs := getattr(_JOBS, "open", None):
            jobs[-1].append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again."""
        self.count += 1
        place = f"{self.path}/{self.count}-{name}"
        with settings_held(self.spark):
            df.write.parquet(place)
        out = self.spark.read.schema(df.schema).parquet(place)
        self.places[id(out)] = place, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that ``keep`` has returned."""
        for table in tables:
            self._delete(self.places.pop(id(table))[0])

    def drop_but(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        kept = {id(t) for t in tables}
        self.drop(*(t for _, t in list(self.places.values()) if id(t) not in kept))

    def drop_all(self) -> None:
        """Deletes the job's folder."""
        self.places.clear()
        self._delete(self.path)

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: a short plan, and nothing lost with an executor."""
    return Scratch(df.sparkSession, name).keep(df, name)
