"""Session factory and the shared folder for materialised tables."""

from __future__ import annotations

import gc
import logging
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session settings this engine relies on; a caller's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "quillmesh", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with this engine's defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return b.config(map=DEFAULTS | conf).getOrCreate()


def log_to(level: int = 2, path: str | None = None, keep: bool = False) -> None:
    """Log this package at level 0 (errors) to 3 (everything), to the console or to a file, which is begun anew unless ``keep``."""
    own = logging.getLogger("quillmesh")
    own.handlers = [logging.FileHandler(path, "a" if keep else "w") if path else logging.StreamHandler()]
    own.handlers[0].setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
    own.setLevel((logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG)[max(0, min(3, level))])


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only where a session names none (tests on one machine) a folder of our own
    is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.getCheckpointDir():
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"quillmesh-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def tasks(spark: SparkSession, rows: int = 0, each: int = 1) -> int:
    """Tasks for a step whose work is in computing, not in bytes: AQE would merge its small partitions to a few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, rows // each)


class Scratch:
    """Tables written to the shared folder, to cut lineage and reuse results.

    They are plain parquet files, so a lost executor loses nothing, and reading
    them back gives the planner real sizes. Files go when :meth:`drop` is
    called, and at the latest when the JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/quillmesh-{uuid.uuid4().hex}"
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        self._fs = path.getFileSystem(conf)
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a reader of the written table."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Let go of shuffle files that only finished queries used.

        Spark frees them once the driver's JVM has collected the plans that
        made them; after a large table was saved this is worth asking for.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Remove the files of a saved table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
