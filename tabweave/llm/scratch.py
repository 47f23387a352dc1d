"""Intermediate tables in the folder that the whole cluster shares.

An operator that needs a result twice, or wants to cut lineage, writes it as
Parquet below ``spark.checkpoint.dir``.  Such a table outlives every executor,
so a lost executor costs a re-read and no recomputation of earlier stages.  Results
read their tables lazily; what no later step reads is dropped at once, and the rest by
``Scratch.drop`` or when the driver's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else the session's own checkpoint
    folder, else a new one (local masters: a temporary folder; clusters: the warehouse)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        own = tempfile.mkdtemp(prefix="checkpoints-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


#: Folders that this process has made and not dropped, with what their file system is found by.
_LEFT: dict[str, object] = {}


def _delete(path: str, conf: object) -> None:
    where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@atexit.register
def _end() -> None:
    """At the end of the driver's process: delete what is left, as far as its JVM still answers."""
    try:
        for path, conf in _LEFT.items():
            _delete(path, conf)
    except Exception:  # the JVM has ended before: the cluster's own cleaning of the folder remains
        pass


class Scratch:
    """A private folder of intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _LEFT[self.root] = spark._jsc.hadoopConfiguration()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as a table read back with the same schema."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads (all of them if no name is given)."""
        for at in [self.path(n) for n in names] or [self.root]:
            _delete(at, self.spark._jsc.hadoopConfiguration())
        if not names:
            _LEFT.pop(self.root, None)
