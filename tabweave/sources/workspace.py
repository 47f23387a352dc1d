"""Files and folders by Hadoop paths, and a shared folder for what queries write and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

_LEFT: dict[str, object] = {}


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = filesystem(spark, path)
    return fs.exists(where)


def put(spark: SparkSession, path: str, data: bytes, chunk: int = 8 << 20) -> None:
    """Write one file where the whole cluster sees it."""
    fs, where = filesystem(spark, path)
    out = fs.create(where, True)
    try:
        for a in range(0, len(data), chunk):
            out.write(bytearray(data[a : a + chunk]))
    finally:
        out.close()


def workspace(spark: SparkSession) -> str:
    """A new private folder below ``spark.checkpoint.dir`` (unset: the session's checkpoint folder, a temporary one for
    local masters, the warehouse on clusters); deleted when the driver's process ends."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        local = spark.sparkContext.master.split("[")[0] == "local"
        named = tempfile.mkdtemp(prefix="workspace-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    path = f"{named.rstrip('/')}/tables-{uuid.uuid4().hex}"
    _LEFT[path] = spark._jsc.hadoopConfiguration()
    return path


@atexit.register
def _end() -> None:
    try:
        for path, conf in _LEFT.items():
            where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    except Exception:  # the JVM has ended before
        pass
