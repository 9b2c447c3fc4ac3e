"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a session of one machine gets a
    temporary one, and a cluster's session fails, since its executors share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(jvm, conf, path: str) -> None:
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def _at_exit(jvm, conf, path: str) -> None:
    try:
        _remove(jvm, conf, path)
    except Exception:  # the JVM may have ended before
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder, which is removed when its driver ends."""
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/tables-{context.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_at_exit, context._jvm, context._jsc.hadoopConfiguration(), folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there,
    and a lost executor costs a reread instead of a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(table: DataFrame) -> None:
    """Removes a materialized table that no later plan reads; anything else stays as it is."""
    path = _paths.pop(table, None)
    if path:
        context = table.sparkSession.sparkContext
        _remove(context._jvm, context._jsc.hadoopConfiguration(), path)
