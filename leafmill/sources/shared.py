"""The folder that all executors and the driver share, and tables that are used more than once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import weakref

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's process."""
    return re.match(r"local($|\[)", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a private one only where that is unset and all tasks share the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        found = tempfile.mkdtemp(prefix="leafmill-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def store(spark: SparkSession, path: str):
    """A path and its file system, as the JVM sees them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def until_end(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the application ends."""
    place, files = store(spark, path)
    files.deleteOnExit(place)
    return path


def reused(table: DataFrame) -> DataFrame:
    """``table``, kept by the executors (in memory, else on disk) once it has been computed; see ``releasing``."""
    return table.persist()


def releasing(result: DataFrame, *kept: DataFrame) -> DataFrame:
    """``result``, with whose last reference what it was made from is given free."""
    for table in kept:
        weakref.finalize(result, _release, table).atexit = False
    return result


def _release(table: DataFrame) -> None:
    context = table.sparkSession.sparkContext._jsc
    if context is not None and not context.sc().isStopped():
        table.unpersist()
