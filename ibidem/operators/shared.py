"""Tables kept between steps in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def fresh_folder(spark: SparkSession) -> str:
    """A path under the shared folder that nothing else is written to. clear() deletes it."""
    path = f"{shared_folder(spark).rstrip('/')}/ibidem-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_made: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this application's operators have kept between steps, once its results have been saved; how many
    there were. Frames that still read from there can't be used any more."""
    held, n = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        top = held(path)
        n += bool(top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(top, True))
    return n


def written(df: DataFrame) -> DataFrame:
    """df as a table under the shared folder, read back: it is computed once, and lost executors don't lose it."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows, by counting no more than one beyond."""
    return df.limit(most + 1).count() <= most


def lexicon(df: DataFrame, most: int = 20_000) -> DataFrame:
    """A table of patterns or names that is compared with every text, to be broadcast; more rows than that are an error."""
    if not small(df, most):
        raise ValueError(f"a lexicon of more than {most} rows can't be compared with every text")
    return F.broadcast(df)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_ibidem_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), "ibidem_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._ibidem_shipped = True
