"""Helpers that every training-data operator shares: tables, shared storage, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space, tab, LF, VT, FF, CR.
WORD_BREAK = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, a local one on a local master; on a
    cluster that is an error, since executors can't read each other's folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing there is ever overwritten. clear() deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/ibidem-{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_made: dict[str, list[str]] = {}


def clear(spark: SparkSession) -> int:
    """Deletes what this application's operators have written to the shared folder, once their results have been saved; the
    number of paths deleted. Frames that still read from there can't be used any more."""
    from pyarrow import fs

    n = 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        store, top = file_system(path)
        if store.get_file_info(top).type == fs.FileType.Directory:
            store.delete_dir(top)
            n += 1
    return n


def file_system(path: str):
    """Arrow's file system for a Hadoop path, and the path within it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        path = f"s3:{rest}"
    elif colon and scheme == "dbfs":
        path = f"/dbfs/{rest.lstrip('/')}"
    elif colon and scheme in ("wasb", "wasbs", "abfs", "abfss"):
        path = f"abfs{'s' if scheme[-1] == 's' and scheme not in ('wasb', 'abfs') else ''}:{rest}"
    return fs.FileSystem.from_uri(os.path.abspath(path) if "://" not in path and not path.startswith("file:") else path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_ibidem_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), "ibidem_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._ibidem_shipped = True


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def words(text: Column) -> Column:
    """Words of a text, in order; an empty array for null or for a text without words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)
