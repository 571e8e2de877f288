"""Scratch tables in the folder all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor never takes the only copy of a stage with it. Where the
setting is missing a local folder is used and set as the session's checkpoint folder,
but only if the session is local itself; on a cluster that is an error.

Within a ``scope()`` tables are deleted at its end, but for those that its result
reads, which are kept by name and belong to the scope around it.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class Scope:
    """Tables of one step; keep() returns its argument."""

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df


_OPEN: list[Scope] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def save(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as a new table of the shared folder and return a reader of it."""
    path = f"{shared_dir(spark).rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    if _OPEN:
        _OPEN[-1].tables.append(out)
    return out


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by save() that nothing reads any more."""
    if path := getattr(df, "_docloom_path", None):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Deletes the tables saved within, but for kept ones, which pass to the scope around."""
    own = Scope()
    _OPEN.append(own)
    try:
        yield own
    finally:
        _OPEN.remove(own)
        paths = {k._docloom_path for k in own.kept}
        for t in own.tables:
            if t._docloom_path in paths:
                if _OPEN:
                    _OPEN[-1].tables.append(t)
            else:
                drop(spark, t)
