"""Written tables in the folder that every executor sees: they cut lineage and outlive executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Paths written by durable(), in order.
_WRITTEN: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """A folder of this application's own in spark.checkpoint.dir. Where that is unset: a temporary one on a local master, else an error."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _ROOTS[app] = f"{(named or tempfile.mkdtemp(prefix='sifter-')).rstrip('/')}/sifter-{uuid.uuid4().hex}"
    return _ROOTS[app]


def durable(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: lineage is cut and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def written(spark: SparkSession) -> int:
    """How many tables this application has written and not dropped: a mark for drop_since()."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_since(spark: SparkSession, mark: int) -> None:
    """Drop the tables written since the mark but the last one, which what came of the others was written to."""
    held = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in held[mark:-1]:
        drop_table(spark, path)
    del held[mark:-1]


def release(spark: SparkSession) -> None:
    """Delete this application's tables in the shared folder; call it when no result that reads them is needed any more."""
    _WRITTEN.pop(spark.sparkContext.applicationId, None)
    root = _ROOTS.pop(spark.sparkContext.applicationId, None)
    if root:
        drop_table(spark, root)
