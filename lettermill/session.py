"""Session settings and shared scratch space.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``, which every
executor can reach. Only a session whose executors are threads of this process gets a folder of its own
without that setting; any other is told to name one.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting that names a session's own part of the shared folder, below which release() deletes.
_OWN = "lettermill.scratch"
#: Scratch paths of each session, in the order in which they were made, and the tables read from them.
_PATHS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session, as a URI or path that Spark's writers accept."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lettermill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _paths(spark: SparkSession) -> list[str]:
    own = spark.conf.get(_OWN, None)
    if not own:
        own = uuid.uuid4().hex
        spark.conf.set(_OWN, own)
    return _PATHS.setdefault(own, [])


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _paths(spark).append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: what follows reads files that outlive any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark(spark: SparkSession) -> int:
    """A point in time for release(): what is made from now on comes after it."""
    return len(_paths(spark))


def release(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Delete this session's scratch tables made since a mark, but for those that the tables in keep read.

    Results that were not written yet and read a deleted table can't be read after that. Tables of other
    sessions stay.
    """
    paths = _paths(spark)
    read = {f for df in keep for f in df.inputFiles()}
    plain = lambda p: re.sub(r"^file:/+", "/", p)
    stay = [p for p in paths[since:] if any(plain(f).startswith(plain(p) + "/") for f in read)]
    jvm = spark.sparkContext._jvm
    for gone in paths[since:]:
        if gone not in stay:
            p = jvm.org.apache.hadoop.fs.Path(gone)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths[since:] = stay


def count(df: DataFrame) -> int:
    """Number of rows."""
    return df.agg(F.count(F.lit(1))).first()[0]
