"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tokentide", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    Shuffle width is left to the cluster; adaptive execution coalesces small
    partitions and splits skewed ones at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local: dict[str, str] = {}
_scope: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("tokentide_scope", default=None)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    On a cluster it has to be set: executors and the driver share no local folder.
    A session on one machine falls back to a temporary one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _local.setdefault(app, _local.get(app) or tempfile.mkdtemp(prefix="tokentide-"))
    return path.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) for tests of existence, listing and deletion in any store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owns what is staged inside: its tables are deleted at the end.

    Put it around a plan and the action on its result.
    """
    mine: list[tuple[SparkSession, str]] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        for _, path in mine:
            files, place = hadoop_path(spark, path)
            files.delete(place, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{work_dir(spark)}/tokentide/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used where several branches consume the same expensive result (parsed logs,
    loop state): the work is done once and the lineage ends at a durable table,
    so a lost executor re-reads files instead of recomputing. Inside ``staging`` the
    table goes at the end of the scope, else with the folder's own retention rule.
    """
    path = new_path(df.sparkSession, label)
    if (mine := _scope.get()) is not None:
        mine.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
