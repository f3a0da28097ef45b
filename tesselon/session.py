"""Session defaults and the few session-level helpers that operators need."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tesselon", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's defaults; ``conf`` wins over them, and so does an existing session."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | (conf or {})).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where the cluster names it.

    Only where the setting is missing (tests on one machine) a temporary folder is made and used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tesselon-")
    atexit.register(shutil.rmtree, folder, True)
    return "file://" + folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored reliably in the shared folder; later reads survive lost executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(os.path.join(shared_dir(df.sparkSession), "tesselon-" + uuid.uuid4().hex[:12]))
    return df.checkpoint(eager=True)


def store_table(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read from there; later reads survive lost executors.

    The tables of an application lie in one folder, which is removed when its driver ends (or by ``drop_tables``).
    """
    return store_parts([df])


#: Whether Spark removes a query's shuffle files when it has ended, and not when the driver happens to collect its garbage.
_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """Like ``store_table``, of one or more DataFrames of one schema, which are computed and written one after the other.

    The shuffle files of each are removed once it is written; whoever reads the table doesn't need them.
    """
    path = df = None
    for df in parts:
        path = path or f"{_tables_folder(df.sparkSession)}/{uuid.uuid4().hex}"
        conf = df.sparkSession.conf
        before = conf.get(_SHUFFLES, None)
        conf.set(_SHUFFLES, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            conf.unset(_SHUFFLES) if before is None else conf.set(_SHUFFLES, before)
    if df is None:
        raise ValueError("nothing to store")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Removes a stored table that nothing reads any more, such as a round of an iteration once the next one is written.

    Only tables that ``store_table`` and ``store_parts`` wrote are removed; others stay.
    """
    spark = table.sparkSession
    for file in {name.rpartition("/")[0] for name in table.inputFiles() if "/tesselon-tables/" in name}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _tables_folder(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/tesselon-tables/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(drop_tables, spark)
    return folder


_folders: set[str] = set()


def drop_tables(spark: SparkSession) -> None:
    """Removes the tables that this application stored; DataFrames that read them can't be computed any more."""
    try:
        folder = f"{shared_dir(spark)}/tesselon-tables/{spark.sparkContext.applicationId}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; its folder is left to the cluster
        return
