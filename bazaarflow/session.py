"""Session settings and the shared scratch folder."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot provider, booking or phone lands in one join partition; AQE splits it at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "bazaarflow", **settings: str) -> SparkSession:
    """A session with the library's settings; master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_library(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application, as --py-files would.

    The archive is put in the shared folder; Spark sends it to the executors.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.relpath(path, os.path.dirname(package)))
    path = f"{scratch_path(spark, 'code')}/bazaarflow.zip"
    system, target = _file_system(spark, path)
    stream = system.create(target)
    stream.write(archive.getvalue())
    stream.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or else one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, on leaving, the scratch folders made inside; their DataFrames are of no use then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, gone with its scope or at the latest with the application."""
    path = f"{shared_dir(spark)}/bazaarflow/{label}-{uuid.uuid4().hex}"
    system, target = _file_system(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialise(df: DataFrame, label: str, path: str | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once, below the shared folder or to ``path``, and read it back.

    Cuts lineage like a checkpoint, but in a columnar file, so each later reader loads only
    its own columns. With ``rows_per_file`` a task that holds more rows writes several files,
    which as many tasks can read.
    """
    path = path or scratch_path(df.sparkSession, label)
    schema = df.schema
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where it is absent."""
    system, target = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path the library wrote."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def read_text(spark: SparkSession, path: str) -> str:
    """A small file the library wrote."""
    system, target = _file_system(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, target = _file_system(spark, path)
    stream = system.create(target, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def rename_to_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a file in one step; False, and nothing changed, where the target is there already."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        jvm.org.apache.hadoop.fs.Path(source).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(
            jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target), options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
