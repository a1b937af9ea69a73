"""Small files in folders that all executors and later runs share: put once, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    """A path and the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = hadoop(spark, path)
    return files.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names directly below a folder; none if it doesn't exist."""
    where, files = hadoop(spark, folder)
    return [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, files = hadoop(spark, path)
    files.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, or None if there is no such file."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def put_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a file whole or not at all; ``FileExistsError`` if there is one already.

    The text goes to a hidden draft, which is then renamed without overwriting: of two
    writers one fails. HDFS and the like decide that atomically; object stores
    need a committer or a connector that does.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    final, files = hadoop(spark, path)
    draft, _ = hadoop(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(text.encode())
    out.close()
    start, end = files.makeQualified(draft), files.makeQualified(final)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(start.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(start, end, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        files.delete(draft, False)
        if files.exists(final):
            raise FileExistsError(path) from e
        raise
