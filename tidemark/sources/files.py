"""Logs and backups as files of any file system that Spark reads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..schemas import LOG

#: Lines in a file of a log that is written in order.
LINES = 500_000


def append_logs(lines: DataFrame, path: str) -> None:
    """Append JSON lines (column line) to a log folder."""
    lines.select("line").write.mode("append").text(path)


def append_logs_in_order(lines: DataFrame, by: str, path: str) -> None:
    """Append JSON lines in the order of a column, about LINES to a file, so that what a task sorts does not grow. The files' numbers tell their order."""
    files = max(1, math.ceil(lines.count() / LINES))
    append_logs(lines.repartitionByRange(files, by).sortWithinPartitions(by), path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log events of a folder, with the fields that each line has."""
    return spark.read.schema(LOG).json(path)


def follow_logs(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream."""
    return spark.readStream.schema(LOG).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def log_path(spark: SparkSession, path: str) -> str | None:
    """Where the log can be fetched; None where there is none."""
    return path if exists(spark, path) else None


def backup_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of every file under a folder, contents not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def purge_backups(spark: SparkSession, folder: str, now: Column, days: int = 30) -> int:
    """Delete backup files older than so many days; returns how many. Their names, few by nature, pass the driver."""
    if not exists(spark, folder):
        return 0
    hadoop, gone = spark.sparkContext._jvm.org.apache.hadoop.fs, 0
    for row in reports.expired_backups(backup_files(spark, folder), now, days).select("path").toLocalIterator():
        p = hadoop.Path(row.path)
        gone += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)
    return gone


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    return reports.backups(backup_files(spark, folder)) if exists(spark, folder) else spark.createDataFrame([], "filename string, size_bytes long, created_at string").orderBy(F.desc("created_at"))
