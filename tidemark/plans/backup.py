"""Backups of a state with its settings, and bringing them back."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import files
from . import config
from .state import State

#: How backups are named, and days that they are kept.
PREFIX, DAYS = "state_backup_", 30
FILES = "filename string, size_bytes long, created_at string"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    p, system = _path(spark, path)
    file = system.create(p, True)
    file.write(bytearray(text.encode()))
    file.close()


def take(state: State, folder: str, now: Column, settings: config.Config | None = None, days: int = DAYS) -> str:
    """Copy one version of all tables of a state, and the settings, to a folder named by the time; old backups go. Returns its path.

    The version is pinned while it is copied, so changes may go on, and neither mix with it nor take its files away. Its tables
    are copied by Spark. A backup counts from the moment on that its manifest is there, which is written last.
    """
    spark = state.spark
    stamp = spark.range(1).select(S.file_stamp(now).alias("s")).first().s
    path = f"{folder.rstrip('/')}/{PREFIX}{stamp}"
    with state.pinned() as version:
        names = [name for name in state.schemas if state.folders(name, version)]
        for name in names:
            state.read(name, version).write.mode("overwrite").parquet(f"{path}/tables/{name}")
        _put(spark, f"{path}/manifest.json", json.dumps({"tables": names, "notes": state.notes(version), "settings": asdict(settings) if settings else None}))
    purge(spark, folder, now, days)
    return path


def restore(state: State, path: str) -> tuple[int, config.Config | None]:
    """Make a backup's tables and notes the state's next version, which replaces all of them at once; also gives the settings.

    Tables that the backup does not have become empty.
    """
    spark = state.spark
    p, system = _path(spark, f"{path.rstrip('/')}/manifest.json")
    if not system.exists(p):
        raise ValueError(f"no backup, or an unfinished one: {path}")
    file = system.open(p)
    known = json.loads(bytes(file.readAllBytes()).decode())
    file.close()
    read = lambda name: spark.read.schema(state.schemas[name]).parquet(f"{path.rstrip('/')}/tables/{name}")
    tables = {name: read(name) if name in known["tables"] else spark.createDataFrame([], state.schemas[name]) for name in state.schemas}
    version = state.change(written=tables, notes=known["notes"], forget=True)
    return version, config.Config(**known["settings"]) if known["settings"] else None


def _all(spark: SparkSession, folder: str) -> DataFrame:
    """name, size and age of each finished backup of a folder, from its files' sizes and its manifest's time."""
    inside = F.regexp_extract("path", f"/({PREFIX}[0-9_]+)/", 1)
    rows = files.backup_files(spark, folder).withColumn("name", inside).where("name <> ''").groupBy("name").agg(
        F.sum("length").alias("length"), F.max(F.when(F.col("path").endswith("/manifest.json"), F.col("modificationTime"))).alias("modificationTime")
    )
    return rows.where("modificationTime is not null")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """filename, size_bytes and created_at of the backups, the newest first."""
    if not files.exists(spark, folder):
        return spark.createDataFrame([], FILES)
    rows = _all(spark, folder).select(F.col("name").alias("filename"), F.col("length").cast("long").alias("size_bytes"), S.stamp("modificationTime").alias("created_at"))
    return rows.orderBy(F.desc("created_at"), F.desc("filename"))


def purge(spark: SparkSession, folder: str, now: Column, days: int = DAYS) -> int:
    """Delete backups that are more than so many days old by their names; returns how many. They are few by nature."""
    if not files.exists(spark, folder):
        return 0
    stamp = F.to_timestamp_ntz(F.substring("name", len(PREFIX) + 1, 15), F.lit("yyyyMMdd_HHmmss"))
    old = _all(spark, folder).where(stamp < now - F.make_interval(days=F.lit(days))).select("name").collect()
    for row in old:
        p, system = _path(spark, f"{folder.rstrip('/')}/{row.name}")
        system.delete(p, True)
    return len(old)
