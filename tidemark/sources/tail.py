"""The end of a folder of rotated log files, read backwards."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import backup_files, exists

#: Bytes that are read at a time; bits of a position that are the place in a file.
BLOCK, PLACE = 1 << 20, 44
LINES = "file string, block long, line long, position long, text string"
#: The files of one Spark write: their number, and the name of the write.
PART = r"/part-(\d+)-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[^/]*$"
#: Fixed value: what is shown where there is no log.
NONE = "Log file not initialized yet."


def _blocks(spark: SparkSession, folder: str, block: int) -> list[tuple[str, int, int, int]]:
    """Path, number by age, size and blocks of the folder's files, the oldest first. Rotation keeps these few."""
    write = F.coalesce(F.nullif(F.regexp_extract("path", PART, 2), F.lit("")), F.col("path"))
    told = backup_files(spark, folder).where("length > 0").select("path", "length", "modificationTime", write.alias("write"), F.regexp_extract("path", PART, 1).try_cast("long").alias("part"))
    over = told.withColumn("written", F.max("modificationTime").over(Window.partitionBy("write")))
    rows = over.orderBy("written", "write", "part", "path").collect()
    return [(r.path, i, r.length, -(-r.length // block)) for i, r in enumerate(rows)]


def _last(known: list[tuple[str, int, int, int]], many: int) -> list[tuple[str, int, int, int]]:
    """Path, number, block and size of file of the last so many blocks."""
    out: list[tuple[str, int, int, int]] = []
    for path, number, size, blocks in reversed(known):
        out += [(path, number, b, size) for b in range(blocks - 1, max(-1, blocks - 1 - (many - len(out))), -1)]
        if len(out) >= many:
            break
    return out


def _bytes(path: str, start: int, size: int) -> bytes:
    local = path.startswith(("file:", "/"))
    system, name = (fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)) if local else fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        f.seek(start)
        return f.read(size)


def _lines(spark: SparkSession, blocks: list[tuple[str, int, int, int]], block: int) -> DataFrame:
    """The lines that start in these blocks: file, block, line (in the block), position (over all files) and text."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, number, at, size in batch.itertuples(index=False):
                start = at * block
                # one byte before tells whether the first line starts here; the last one may go on behind the block
                data = _bytes(path, max(0, start - 1), block + 1 if start else block)
                end = max(0, start - 1) + len(data)
                while end < size and not data.endswith(b"\n"):
                    more = _bytes(path, end, block)
                    cut = more.find(b"\n")
                    data, end = data + (more if cut < 0 else more[: cut + 1]), end + (len(more) if cut < 0 else cut + 1)
                begin = 0 if not start else data.find(b"\n") + 1 or len(data)
                rows, line = [], 0
                while begin < len(data) and max(0, start - 1) + begin < min(size, start + block):
                    cut = data.find(b"\n", begin)
                    cut = len(data) if cut < 0 else cut
                    rows.append((path, at, line, (number << PLACE) + max(0, start - 1) + begin, data[begin:cut].decode(errors="ignore")))
                    begin, line = cut + 1, line + 1
                yield pd.DataFrame(rows, columns=["file", "block", "line", "position", "text"])

    frame = spark.createDataFrame(blocks, "path string, number long, block long, size long")
    return frame.repartition(max(1, min(len(blocks), 1000)), "path", "block").mapInPandas(read, LINES)


def tail(spark: SparkSession, folder: str, n: int = 100, block: int = BLOCK) -> DataFrame:
    """The last n lines of all files of a folder, in order: file, block, line, position and text.

    Files follow each other by the time of their last change; those of one Spark write, which tasks finish in any order, have
    the last of their times and follow each other by their numbers. Blocks are read from the end on, twice as many each time, until
    they hold enough lines; all that lies before them is not read. 0 gives all lines, and a negative n leaves out that many
    from the start. A folder that is not there, or holds nothing, has one line that says so. Bytes that are no UTF-8 are left out.
    """
    known = _blocks(spark, folder, block) if exists(spark, folder) else []
    if not known:
        return spark.createDataFrame([(None, None, None, 0, NONE)] if not exists(spark, folder) else [], LINES)
    most = sum(b for *_, b in known)
    if n <= 0:
        every = _lines(spark, _last(known, most), block)
        return (every.join(every.orderBy("position").limit(-n).select("position"), "position", "left_anti").select(*every.columns) if n else every).orderBy("position")
    many = 1
    while True:
        found = _lines(spark, _last(known, many), block)
        if many >= most or found.count() >= n:
            return found.orderBy(F.desc("position")).limit(n).orderBy("position")
        many = min(most, many * 2)
