"""Settings, logs and backups on disk."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import backup, config
from tidemark.plans.state import Keyed, State
from tidemark.sources import files, tail


def test_settings(spark, tmp_path):
    path = str(tmp_path / "config")
    assert config.load(spark, path) is None and config.current(spark, path) == config.Config()
    with pytest.raises(ValueError):
        config.require(spark, path)
    config.save(spark, path, config.Config(source_url="http://x", sync_interval_minutes=0))
    assert config.require(spark, path).source_url == "http://x" and config.current(spark, path).interval() == 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "f.txt").write_text("{nope")
    assert config.load(spark, str(tmp_path / "bad")) is None


def test_logs(spark, tmp_path):
    path = str(tmp_path / "logs")
    assert files.log_path(spark, path) is None
    lines = spark.createDataFrame([('{"level":"INFO","message":"é","duration_ms":1.5}',), ('{"level":"ERROR","message":"m"}',)], "line string")
    files.append_logs(lines, path)
    files.append_logs(lines.limit(1), path)
    assert files.log_path(spark, path) == path
    assert files.read_logs(spark, path).groupBy("level").count().count() == 2
    assert files.read_logs(spark, path).where("duration_ms = 1.5").count() == 2


def test_backups(spark, tmp_path):
    assert files.file_listing(spark, str(tmp_path / "none")).count() == 0
    for name, days in (("old.db", 40), ("edge.db", 29), ("new.db", 0)):
        (tmp_path / name).write_text(name)
        at = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc).timestamp() - days * 86400
        os.utime(tmp_path / name, (at, at))
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    assert [r.filename for r in files.file_listing(spark, str(tmp_path)).collect()] == ["new.db", "edge.db", "old.db"]
    assert files.purge_backups(spark, str(tmp_path), now) == 1
    assert sorted(os.listdir(tmp_path)) == ["edge.db", "new.db"] or not (tmp_path / "old.db").exists()


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_tail(spark, tmp_path, block):
    """Rotated files, with and without a last line break, empty lines, empty files, umlauts cut by blocks, and lines longer than a block."""
    logs = tmp_path / "logs"
    assert [r.text for r in tail.tail(spark, str(logs), 5).collect()] == [tail.NONE]
    logs.mkdir()
    assert tail.tail(spark, str(logs), 5).count() == 0
    texts = ["a\nbä\n\nc" + "x" * 100, "", "\n", "é" * 40 + "\nd\ne\n"]
    for i, text in enumerate(texts):
        (logs / f"log.{9 - i}").write_bytes(text.encode())
        os.utime(logs / f"log.{9 - i}", (1_700_000_000 + i, 1_700_000_000 + i))
    every = [line for text in texts for line in (text[:-1] if text.endswith("\n") else text).split("\n") if text]
    for n in (1, 2, 3, 5, 100) if block > 1 else (2,):
        got = tail.tail(spark, str(logs), n, block).collect()
        assert [r.text for r in got] == every[-n:]
    last = tail.tail(spark, str(logs), 1, block).first()
    assert last.file.endswith("log.6") and (last.block, last.line) == ((len(texts[3].encode()) - 2) // block, last.line)
    if block == 7:
        assert [r.text for r in tail.tail(spark, str(logs), 0, block).collect()] == every
        assert [r.text for r in tail.tail(spark, str(logs), -3, block).collect()] == every[3:]


def test_tail_reads_only_the_end(spark, tmp_path):
    with open(tmp_path / "big.log", "w") as f:
        for i in range(200_000):
            f.write(f"line {i}\n")
    known = tail._blocks(spark, str(tmp_path), 1 << 12)
    assert len(tail._last(known, 4)) == 4 and known[0][3] > 500
    asked = []
    inner = tail._lines
    tail._lines = lambda s, blocks, block: asked.append(len(blocks)) or inner(s, blocks, block)
    try:
        assert [r.text for r in tail.tail(spark, str(tmp_path), 1000, 1 << 12).collect()] == [f"line {i}" for i in range(199_000, 200_000)]
    finally:
        tail._lines = inner
    assert max(asked) <= 4


def test_tail_of_a_write_in_parts(spark, tmp_path):
    """Parts of one write are in the order of their numbers, whichever was done last, and between the writes before and after it."""
    logs = str(tmp_path / "logs")
    lines = lambda first, n: spark.range(first, first + n).select(F.format_string("line %05d", "id").alias("line"), "id")
    for first, n, parts in ((0, 1, 1), (1, 3000, 12), (3001, 1, 1)):
        before = set(os.listdir(logs)) if first else set()
        files.append_logs(lines(first, n).repartitionByRange(parts, "id").sortWithinPartitions("id"), logs)
        new = sorted(f for f in set(os.listdir(logs)) - before if f.startswith("part-"))
        assert len(new) == parts
        for i, f in enumerate(new):
            os.utime(f"{logs}/{f}", (1_700_000_000 + 2 * first - i, 1_700_000_000 + 2 * first - i))
    for n in (1, 2, 500, 3002, 0):
        assert [r.text for r in tail.tail(spark, logs, n).collect()] == [f"line {i:05d}" for i in range(3002)][-n:]


def test_log_in_order_in_bounded_files(spark, tmp_path, small, monkeypatch):
    """No file, and so no task, has all lines of a larger log; the query still finds the last ones."""
    from compare import duck_rows, spark_rows

    from tidemark import catalog, oracle

    asked, inner = [], tail.tail
    monkeypatch.setattr(files, "LINES", 50)
    monkeypatch.setattr(tail, "tail", lambda s, folder, n: asked.append(folder) or inner(s, folder, n))
    got = catalog.log_files_tail(spark, small)
    sizes = [r["count"] for r in spark.read.text(asked[0]).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == spark.read.parquet(f"{small}/events.parquet").count() and max(sizes) <= 4 * 50
    assert spark_rows(got) == duck_rows(small, oracle.SQL["log_files_tail"])[1]
    every = [r.text for r in inner(spark, asked[0], 0).collect()]
    assert every == [r.line for r in catalog.log_format(spark, small).orderBy("event_id").collect()]


def test_backup_and_restore(spark, tmp_path):
    """Backup, changes, restore: equal tables and notes; a change during the copy takes nothing away."""
    state = State(spark, str(tmp_path / "s"), {"t": "k STRING, n BIGINT", "u": "a BIGINT", "v": "a BIGINT"}, {"t": Keyed(("k",), 2)})
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n long")
    now = lambda day: F.lit(f"2024-03-{day:02d} 01:02:03").cast("timestamp_ntz")
    state.change(merged={"t": rows(("a", 1), ("b", 2))}, appended={"u": spark.range(3).withColumnRenamed("id", "a")}, notes={"x": 1})
    with state.pinned() as version:
        for i in range(5):
            state.change(merged={"t": rows(("a", 10 + i))}, notes={"y": i})
        assert sorted(map(tuple, state.read("t", version).collect())) == [("a", 1), ("b", 2)] and version in state.versions()
    state.change(merged={"t": rows(("c", 3))})
    assert version not in state.versions()
    want, settings = sorted(map(tuple, state.read("t").collect())), config.Config(source_url="http://x")
    path = backup.take(state, str(tmp_path / "b"), now(1), settings)
    assert path.endswith("state_backup_20240301_010203")
    for i in range(3):
        state.change(written={"t": rows(("z", i))}, appended={"u": spark.range(1).withColumnRenamed("id", "a"), "v": spark.range(1).withColumnRenamed("id", "a")}, notes={"y": 100, "z": 1})
    _, back = backup.restore(state, path)
    assert sorted(map(tuple, state.read("t").collect())) == want and state.read("u").count() == 3 and state.read("v").count() == 0
    assert back == settings and state.notes() == {"x": 1, "y": 4}
    assert [r.filename for r in backup.listed(spark, str(tmp_path / "b")).collect()] == ["state_backup_20240301_010203"]
    (tmp_path / "b" / "state_backup_20240215_000000" / "tables").mkdir(parents=True)  # one that was never finished
    backup.take(state, str(tmp_path / "b"), now(31))
    assert len(backup.listed(spark, str(tmp_path / "b")).collect()) == 2  # 29 days and some
    assert backup.purge(spark, str(tmp_path / "b"), F.lit("2024-03-31 01:02:04").cast("timestamp_ntz")) == 1
    with pytest.raises(ValueError):
        backup.restore(state, str(tmp_path / "b" / "state_backup_20240215_000000"))
