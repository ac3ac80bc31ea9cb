"""Pushing records so that none is pushed twice, whatever is retried: a sink with a ledger and a commit protocol."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .sinks import connector

#: Records that go to the target before their outcomes are written to the ledger.
CHUNK = 100
#: What the sink takes of each record, and what it adds to it.
RECORD = "entity_type string, source_id string, pos long, hash string, payload string"
OUTCOME = pa.schema([
    ("entity_type", pa.string()), ("source_id", pa.string()), ("pos", pa.int64()), ("hash", pa.string()), ("payload", pa.string()),
    ("ok", pa.bool_()), ("error", pa.string()), ("new_external_id", pa.string()),
])


@dataclass
class Staged(WriterCommitMessage):
    """The outcomes of one partition, in a file that does not count yet."""

    partition: int
    file: str


def once_key(job: str, row) -> str:
    """What tells a record of a job from all others, in every attempt."""
    return hashlib.sha256("\0".join([job, str(row["entity_type"]), str(row["source_id"]), str(row["pos"]), str(row["payload"])]).encode("utf-8", "surrogatepass")).hexdigest()


class PushWriter(DataSourceWriter):
    """Posts each record once.

    After every CHUNK records a task adds their outcomes to the ledger of its partition, as a file of its own. An attempt
    reads that ledger first, takes the outcomes of what an earlier one pushed from there, and pushes only the rest. Should a
    worker die in the middle of a chunk, the records of that chunk are sent again with the same Idempotency-Key. The
    outcomes of a partition are staged in one file; the commit puts the files of the attempts that succeeded in place, under
    names that depend on the partition alone, so doing it again changes nothing.

    The files are read and written by pyarrow, which needs a URI that it knows (file, hdfs, s3, gs).
    """

    def __init__(self, options: dict[str, str]):
        self.base, self.kind, self.key, self.job = options["base"], options.get("kind"), options.get("key"), options["job"]
        self.lanes, self.chunk = int(options.get("connections", 4)), int(options.get("chunk", CHUNK))
        self.folder = f"{options['ledger'].rstrip('/')}/{self.job}"

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(f"{self.folder}/{name}")

    def known(self, partition: int) -> dict[str, dict]:
        """The outcomes in the ledger of a partition, by key."""
        system, path = self._at(f"tried/{partition}")
        out: dict[str, dict] = {}
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.endswith(".jsonl"):
                with system.open_input_stream(info.path) as f:
                    for line in f.read().decode().splitlines():
                        entry = json.loads(line)
                        out[entry.pop("key")] = entry
        return out

    def _note(self, partition: int, entries: list[dict]) -> None:
        if entries:
            system, path = self._at(f"tried/{partition}")
            system.create_dir(path)
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{path}/{name}.part") as f:
                f.write("".join(json.dumps(e) + "\n" for e in entries).encode())
            system.move(f"{path}/{name}.part", f"{path}/{name}.jsonl")

    def write(self, iterator) -> Staged:
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        known, targets = self.known(partition), [connector(self.kind, self.base, self.key) for _ in range(self.lanes)]
        system, path = self._at("staged")
        system.create_dir(path)
        file = f"{path}/{partition}-{uuid.uuid4().hex}.parquet"

        def lane(number: int, rows: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
            """Pushes rows one after another over one connection."""
            out = []
            for key, row in rows:
                answer = targets[number].sync(row["entity_type"], json.loads(row["payload"]), key)
                out.append((key, {"ok": answer["success"], "error": answer["error"], "new_external_id": answer["external_id"]}))
            return out

        with ThreadPoolExecutor(self.lanes) as pool, system.open_output_stream(file) as sink, pq.ParquetWriter(sink, OUTCOME) as table:
            for rows in self._chunks(iterator):
                fresh = [(k, r) for k, r in rows if k not in known]
                # records of one key go in their order, over one connection
                lanes: list[list] = [[] for _ in targets]
                for key, row in fresh:
                    lanes[hash((row["entity_type"], row["source_id"])) % self.lanes].append((key, row))
                done = dict(x for some in pool.map(lane, range(self.lanes), lanes) for x in some)
                self._note(partition, [{"key": k, **v} for k, v in done.items()])
                table.write_table(pa.Table.from_pylist([row | (done.get(k) or known[k]) for k, row in rows], OUTCOME))
        for target in targets:
            target.disconnect()
        return Staged(partition, file)

    def _chunks(self, iterator) -> Iterator[list[tuple[str, dict]]]:
        held: dict[str, dict] = {}
        for row in iterator:
            one = {name: row[name] for name in ("entity_type", "source_id", "pos", "hash", "payload")}
            if (key := once_key(self.job, one)) in held:
                continue  # a repeated row
            held[key] = one
            if len(held) == self.chunk:
                yield list(held.items())
                held = {}
        if held:
            yield list(held.items())

    def commit(self, messages: list[Staged | None]) -> None:
        system, path = self._at("outcomes")
        system.create_dir(path)
        for message in messages:
            if message is not None:
                system.move(message.file, f"{path}/part-{message.partition:05d}.parquet")

    def abort(self, messages: list[Staged | None]) -> None:
        """The staged files go; the ledger stays, so that nothing is pushed again."""
        system, _ = self._at("staged")
        for message in messages:
            if message is not None:
                system.delete_file(message.file)


class RestPushSink(DataSource):
    """Options: base, job, ledger (URI of a folder), and maybe kind, key, connections, chunk."""

    @classmethod
    def name(cls) -> str:
        return "rest_push"

    def schema(self) -> str:
        return RECORD

    def writer(self, schema, overwrite: bool) -> PushWriter:
        return PushWriter(dict(self.options))


def push_once(records: DataFrame, kind: str | None, base: str, ledger: str, job: str, key: str | None = None, partitions: int = 32, connections: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Outcomes (entity_type, source_id, pos, hash, payload, ok, error, new_external_id) of records, each pushed once for each job.

    A job that broke off is done again under its name: what its ledger has is not pushed again. Which partition a record
    belongs to depends on its key and the number of partitions only, so every attempt finds it in the same ledger. The target
    sees partitions that run at a time x connections requests at once. A job whose outcomes are all there pushes nothing.
    """
    spark = records.sparkSession
    spark.dataSource.register(RestPushSink)
    name = f"{job}-{partitions}"
    placed = records.select("entity_type", "source_id", F.col("pos").cast("long").alias("pos"), "hash", "payload")
    placed = placed.repartition(partitions, "entity_type", "source_id").sortWithinPartitions("entity_type", "source_id", "pos")
    placed.write.format("rest_push").options(base=base, job=name, ledger=ledger, connections=connections, chunk=chunk, **{k: v for k, v in (("kind", kind), ("key", key)) if v}).mode("append").save()
    return spark.read.schema("entity_type string, source_id string, pos long, hash string, payload string, ok boolean, error string, new_external_id string").parquet(f"{ledger.rstrip('/')}/{name}/outcomes")
