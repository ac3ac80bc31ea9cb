"""State tables as versioned Parquet folders with a pointer to the current version."""

from __future__ import annotations

import contextlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import struct

#: Folders that a table may consist of; an append beyond that writes the table anew.
MOST = 200
#: Deltas that a keyed table may have; a merge beyond that folds them into its base.
DELTAS = 16


class Conflict(RuntimeError):
    """Another change came first."""


@dataclass(frozen=True)
class Keyed:
    """A table with one row for each key, in buckets by a hash of the key."""

    keys: tuple[str, ...]
    buckets: int = 64


class State:
    """Some tables under one folder of any file system that Spark reads, which all change together.

    A version is a small file that names the folders of every table. A change writes its rows to new folders
    and then the next version, which is put into place under its number if no other is there yet: readers see all of it
    or nothing, a change that breaks off leaves the version before, and of two changes of one version only one succeeds.
    Appending writes the new rows alone. Object stores without an exclusive rename can have one writer only.

    A keyed table is a base and deltas, all in the same buckets. Merging writes a delta with the merged rows alone, and
    reading lays the deltas over the base, bucket by bucket, for which the base is neither shuffled nor sorted.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], keyed: dict[str, Keyed] | None = None):
        self.spark, self.path, self.schemas, self.keyed = spark, path.rstrip("/"), {name: struct(s) for name, s in schemas.items()}, keyed or {}
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._p("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(""))]
        return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))

    def current(self) -> int:
        """Number of the version that holds; 0 before the first."""
        return max(self.versions(), default=0)

    def _known(self, version: int) -> dict:
        if not version:
            return {"folders": {}, "notes": {}}
        file = self._fs.open(self._p(f"current-{version}"))
        try:
            return json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def notes(self, version: int | None = None) -> dict:
        """What the changes up to a version (the current one) noted besides their rows."""
        return self._known(self.current() if version is None else version)["notes"]

    def folders(self, name: str, version: int | None = None) -> list[str]:
        """The folders that a table consists of, in the order in which they came."""
        return self._known(self.current() if version is None else version)["folders"].get(name, [])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        folders = self.folders(name, version)
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        if name in self.keyed:
            return self._overlaid(name, folders)
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.path}/{f}" for f in folders])

    def _bucketed(self, name: str, folder: str) -> DataFrame:
        """One folder of a keyed table, as a table that knows its buckets; the catalog entry is gone once it is resolved."""
        keys, table = ", ".join(f"`{k}`" for k in self.keyed[name].keys), f"tidemark_{uuid.uuid4().hex}"
        buckets = int(folder.rpartition("-")[2])
        self.spark.sql(
            f"CREATE TABLE {table} ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in self.schemas[name])}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        try:
            return self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE {table}")

    def _layers(self, name: str, folders: list[str]) -> tuple[DataFrame, DataFrame | None]:
        """The base, and of all deltas the newest row of each key: key and _row."""
        base, newest = self._bucketed(name, folders[0]), None
        keys, rest = self.keyed[name].keys, [f.name for f in self.schemas[name] if f.name not in self.keyed[name].keys]
        for age, folder in enumerate(folders[1:]):
            one = self._bucketed(name, folder).select(*keys, F.lit(age).alias("_age"), F.struct(*rest).alias("_row"))
            newest = one if newest is None else newest.unionByName(one)
        return base, newest if newest is None else newest.groupBy(*keys).agg(F.max_by("_row", "_age").alias("_row"))

    def _put_over(self, name: str) -> list:
        """The columns of a keyed table but its keys, where rows of the base stand beside those of deltas."""
        rest = [f.name for f in self.schemas[name] if f.name not in self.keyed[name].keys]
        return [F.when(F.col("_row").isNotNull(), F.col(f"_row.{c}")).otherwise(F.col(c)).alias(c) for c in rest]

    def _overlaid(self, name: str, folders: list[str]) -> DataFrame:
        base, newest = self._layers(name, folders)
        if newest is None:
            return base
        keys = self.keyed[name].keys
        return base.join(newest, list(keys), "full").select(*keys, *self._put_over(name)).select(*[f.name for f in self.schemas[name]])

    def looked_up(self, name: str, rows: DataFrame, version: int | None = None) -> DataFrame:
        """rows with the columns of a keyed table's row of their key, or nulls.

        The rows are shuffled into the table's buckets and joined with base and deltas there; the table is not shuffled.
        """
        keys, folders = self.keyed[name].keys, self.folders(name, version)
        if not folders:
            return rows.join(self.read(name, version), list(keys), "left")
        base, newest = self._layers(name, folders)
        found = rows.repartition(int(folders[0].rpartition("-")[2]), *keys).join(base, list(keys), "left")
        return found if newest is None else found.join(newest, list(keys), "left").select(*rows.columns, *self._put_over(name))

    def _write(self, name: str, rows: DataFrame) -> str:
        """Write rows to a new folder of a table, and return its name."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name]])
        if name not in self.keyed:
            folder = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            return folder
        keys, buckets = self.keyed[name].keys, self.keyed[name].buckets
        folder, table = f"{name}-{uuid.uuid4().hex}-{buckets}", f"tidemark_{uuid.uuid4().hex}"
        rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.path}/{folder}").format("parquet").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")
        return folder

    def change(
        self, written: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, notes: dict | None = None, keep: int = 3,
        merged: dict[str, DataFrame] | None = None, version: int | None = None, forget: bool = False,
    ) -> int:
        """The next version: some tables written anew, rows added to others, rows put over those of their keys in keyed ones.

        version is the one that the rows were made from; if it does not hold any more, Conflict is raised. Returns the
        next version's number; all but the last few versions go. forget drops all notes but the given ones.
        """
        version = self.current() if version is None else version
        known, made = self._known(version), []
        folders = dict(known["folders"])

        def write(name: str, rows: DataFrame) -> str:
            made.append(self._write(name, rows))
            return made[-1]

        try:
            for name, rows in (written or {}).items():
                folders[name] = [write(name, rows)]
            for name, rows in (appended or {}).items():
                before = folders.get(name, [])
                if len(before) >= MOST:
                    rows, before = self.read(name, version).unionByName(rows), []
                folders[name] = [*before, write(name, rows)]
            for name, rows in (merged or {}).items():
                folders[name] = [*folders.get(name, []), write(name, rows)]
                if len(folders[name]) > DELTAS + 1:
                    folders[name] = [write(name, self._overlaid(name, folders[name]))]
            version += 1
            self._publish(version, {"folders": folders, "notes": {**({} if forget else known["notes"]), **(notes or {})}})
        finally:  # of a change that broke off, or came second, nothing stays; nor does a delta that was folded at once
            for folder in set(made) - self._used(self.versions()):
                self._fs.delete(self._p(folder), True)
        self._drop(self.versions()[:-keep])
        return version

    def _used(self, versions: list[int]) -> set[str]:
        """The folders that some versions name; a version may be gone by now."""
        out: set[str] = set()
        for version in versions:
            try:
                out.update(f for some in self._known(version)["folders"].values() for f in some)
            except Exception:  # noqa: BLE001  whatever the file system says of a file that is not there
                if self._fs.exists(self._p(f"current-{version}")):
                    raise
        return out

    def _publish(self, version: int, known: dict) -> None:
        draft, place = self._p(f"next-{uuid.uuid4().hex}"), self._p(f"current-{version}")
        file = self._fs.create(draft, False)
        file.write(bytearray(json.dumps(known).encode()))
        file.close()
        try:
            if self._fs.exists(place) or self.current() >= version:
                raise Conflict(f"another change has made version {version} of {self.path}")
            if self._fs.getScheme() == "file":  # a rename would replace what is there; a link does not
                local = lambda p: self._jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
                try:
                    self._jvm.java.nio.file.Files.createLink(local(place), local(draft))
                except Exception as e:
                    raise Conflict(f"another change has made version {version} of {self.path}") from e
            elif not self._fs.rename(draft, place):
                raise Conflict(f"another change has made version {version} of {self.path}")
        finally:
            self._fs.delete(draft, False)

    @contextlib.contextmanager
    def pinned(self):
        """The current version, which stays, with all its folders, while this lasts."""
        pin = self._p(f"pin-{uuid.uuid4().hex}")
        while True:
            version = self.current()
            file = self._fs.create(pin, True)
            file.write(bytearray(str(version).encode()))
            file.close()
            if version == 0 or version in self.versions():  # it was not dropped in between
                break
        try:
            yield version
        finally:
            self._fs.delete(pin, False)

    def _pins(self) -> set[int]:
        out = set()
        for status in self._fs.listStatus(self._p("")):
            if status.getPath().getName().startswith("pin-"):
                file = self._fs.open(status.getPath())
                out |= {int(x) for x in [bytes(file.readAllBytes()).decode()] if x}
                file.close()
        return out

    def _drop(self, versions: list[int]) -> None:
        """Delete versions that are not pinned, and the folders that no other version names."""
        pins = self._pins()
        versions = [v for v in versions if v not in pins]
        gone = {v: self._used([v]) for v in versions}
        used = self._used([v for v in self.versions() if v not in gone])
        for version, folders in gone.items():
            self._fs.delete(self._p(f"current-{version}"), False)
            for folder in folders - used:
                self._fs.delete(self._p(folder), True)

    def table(self, name: str) -> Table:
        return Table(self, name)


class Table:
    """One table of a state, which may be changed by itself."""

    def __init__(self, state: State, name: str):
        self.state, self.name = state, name
        self.versions, self.current = state.versions, state.current

    def read(self, version: int | None = None) -> DataFrame:
        return self.state.read(self.name, version)

    def write(self, rows: DataFrame, keep: int = 3) -> int:
        """Make rows the table's next version and return its number."""
        return self.state.change(written={self.name: rows}, keep=keep)

    def append(self, rows: DataFrame) -> int:
        """Add rows to the table; what it holds is not written again."""
        return self.state.change(appended={self.name: rows})

    def backup(self, folder: str, now) -> str:
        """Copy the current version to a folder named by the time (UTC)."""
        name = self.state.spark.range(1).select(S.file_stamp(F.lit(now)).alias("s")).first().s
        path = f"{folder.rstrip('/')}/state_backup_{name}"
        self.read().write.mode("overwrite").parquet(path)
        return path


class StateTable(Table):
    """A table that has a folder, and so versions, of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        super().__init__(State(spark, path, {"rows": schema}), "rows")
