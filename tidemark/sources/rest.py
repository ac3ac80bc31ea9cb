"""A Python data source for REST collections: spark.read.format("rest_entity") and df.write.format("rest_entity")."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, InputPartition, WriterCommitMessage

from .http import Session, headers

TIMEOUT_S, PING_TIMEOUT_S = 10, 5
# The collections' paths, the filters that the server takes, and the codes that mean it is there.
PATHS = {"customer": "customers", "equipment": "equipment", "rental_order": "rental-orders", "invoice": "invoices", "payment": "payments"}
PARAMETERS = {"customer": {"updated_after": GreaterThan}, "rental_order": {"status": EqualTo}}
SOURCE_ALIVE, TARGET_ALIVE = (200, 204), (200, 204, 404, 405)


def request(url: str, key: str | None = None, body: str | None = None, timeout: float = TIMEOUT_S) -> str:
    """A response's body; HTTP errors raise."""
    data = body.encode() if body is not None else None
    with urllib.request.urlopen(urllib.request.Request(url, data, headers(key)), timeout=timeout) as r:  # noqa: S310
        return r.read().decode()


def ping(base: str, alive: tuple[int, ...], key: str | None = None) -> bool:
    """Whether the system answers with one of these codes; any error means it does not."""
    try:
        with urllib.request.urlopen(urllib.request.Request(base, headers=headers(key)), timeout=PING_TIMEOUT_S) as r:  # noqa: S310
            return r.status in alive
    except urllib.error.HTTPError as e:
        return e.code in alive
    except OSError:
        return False


def source_alive(base: str, key: str | None = None) -> bool:
    return ping(f"{base.rstrip('/')}/health", SOURCE_ALIVE, key)


def target_alive(base: str, key: str | None = None) -> bool:
    return ping(base.rstrip("/"), TARGET_ALIVE, key)


@dataclass
class Collection(InputPartition):
    url: str


class EntityReader(DataSourceReader):
    """Reads one collection; the response's body is one row, and filters that the server knows become its parameters."""

    def __init__(self, options: dict[str, str]):
        self.entity, self.key = options["entity"], options.get("key")
        self.url = f"{options['base'].rstrip('/')}/{PATHS[self.entity]}"
        self.given = {p: options[p] for p in PARAMETERS.get(self.entity, {}) if options.get(p)}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, PARAMETERS.get(self.entity, {}).get(column, ())) and f.value:
                self.given[column] = str(f.value)
            yield f  # the server's answer is checked again

    def partitions(self) -> list[InputPartition]:
        query = f"?{urllib.parse.urlencode(self.given)}" if self.given else ""
        return [Collection(self.url + query)]

    def read(self, partition: Collection) -> Iterator[tuple]:
        yield (request(partition.url, self.key), self.given.get("updated_after"), self.given.get("status"))


@dataclass
class Pushed(WriterCommitMessage):
    rows: int


class EntityWriter(DataSourceWriter):
    """Posts the column `payload` of each row over one connection; one failure fails the task."""

    def __init__(self, options: dict[str, str]):
        from ..schemas import ENDPOINTS

        self.base, self.path, self.key = options["base"], ENDPOINTS[options["entity"]], options.get("key")

    def write(self, iterator) -> Pushed:
        rows, session = 0, Session(self.base, self.key, TIMEOUT_S)
        for row in iterator:
            session.text("POST", self.path, row["payload"])
            rows += 1
        session.close()
        return Pushed(rows)


class RestEntitySource(DataSource):
    """Options: base, entity, and maybe key, updated_after, status."""

    @classmethod
    def name(cls) -> str:
        return "rest_entity"

    def schema(self) -> str:
        return "body string, updated_after string, status string"

    def reader(self, schema) -> EntityReader:
        return EntityReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> EntityWriter:
        return EntityWriter(dict(self.options))


def external_id(entity: str, response: str, source_id: str) -> str:
    """The id that the target gave, else the record's own; only customers may have it under another name."""
    got = json.loads(response)
    names = ("id", "external_id") if entity == "customer" else ("id",)
    return str(next((got[n] for n in names if got.get(n)), source_id))


def register(spark) -> None:
    """Make the formats known to a session, with filters pushed down to the server."""
    from .rest_items import RestItemsSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RestEntitySource)
    spark.dataSource.register(RestItemsSource)
