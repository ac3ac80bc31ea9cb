"""REST collections item by item, in parallel pages, and as a stream: format("rest_items").

Options: base, entity, and maybe
  key             bearer token
  updated_after   only what changed after that moment; status: only orders of that status (also by filters on these columns)
  page_size       items of a page. The server then takes `offset` and `limit` (other names: offset_name, limit_name) and
                  tells the number of items in the header X-Total-Count (count_header) of a HEAD request; every pages_per_task
                  (16) pages are a partition. Without it the collection is one partition, which is streamed.
  updated_field   an item's field with the moment of its last change (updated_at); for streams
  committed       URI of a file that tells up to which moment a stream's batches are committed; for streams

Spark keeps the filters of a loaded DataFrame's first action for its later ones: load anew for each filter.
"""

from __future__ import annotations

import datetime as dt
import json
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, InputPartition

from .http import Session, items
from .rest import PARAMETERS, PATHS, TIMEOUT_S

START = "1970-01-01T00:00:00Z"


def moment(text: str) -> dt.datetime:
    """A moment in ISO form, UTC where it names no zone."""
    found = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return found if found.tzinfo else found.replace(tzinfo=dt.timezone.utc)


def spelled(at: dt.datetime) -> str:
    return at.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass
class Pages(InputPartition):
    """Some pages of a collection, or (first is None) all of it in one response; of these the items changed in [since, until)."""

    given: dict[str, str]
    first: int | None = None
    pages: int = 1
    since: str | None = None
    until: str | None = None


@dataclass
class Collection:
    """How to ask a server for the items of one entity."""

    base: str
    entity: str
    key: str | None = None
    page_size: int = 0
    pages_per_task: int = 16
    names: dict[str, str] = field(default_factory=dict)
    updated_field: str = "updated_at"

    @classmethod
    def of(cls, options: dict[str, str]) -> Collection:
        names = {n: options.get(f"{n}_name", n) for n in ("offset", "limit")} | {"count": options.get("count_header", "X-Total-Count")}
        return cls(options["base"], options["entity"], options.get("key"), int(options.get("page_size", 0)), int(options.get("pages_per_task", 16)), names, options.get("updated_field", "updated_at"))

    def path(self, given: dict[str, str]) -> str:
        return f"/{PATHS[self.entity]}" + (f"?{urllib.parse.urlencode(given)}" if given else "")

    def session(self) -> Session:
        return Session(self.base, self.key, TIMEOUT_S)

    def partitions(self, given: dict[str, str], since: str | None = None, until: str | None = None) -> list[Pages]:
        """Partitions of as many pages as the server's count asks for; one for all where it has no pages or does not tell."""
        if self.page_size > 0:
            session = self.session()
            response = session.send("HEAD", self.path(given))
            response.read()
            session.close()
            if (count := response.headers.get(self.names["count"])) is not None:
                pages = -(-int(count) // self.page_size)
                return [Pages(given, at, min(self.pages_per_task, pages - at), since, until) for at in range(0, pages, self.pages_per_task)]
        return [Pages(given, None, 1, since, until)]

    def read(self, part: Pages) -> Iterator[tuple[int, str]]:
        """Place in the collection and text of each item."""
        session = self.session()
        for page in range(part.pages):
            if part.first is None:
                given, at = part.given, 0
            else:
                at = (part.first + page) * self.page_size
                given = part.given | {self.names["offset"]: str(at), self.names["limit"]: str(self.page_size)}
            for pos, item in enumerate(items(session.send("GET", self.path(given)).read), at):
                if part.until is None or self.within(item, part.since, part.until):
                    yield pos, item
        session.close()

    def within(self, item: str, since: str, until: str) -> bool:
        """Whether an item changed in [since, until); one without a moment counts as of the very start."""
        found = json.loads(item)
        at = found.get(self.updated_field) if isinstance(found, dict) else None
        return moment(since) <= moment(str(at) if at else START) < moment(until)


class ItemsReader(DataSourceReader):
    """A collection now."""

    def __init__(self, options: dict[str, str]):
        self.collection = Collection.of(options)
        self.given = {p: options[p] for p in PARAMETERS.get(self.collection.entity, {}) if options.get(p)}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        known = PARAMETERS.get(self.collection.entity, {})
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, known.get(column, ())) and f.value:
                self.given[column] = str(f.value)
            yield f  # the server's answer is checked again

    def partitions(self) -> list[InputPartition]:
        return self.collection.partitions(self.given)

    def read(self, partition: Pages) -> Iterator[tuple]:
        for pos, item in self.collection.read(partition):
            yield pos, item, partition.given.get("updated_after"), partition.given.get("status")


class ItemsStreamReader(DataSourceStreamReader):
    """A collection's changes. An offset is a moment, in whole seconds; a batch has the items last changed in [start, end).

    The end is the second after the collection's last change (Last-Modified of a HEAD request, else the server's Date), or
    that second itself while it still runs, so that nothing of it can be missed. A batch that is read again gives what
    it gave, but for items that changed since, which a later batch then has. When a batch is committed its end is written to
    `committed`.
    """

    def __init__(self, options: dict[str, str]):
        self.collection = Collection.of(options)
        self.start, self.committed = options.get("updated_after") or START, options.get("committed")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"updated_after": spelled(moment(self.start))}

    def latestOffset(self) -> dict:  # noqa: N802
        session = self.collection.session()
        response = session.send("HEAD", self.collection.path({}))
        response.read()
        session.close()
        date = parsedate_to_datetime(response.headers["Date"]) if response.headers.get("Date") else dt.datetime.now(dt.timezone.utc)
        last = response.headers.get("Last-Modified")
        end = min(parsedate_to_datetime(last) + dt.timedelta(seconds=1), date) if last else date
        return {"updated_after": spelled(max(end, moment(self.start)))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        since, until = start["updated_after"], end["updated_after"]
        if moment(since) >= moment(until):
            return []
        given = {} if since == START else {"updated_after": spelled(moment(since) - dt.timedelta(seconds=1))}
        return self.collection.partitions(given, since, until)

    def read(self, partition: Pages) -> Iterator[tuple]:
        for pos, item in self.collection.read(partition):
            yield pos, item, partition.since, None

    def commit(self, end: dict) -> None:
        if self.committed:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(self.committed)
            with system.open_output_stream(path) as out:
                out.write(json.dumps({"entity": self.collection.entity, **end}).encode())


class RestItemsSource(DataSource):
    """Rows of pos (place in the collection), item (JSON), and the filters that were asked for."""

    @classmethod
    def name(cls) -> str:
        return "rest_items"

    def schema(self) -> str:
        return "pos long, item string, updated_after string, status string"

    def reader(self, schema) -> ItemsReader:
        return ItemsReader(dict(self.options))

    def streamReader(self, schema) -> ItemsStreamReader:  # noqa: N802
        return ItemsStreamReader(dict(self.options))
