"""Collections in pages and as a stream, and pushes that are done once, against a server in this process."""

import io
import json
import threading
import time
import urllib.parse
from collections import Counter
from email.utils import formatdate
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators import push
from tidemark.sources import entities as E
from tidemark.sources import http, rest, rest_items


class Server(ThreadingHTTPServer):
    """Customers that change, with pages, a count and the moment of the last change; and a target that remembers what it got."""

    daemon_threads = True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.rows, self.asked, self.posted, self.keys, self.connections, self.clock, self.failing = {}, [], [], [], set(), 1_700_000_000, False
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server_port}/v1"

    def put(self, i, at, **more):
        self.rows[i] = {"id": i, "updated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(at)), **more}


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def setup(self):
        super().setup()
        self.server.connections.add(self.client_address)

    def date_time_string(self, timestamp=None):
        return formatdate(self.server.clock, usegmt=True)

    def answer(self, code, body, more=()):
        data = json.dumps(body).encode()
        self.send_response(code)
        for name, value in [("Content-Length", str(len(data))), *more]:
            self.send_header(name, value)
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(data)

    def do_GET(self):
        self.server.asked.append((self.command, self.path))
        asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
        rows = [r for _, r in sorted(self.server.rows.items()) if r["updated_at"] > asked.get("updated_after", "")]
        last = max((rest_items.moment(r["updated_at"]).timestamp() for r in rows), default=0)
        more = [("X-Total-Count", str(len(rows)))] + ([("Last-Modified", formatdate(last, usegmt=True))] if last else [])
        if "offset" in asked:
            rows = rows[int(asked["offset"]) :][: int(asked["limit"])]
        self.answer(200, {"page": {"n": [len(rows)]}, "data": rows}, more)

    do_HEAD = do_GET

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.posted.append(body["id"])
        self.server.keys.append(self.headers["Idempotency-Key"])
        if body.get("bad"):
            self.answer(422, {})
        else:
            self.answer(200, {"id": f"t{body['id']}"})

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    found = Server()
    yield found
    found.shutdown()


BODIES = ["[]", "{}", '{"data":[]}', ' [ 1 , 23,"a\\"]", {"x":[1,2,{"y":null}]}, 12 ] ', '{"meta":{"n":[1]},"data":[{"id":1},{"id":2}],"z":5}', '{"data":[{"é😀":"ü"}]}', "[" + ",".join(["7" * 300] * 50) + "]"]
BROKEN = ['{"a":1}', '{"data":null}', '{"data":{}}', "[1,2", '{"data":[1}', "x", "", "[1] 2", "[1,]", '{"data":[1],', "7", '{"data":[1]}}']


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 16])
def test_items(chunk):
    for body in BODIES:
        want = json.loads(body)
        assert [json.loads(x) for x in http.items(io.BytesIO(body.encode()).read, chunk)] == (want if isinstance(want, list) else want.get("data", []))
    for body in BROKEN:
        with pytest.raises(ValueError):
            list(http.items(io.BytesIO(body.encode()).read, chunk))


def test_items_are_not_held():
    """Of a response of 200 MB only a chunk is in memory at a time."""
    class Endless:
        sent, most = 0, 0

        def read(self, n):
            if self.sent > 200_000_000:
                return b""
            self.sent += 1_000_000
            return (b"[1" if self.sent == 1_000_000 else b"") + (b', {"id": 12345678}' * 55_556) + (b"]" if self.sent > 200_000_000 else b"")

    source = Endless()
    reader = http.Reader(source.read)
    assert sum(1 for _ in reader.listed()) > 11_000_000 and len(reader.text) < 3_000_000


def test_session_keeps_its_connection(server):
    server.put(1, server.clock)
    session = http.Session(server.base)
    for _ in range(5):
        assert session.text("GET", "/customers")
    assert session.opened == 1 and len(server.connections) == 1
    session._open.sock.close()  # closed behind its back, as servers do
    session._open.sock = None
    assert session.text("GET", "/customers")


def test_pages(spark, server):
    """Every item of many pages once, from several partitions, with the filter in each request."""
    for i in range(95):
        server.put(i, server.clock + i)
    rest.register(spark)
    load = lambda: spark.read.format("rest_items").options(base=server.base, entity="customer", page_size=10, pages_per_task=3).load()
    df = load()
    assert df.rdd.getNumPartitions() == 4 and sorted((r.pos, json.loads(r.item)["id"]) for r in df.collect()) == [(i, i) for i in range(95)]
    assert max(Counter(server.asked)[("GET", f"/v1/customers?offset={i}&limit=10")] for i in range(0, 95, 10)) == 1
    after = server.rows[79]["updated_at"]
    asked = len(server.asked)
    assert load().where(F.col("updated_after") > after).count() == 0  # the column tells what was asked for, which is not after itself
    assert len(server.asked) > asked and all("updated_after" in path for _, path in server.asked[asked:])
    given = spark.read.format("rest_items").options(base=server.base, entity="customer", page_size=10, updated_after=after).load()
    assert sorted(json.loads(r.item)["id"] for r in given.collect()) == list(range(80, 95))
    records = E.records(df.select("pos", F.parse_json("item").alias("item")), "customer")
    assert records.where("source_id = '94'").select("pos").first().pos == 94


def test_one_response_without_pages(spark, server):
    for i in range(30):
        server.put(i, server.clock)
    rest.register(spark)
    df = spark.read.format("rest_items").options(base=server.base, entity="customer").load()
    assert df.count() == 30 and max(len(r.item) for r in df.collect()) < 100


def started(spark, server, folder):
    rest.register(spark)
    rows = spark.readStream.format("rest_items").options(base=server.base, entity="customer", page_size=7, committed=(folder / "committed.json").as_uri()).load()
    return rows.writeStream.format("parquet").option("checkpointLocation", str(folder / "c")).option("path", str(folder / "out")).trigger(processingTime="0 seconds").start()


def test_stream(spark, server, tmp_path):
    """Changes come once each over restarts; the current second waits until it is over."""
    for i in range(20):
        server.put(i, server.clock - 100 + i)
    server.put(99, server.clock)  # of the second that still runs
    query = started(spark, server, tmp_path)
    query.processAllAvailable()
    seen = lambda: Counter((json.loads(r.item)["id"], json.loads(r.item).get("v")) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert seen() == Counter((i, None) for i in range(20))
    server.clock += 50
    query.processAllAvailable()
    assert seen() == Counter([*((i, None) for i in range(20)), (99, None)])
    query.stop()
    server.put(3, server.clock - 10, v=2)
    server.put(200, server.clock - 9)
    again = started(spark, server, tmp_path)
    again.processAllAvailable()
    assert seen() == Counter([*((i, None) for i in range(20)), (99, None), (3, 2), (200, None)])
    server.put(201, server.clock)
    server.clock += 2
    again.processAllAvailable()
    again.stop()
    assert seen()[201, None] == 1 and sum(seen().values()) == 24
    assert json.loads((tmp_path / "committed.json").read_text())["entity"] == "customer"
    assert not any("updated_after" not in path for method, path in server.asked[-4:] if method == "GET")  # increments only


RECORDS = [("customer", f"c{i}", i, "h", json.dumps({"id": i, "bad": i % 50 == 7})) for i in range(120)]


def test_pushed_once_though_a_task_fails(spark, server, tmp_path):
    """A run that breaks off, and again: each record is posted once, and the outcomes are one table with a row for each."""
    rows = spark.createDataFrame(RECORDS, push.RECORD)
    ledger = tmp_path.as_uri()
    broken = tmp_path / "broken"

    @F.udf("string")
    def breaking(payload):
        if json.loads(payload)["id"] == 95 and not broken.exists():
            broken.touch()
            raise RuntimeError("a worker dies")
        return payload

    some = rows.withColumn("payload", breaking("payload"))
    with pytest.raises(Exception, match="a worker dies"):
        push.push_once(some, "rest", server.base, ledger, "job", partitions=2, chunk=5).count()
    first = len(server.posted)
    assert 0 <= first < 120
    got = push.push_once(some, "rest", server.base, ledger, "job", partitions=2, chunk=5)
    outcomes = {r.source_id: r for r in got.collect()}
    assert sorted(server.posted) == list(range(120)) and len(set(server.keys)) == 120
    assert got.count() == 120 and outcomes["c3"].new_external_id == "t3" and not outcomes["c57"].ok and "422" in outcomes["c57"].error
    assert push.push_once(some, "rest", server.base, ledger, "job", partitions=2, chunk=5).count() == 120 and len(server.posted) == 120


def test_an_attempt_takes_up_where_another_died(server, tmp_path):
    """One task by hand: it dies in the middle of its rows, and the next attempt posts only the rest."""
    rows = [dict(zip(("entity_type", "source_id", "pos", "hash", "payload"), r)) for r in RECORDS]

    def dying():
        yield from rows[:33]
        raise OSError("lost")

    options = {"base": server.base, "kind": "rest", "job": "j", "ledger": tmp_path.as_uri(), "chunk": "10", "connections": "3"}
    with pytest.raises(OSError):
        push.PushWriter(options).write(dying())
    assert sorted(server.posted) == list(range(30))
    writer = push.PushWriter(options)
    staged = writer.write(iter(rows + rows[:3]))  # rows that come twice count once
    writer.commit([staged, None])
    writer.commit([writer.write(iter(rows))])
    assert sorted(server.posted) == list(range(120)) and [p.name for p in (tmp_path / "j" / "outcomes").iterdir()] == ["part-00000.parquet"]
    assert len(server.connections) <= 9


def test_a_lost_server_fails_the_stream(spark, tmp_path):
    rest.register(spark)
    rows = spark.readStream.format("rest_items").options(base="http://127.0.0.1:9", entity="customer").load()
    query = rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    with pytest.raises(StreamingQueryException):
        query.awaitTermination(60)
