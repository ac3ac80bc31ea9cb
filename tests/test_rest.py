"""The REST source and sink against a server in this process."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sinks
from tidemark.sources import entities as E
from tidemark.sources import rest


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code, body):
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            seen.append(self.path)
            self._send(200 if self.path != "/" else 404, {"data": [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            if body.get("bad"):
                self._send(500, {})
            else:
                self._send(200, {"external_id": f"t{body['id']}"} if body["id"] == 1 else {"id": 0})

        def log_message(self, *args):
            pass

    httpd = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", seen
    httpd.shutdown()


def test_scan(spark, server):
    base, seen = server
    rest.register(spark)
    raw = spark.read.format("rest_entity").option("base", base + "/").option("entity", "customer").option("updated_after", "2024").load()
    got = E.records(E.unwrapped(raw), "customer").orderBy("pos").collect()
    assert [r.source_id for r in got] == ["1", "2"] and len(got[0].hash) == 64
    assert "/customers?updated_after=2024" in seen


def test_filter_reaches_the_server(spark, server):
    base, seen = server
    rest.register(spark)
    raw = spark.read.format("rest_entity").option("base", base).option("entity", "rental_order").load()
    assert raw.where("status = 'draft'").count() == 1
    assert "/rental-orders?status=draft" in seen


def test_pings(server):
    base, _ = server
    assert rest.source_alive(base) and rest.target_alive(base)
    assert not rest.source_alive("http://127.0.0.1:9")


@pytest.mark.parametrize("kind", [None, "rest"])
def test_push(spark, server, kind):
    base, _ = server
    rows = spark.createDataFrame([("customer", '{"id":1}'), ("equipment", '{"id":1}'), ("odd", '{"id":2}'), ("payment", '{"id":3,"bad":true}')], "entity_type string, payload string")
    got = {(r.entity_type): r for r in sinks.push(rows, kind, base).collect()}
    assert got["customer"].external_id == "t1"
    assert got["equipment"].external_id == "1"
    assert got["odd"].external_id == "2"
    assert not got["payment"].success and "500" in got["payment"].error
    assert ("xml_meta" in got["customer"]) == (kind is None)


def test_write(spark, server):
    base, seen = server
    rest.register(spark)
    rows = spark.createDataFrame([('{"id":9}', None, None)], "payload string, a string, b string").select(F.col("payload"))
    rows.write.format("rest_entity").option("base", base).option("entity", "invoice").mode("append").save()
    assert ("/api/invoices", {"id": 9}) in seen


def test_connectors(server):
    base, _ = server
    one = sinks.connector("TALLY", base)
    assert isinstance(one, sinks.AccountingConnector) and one.connect() and one.delete("customer", "7")["external_id"] == "7"
    assert isinstance(sinks.connector("erp", base), sinks.RestConnector)
    assert one.update("customer", "x", {"id": 5})["external_id"] == "5"
