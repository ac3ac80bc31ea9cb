"""The set-based sync against a loop that takes one record after another."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cdc, lookups
from tidemark.plans.state import StateTable
from tidemark.plans.sync import Store, execute, sync
from tidemark.schemas import MAPPING


def now():
    return F.lit("2024-01-20").cast("timestamp_ntz")
FETCHED = "entity_type string, source_id string, pos long, hash string, ok boolean, error string, payload string, new_external_id string"


def one_by_one(records, stored):
    """What each record does, given what those before it wrote."""
    state = {k: dict(v) for k, v in stored.items()}
    outcomes = []
    for r in records:
        known = state.get(r["source_id"])
        if known and known["last_hash"] and known["last_hash"] == r["hash"] and known["status"] == "synced":
            outcomes.append("skipped")
            continue
        before = known["external_id"] if known else None
        if not r["ok"]:
            outcomes.append("failed")
            continue
        outcomes.append("updated" if before else "created")
        state[r["source_id"]] = {
            "external_id": r["new_external_id"] or before or r["source_id"], "last_hash": r["hash"], "status": "synced",
            "sync_version": known["sync_version"] + 1 if known else 1,
        }
    return outcomes, state


def fixture(seed):
    rng = random.Random(seed)
    stored = {
        str(i): {"external_id": rng.choice(["", None, f"e{i}"]), "last_hash": rng.choice([None, "a", "b"]), "status": rng.choice(["synced", "stale"]), "sync_version": rng.randint(1, 4)}
        for i in range(12) if rng.random() < 0.7
    }
    records = [
        {"entity_type": "customer", "source_id": str(rng.randrange(16)), "pos": i, "hash": rng.choice("abc"), "ok": rng.random() < 0.6, "error": "no", "payload": "{}", "new_external_id": rng.choice([None, "", f"n{i}"])}
        for i in range(200)
    ]
    return records, stored


@pytest.mark.parametrize("seed", range(6))
def test_like_a_loop(spark, seed):
    records, stored = fixture(seed)
    fetched = spark.createDataFrame([tuple(r.values()) for r in records], FETCHED)
    mapping = spark.createDataFrame(
        [("customer", k, v["external_id"], None, v["sync_version"], v["last_hash"], None, None, None, v["status"]) for k, v in stored.items()], MAPPING
    )
    want, state = one_by_one(records, stored)
    outcomes = cdc.classify(fetched, mapping, ["pos"])
    assert [r.outcome for r in outcomes.orderBy("pos").collect()] == want
    spread = cdc.classify_spread(fetched, mapping, "pos", rows=17)
    assert [r.outcome for r in spread.orderBy("pos").collect()] == want
    merged = {r.source_id: r for r in cdc.merge_mapping(mapping, outcomes, "pos", now()).collect()}
    assert set(merged) == set(state)
    for k, v in state.items():
        if v != stored.get(k):
            assert (merged[k].last_hash, merged[k].sync_version, merged[k].status) == (v["last_hash"], v["sync_version"], "synced")


def test_invariants(spark, tmp_path):
    records, _ = fixture(1)
    fetched = spark.createDataFrame([tuple(r.values()) for r in records], FETCHED)
    store = Store.at(spark, str(tmp_path))
    first = sync(fetched, store, now()).first()
    assert first.processed == 200 == first.created + first.updated + first.failed + first.skipped
    mapping = store.mapping.read()
    assert mapping.count() == mapping.select("entity_type", "source_id").distinct().count()
    assert store.history.read().count() == 200 - first.skipped
    assert store.dead_letters.read().count() == first.failed
    ids = [r.id for r in store.history.read().orderBy("id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    same = fetched.where("ok").dropDuplicates(["source_id"])
    sync(same, store, now())
    again = sync(same, store, now()).first()
    assert again.skipped == again.processed


def test_unknown_name_syncs_all(spark, tmp_path):
    empty = spark.createDataFrame([], FETCHED)
    asked = []

    def fetch(entity):
        asked.append(entity)
        return empty

    execute("whatever", fetch, Store.at(spark, str(tmp_path)), now())
    assert asked == ["customer", "equipment", "rental_order", "invoice", "payment"]


def test_state_versions(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "a BIGINT")
    assert table.current() == 0 and table.read().count() == 0
    for i in range(5):
        table.write(spark.range(i + 1).withColumnRenamed("id", "a"))
    assert table.current() == 5 and table.read().count() == 5 and table.versions() == [3, 4, 5]
    table.append(spark.range(2).withColumnRenamed("id", "a"))
    assert table.read().count() == 7
    assert spark.read.parquet(table.backup(str(tmp_path), __import__("datetime").datetime(2024, 1, 2, 3, 4, 5))).count() == 7


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    """A sync that fails between its writes, done again, leaves what one that did not fail would."""
    records, _ = fixture(2)
    fetched = spark.createDataFrame([tuple(r.values()) for r in records], FETCHED)
    store, plain = Store.at(spark, str(tmp_path / "a")), Store.at(spark, str(tmp_path / "b"))
    want = sync(fetched, plain, now()).collect()
    for broken in ("dead_letters", "history"):
        with monkeypatch.context() as m:
            def fail(*args, broken=broken):
                raise RuntimeError(broken)

            m.setattr(cdc, broken, fail)
            with pytest.raises(RuntimeError):
                sync(fetched, store, now())
    with monkeypatch.context() as m:  # the rows are written, the version is not
        def refuse(version, known):
            raise RuntimeError("no version")

        m.setattr(store.state, "_publish", refuse)
        with pytest.raises(RuntimeError):
            sync(fetched, store, now())
    assert store.state.current() == 0 and store.history.read().count() == 0
    assert sync(fetched, store, now()).collect() == want
    for name in ("mapping", "history", "dead_letters"):
        assert sorted(store.state.read(name).collect(), key=str) == sorted(plain.state.read(name).collect(), key=str)


def test_append_writes_only_new_rows(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "a BIGINT")
    for i in range(4):
        table.append(spark.createDataFrame([(i,)], "a long"))
    assert sorted(r.a for r in table.read().collect()) == [0, 1, 2, 3] and sorted(r.a for r in table.read(2).collect()) == [0, 1]
    assert sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "t").glob("rows-*")) == 4


def test_dead_letter_limits(spark):
    rows = spark.createDataFrame([("customer", "1", "failed", "e" * 3000, "p" * 9000, 1), ("customer", None, "failed", "e", None, 2)], "entity_type string, source_id string, outcome string, error string, payload string, pos long")
    one, two = cdc.dead_letters(rows, now(), ["pos"]).orderBy("id").collect()
    assert (len(one.error), len(one.payload), two.payload, two.source_id) == (1000, 5000, "", "")


def test_update_refuses_other_columns(spark):
    mapping = spark.createDataFrame([], MAPPING)
    with pytest.raises(ValueError):
        lookups.update(mapping, F.lit(True), now(), source_id="x")
    assert lookups.update(mapping, F.lit(True), now()) is mapping
