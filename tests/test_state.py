"""Keyed tables: what is written, what is shuffled, what is read."""

import random

import pytest
from pyspark.sql import functions as F
from test_cdc import now

from tidemark.operators import cdc
from tidemark.plans import state as S
from tidemark.plans.sync import Store, sync


def bytes_of(store, folder):
    return sum(p.stat().st_size for p in (store / folder).glob("*.parquet"))


def above(plan, text):
    """The operators over that line of a plan which holds a text."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if text in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    out, here = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < here:
            here = depth(line)
            out.append(line.strip(" :+-"))
    return out


def fetch(spark, low, high, tag):
    return spark.range(low, high).select(
        F.lit("customer").alias("entity_type"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("source_id"), F.col("id").alias("pos"), F.sha2(F.concat(F.lit(tag), F.col("id").cast("string")), 256).alias("hash"),
        F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit("{}").alias("payload"), F.lit(None).cast("string").alias("new_external_id"),
    )


def test_a_sync_writes_what_it_touches(spark, tmp_path):
    """Of 40,000 keys one in a hundred changes: the mapping grows by about as much, and its base is neither read anew into a shuffle nor written."""
    store = Store.at(spark, str(tmp_path), buckets=4)
    sync(fetch(spark, 0, 40_000, "a"), store, now())
    base = store.state.folders("mapping")
    sync(fetch(spark, 0, 40_000, "a").where("pos % 100 = 0").withColumn("hash", F.sha2("hash", 256)), store, now())
    folders = store.state.folders("mapping")
    assert folders[:1] == base and len(folders) == 2
    assert bytes_of(tmp_path, folders[1]) < 0.05 * bytes_of(tmp_path, folders[0])
    rows = store.mapping.read()
    assert rows.count() == 40_000 and rows.where("sync_version = 2").count() == 400 == rows.where("sync_version = 2 and pmod(cast(substring(source_id, 2) as int), 100) = 0").count()
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.maxMetadataStringLength")}
    try:
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        some, stored = cdc.unfolded(fetch(spark, 0, 10, "z")), lambda rows: store.state.looked_up("mapping", rows)
        outcomes = some.withColumn("outcome", F.lit("updated"))
        for plan in (store.mapping.read(), cdc.classify_spread(some, stored), cdc.written_mapping(stored, outcomes, "pos", now())):
            over = above(plan._jdf.queryExecution().executedPlan().toString(), base[0][:24])
            joins = [i for i, line in enumerate(over) if "SortMergeJoin" in line]
            # above the first join there are only rows that are asked for
            assert joins and not any(line.split(") ")[-1].startswith("Exchange") for line in over[: joins[0]]), over
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_like_a_dictionary(spark, tmp_path, monkeypatch):
    """Merges, folding of deltas, other numbers of buckets and old versions against a dictionary."""
    monkeypatch.setattr(S, "DELTAS", 3)
    rng, want, kept = random.Random(2), {}, {}
    for step in range(7):
        state = S.State(spark, str(tmp_path), {"t": "k STRING, n BIGINT, v STRING"}, {"t": S.Keyed(("k",), 2 if step < 5 else 3)})
        new = {f"k{rng.randrange(30)}": (step, rng.choice([None, "x", "y"])) for _ in range(9)}
        want |= new
        version = state.change(merged={"t": spark.createDataFrame([(k, *v) for k, v in new.items()], "k string, n long, v string")})
        kept[version] = dict(want)
        assert {r.k: (r.n, r.v) for r in state.read("t").collect()} == want and len(state.folders("t")) <= 4
    assert {r.k: (r.n, r.v) for r in state.read("t", version - 1).collect()} == kept[version - 1]
    asked = state.looked_up("t", spark.createDataFrame([(f"k{i}", i) for i in range(40)], "k string, i long"))
    assert {r.k: (r.n, r.v) for r in asked.collect() if r.n is not None} == want and asked.count() == 40
    assert len(list(tmp_path.glob("t-*"))) == len({f for v in state.versions() for f in state.folders("t", v)})
    assert state.change(written={"t": spark.createDataFrame([("z", 1, None)], "k string, n long, v string")}) and [tuple(r) for r in state.read("t").collect()] == [("z", 1, None)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tidemark_")]


def test_an_old_version_is_refused(spark, tmp_path):
    state = S.State(spark, str(tmp_path), {"t": "a BIGINT"})
    rows = spark.range(2).withColumnRenamed("id", "a")
    state.change(written={"t": rows})
    state.change(appended={"t": rows})
    with pytest.raises(S.Conflict):
        state.change(written={"t": rows}, version=1)
    assert state.current() == 2 and state.read("t").count() == 4
    assert len(list(tmp_path.glob("t-*"))) == 2  # what the refused change wrote is gone
