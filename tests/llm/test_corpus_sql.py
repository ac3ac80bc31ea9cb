"""Corpus queries that SQL can express give the SQL's rows, and all run over the whole tables."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from compare import duck_rows, spark_rows  # noqa: E402

from tidemark.llm import oracle, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_same_rows(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    columns, want = duck_rows(small, oracle.ORACLE_SQL[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == want


def test_conversations_with_copies_told_apart(spark):
    """The SQL numbers the two copies of a repeated row twice, each time in any order, and so may call the first one a duplicate; with the copies in order it gives the query's rows."""
    name, folder = "op13_conversation_repair", "/root/testdata/sf0.01"
    told = oracle.ORACLE_SQL[name].replace("NULLS FIRST, role, text)", "NULLS FIRST, role, text, again)").replace("role, text ORDER BY turn NULLS FIRST)", "role, text ORDER BY turn NULLS FIRST, again)")
    assert spark_rows(queries.QUERIES[name](spark, folder)) == duck_rows(folder, told)[1]


def test_near_copies_in_a_large_group(spark, small, tmp_path):
    """What a large group shares has a low idf, and what one copy alone has a high one: copies that are 0.8 alike unweighted are less alike weighted, and the SQL links as few of them."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(3000)]
    base = rng.choices(vocabulary, k=100)
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 140))) for _ in range(280)]
    for i in range(120):
        near = list(base)
        for at in rng.sample(range(100), i % 5):
            near[at] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    rng.shuffle(texts)
    for path in Path(small).glob("*.parquet"):
        if path.stem != "documents":
            (tmp_path / path.name).symlink_to(path)
    pd.DataFrame({"doc_id": range(400), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t) for t in texts]}).to_parquet(tmp_path / "documents.parquet")
    got = spark_rows(queries.op3_minhash(spark, str(tmp_path)))
    assert got == duck_rows(str(tmp_path), oracle.ORACLE_SQL["op3_minhash"])[1]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (re.findall(r"\w+", t) for t in texts)]
    alike = {x for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b) for x in (i, j)}
    assert max(Counter(r[0] for r in got).values()) < 60 < len(alike)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE_SQL)))
def test_every_document(spark, small, name):
    ids = {r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in queries.QUERIES[name](spark, small).select("doc_id").collect()} == ids


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
