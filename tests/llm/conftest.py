import random

import pytest

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
SYLLABLES = "the and ing tion er est ou an on re in th at en ha".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with exact copies, near copies, shared passages, odd characters, an empty, a null and a long one."""
    rng = random.Random(5)
    passage = words(rng, 60)
    out = [words(rng, rng.randint(5, 150)) for _ in range(60)]
    out[20] = words(rng, 150)
    out += [out[3], out[3], out[7] + " tail", "start " + out[8], out[9] + " " + passage, passage + " " + out[10], passage]
    for i in range(12):
        near = out[20].split()
        near[rng.randrange(len(near))] = f"changed{i}"
        out.append(" ".join(near))
    return [*out, "", None, "a" * 700, "é日😀 " * 80, "...!!", "<|endoftext|> it's 42\n\n  x", "two words", words(rng, 4000)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, ("en", "fr", None)[i % 3], f"s{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, a null doc_id, null and empty texts, and extra columns with names that operators use."""
    rows = [(1, "same text here for all of us", "en"), (1, "same text here for all of us", "en"), (None, "no id at all", "en"), (2, None, None), (3, "", "fr"), (4, "same text here for all of us", "fr")]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    for name in ("key", "shard", "score", "spans", "slot", "label", "n", "component", "next", "hashes", "target", "_run", "_tie"):
        frame = frame.selectExpr("*", f"'x' AS `{name}`")
    return frame
