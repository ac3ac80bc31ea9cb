"""The audit of filters against counting document by document."""

import random
import re
from itertools import permutations

from tidemark.llm import audit

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def by_hand(docs, labels):
    texts = {}
    for i, text, _ in docs:
        if i is not None:
            texts.setdefault(text or "", set()).add(i)
    failing = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and min(texts[text]) < i,
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        failing.append((lang or "", {f for f, x in fails.items() if x}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, total = [], {}
    for order in permutations("ABCDE"):
        for part in {p for p, *_ in failing}:
            left = [x for x in failing if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = [x for x in failing if x[0] == part and f in x[1]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), sum(x[1] == {f} for x in fails), sum(x[2] for x in gone), sum(x[3] for x in gone)])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def fixture(seed, n=150):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        some = rng.choices("the cat sat on a mat WITH A Hat #5 and\x0bthen é".split(" "), k=rng.choice([0, 3, 150, 199, 200, 260]))
        if rng.random() < 0.5:
            some = [w + str(j) for j, w in enumerate(some)]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(some), rng.choice(["en", "fr", None, ""])))
    docs += [(500 + i, docs[rng.randrange(n)][1], rng.choice(["en", "de"])) for i in range(60)]
    docs += [(900, None, "en"), (901, "", "en"), (None, docs[3][1], "en"), (None, "only here", None), (3, docs[3][1], "fr"), (3, docs[4][1], "fr"), (2, "9 " * 200, "de"), (-4, docs[5][1], "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, 2])) for i in rng.sample(range(560), 200)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (10**9, 1, 1)]
    return docs, labels


def test_like_counting(spark):
    docs, labels = fixture(1)
    got = audit.audit(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, got.collect())) == by_hand(docs, labels)


def test_cells_come_back_from_sums(spark):
    """The transform's inverse is exact."""
    rows = spark.createDataFrame([("x", m % 32, m % 2, m % 3 // 2, 10**15 + m * m) for m in range(64)], "part string, mask int, good int, toxic int, n long")
    one = audit.cells(audit.parity_sums(rows)).first()
    assert one.documents == [2 * 10**15 + m * m + (m + 32) ** 2 for m in range(32)] and one.good == [x if m % 2 else 0 for m, x in enumerate(one.documents)]


def test_no_rows_and_other_columns(spark):
    empty, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(empty, labels).count() == 0
    odd = spark.createDataFrame([(1, "a b", "en"), (2, "A" * 22_000_000, "en")], DOCS)  # a hundred times as much is no int
    for name in ("part", "mask", "n", "least", "good", "digest", "step"):
        odd = odd.selectExpr("*", f"'x' AS `{name}`")
    assert audit.audit(odd, labels.selectExpr("*", "'x' AS good", "1 AS n")).where("kept < 0 or kept > 2").count() == 0
