"""The threshold algorithm against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk

ROWS = "vec_id long, embedding array<double>, label int"


def by_hand(rows, every, k, scale=topk.SCALE):
    """The k best of each query by comparing it with all others, in Python's integers."""
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        whole[i] = min(whole.get(i, v), v)
    whole = {i: [int(np.floor(x * scale)) if abs(x) < 2**40 else int(x) * scale for x in v] for i, v in whole.items()}
    out = []
    for q in whole:
        if q % every:
            continue
        scores = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
        out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def got(spark, rows, every, k, **more):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], ROWS).repartition(3)
    return sorted(tuple(r) for r in topk.top(frame, F.col("vec_id") % every == 0, k, **more).collect())


def vectors(n, dim, seed):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("values", [1, 1 << 19])
def test_like_brute_force(spark, values):
    """Over many blocks and over one, with copies and ties."""
    rows = vectors(700, 12, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(2000 + i, [float(round(x)) for x in rows[9][1]]) for i in range(60)]
    assert got(spark, rows, 20, 10, values=values) == by_hand(rows, 20, 10)


def test_odd_vectors(spark):
    """Missing, non-finite, empty, zero and repeated vectors, other dimensions, negative ids, and numbers beyond a long."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (10, [0.0, 0.0]), (-10, [-1.0, 0.5]), (20, []), (21, []),
            (30, [1.0]), (None, [1.0, 1.0]), (6, [3.0, 3.0]), (6, [2.0, 9.0]), (7, [2.0, 9.0]), (40, [1.0, 1.0, 1.0]), (41, [-1e300, 1.0, 0.0]), (50, [1e20, 1.0]), (51, [1e20, -1e19])]
    want = by_hand(rows, 10, 3)
    assert got(spark, rows, 10, 3) == want and (20, 1, 21, 0) in want and not any(q == 30 for q, *_ in want)


def test_no_rows(spark):
    assert got(spark, [], 10, 3) == [] and got(spark, [(1, [1.0])], 10, 3) == [] and got(spark, [(10, [1.0])], 10, 3) == []


def test_other_columns(spark):
    frame = spark.createDataFrame([(i, [float(i)], "x", "y", "z") for i in range(101)], "vec_id long, embedding array<float>, score string, rank string, block string")
    assert [tuple(r) for r in topk.nearest(frame).where("rank = 1").orderBy("query_id").collect()] == [(0, 1, 1, 0), (100, 1, 99, 100 * 99 * 1024 * 1024)]


def test_stops_before_the_lists_end():
    """A block is left as soon as its bound is below what is asked, and tied smaller ids are still found."""
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(4000, 8)) * 50)
    rows[:5] = 400
    order = np.argsort(rows.T, axis=1, kind="stable")

    class Counting(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, tuple) and isinstance(at[-1], slice):
                Counting.read = max(Counting.read, at[-1].stop)
            return super().__getitem__(at)

    block = topk.Block(np.arange(4000)[::-1].copy(), rows, order)
    block.order = block.order.view(Counting)
    ids, scores = block.search(-1, np.full(8, 400.0), 3, None)
    assert ids.tolist() == [3995, 3996, 3997] and set(scores) == {400.0 * 400 * 8} and Counting.read < 100
    assert len(block.search(-1, np.full(8, 400.0), 3, 400 * 400 * 8 + 1)[0]) == 0
