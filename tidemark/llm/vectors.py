"""Embedding near-duplicates by a pivot-permutation index (operator 6).

Equal vectors of a label are one, with a count. A bounded sample of the distinct vectors serves as reference
points, their number twice the square root of the vectors' (up to VALUES numbers altogether). Every vector is
described by its nearest reference points in order, and stands in the inverted list of each. Two vectors of one
label that share at least SHARED points are candidates; their cosine, in double precision, decides.

Lists are made of ids first. Their lengths tell in how many blocks of about BLOCK rows each is compared; then every
vector is fetched once and goes to the blocks of its lists, those of one row left out. As the points grow with
the square root of the vectors, so do the lists, and what is compared grows with the power 1.5. A pair that meets
in several lists counts only in that of its smallest shared point. Tasks return a count for each row and a star
for each group of linked rows, so that no group's pairs are ever written out.

Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with
nothing. A vec_id that repeats counts as one vector, its least (label, embedding) that can link. Vectors of other
dimensions than the reference points' link only with each other, all of one dimension compared directly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .graph import components

#: Reference points at least, and the numbers that all of them together may have (64 MB as doubles).
FEWEST, VALUES = 64, 1 << 23
#: Nearest points that describe a vector: so many for up to 1024 points, and two more for each doubling.
NEAREST = 10
SHARED = 2
BLOCK = 1024
COSINE = 0.93


def usable() -> F.Column:
    """Whether a row's vector can link at all."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def points(rows: DataFrame, most: int = VALUES) -> np.ndarray:
    """Reference points: unit vectors of rows chosen by a hash of vec_id, of the most frequent dimension."""
    size = F.size("embedding")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.mode(size).alias("dim")).first()
    count = int(min(most // (n.dim or 1), max(FEWEST, 2 * n.n**0.5)))
    share = F.pmod(F.xxhash64(F.lit("point"), "vec_id"), F.lit(1_000_003)) / F.lit(1_000_003) * F.lit(n.n)
    some = rows.where(size == F.lit(n.dim or 0)).where(share < 2 * count).orderBy(F.xxhash64("vec_id"), "vec_id").limit(count)
    found = np.array([r.embedding for r in some.select("embedding").collect()], "float64").reshape(-1, n.dim or 1)
    return unit(found)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that neither tiny nor huge components lose it."""
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def described(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """rows with `near`: the numbers of the nearest reference points in order."""
    shared = rows.sparkSession.sparkContext.broadcast(refs)  # at most VALUES numbers
    nearest = NEAREST + 2 * max(0, math.ceil(math.log2(max(1, len(refs)) / 1024)))

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for batch in batches:
            out: list = [[-1 - len(v)] * 1 for v in batch]
            fit = [i for i, v in enumerate(batch) if len(v) == known.shape[1]]
            step = max(16, (1 << 22) // max(1, len(known)))
            for at in range(0, len(fit), step):
                some = fit[at : at + step]
                cosine = unit(np.stack([np.asarray(batch.iloc[i], "float64") for i in some])) @ known.T
                for i, order in zip(some, np.argsort(-cosine, axis=1, kind="stable")[:, :nearest]):
                    out[i] = order.tolist()
            yield pd.Series(out)

    return rows.withColumn("near", near(F.col("embedding")))


def compared(part: pd.DataFrame, cosine: float, shared: int) -> pd.DataFrame:
    """Counts of links (to all copies) and star edges among the rows of one block, or between two, of one list."""
    point, one, other = int(part["point"].iloc[0]), part["b1"].iloc[0], part["b2"].iloc[0]
    a = part[part["block"] == one]
    b = a if one == other else part[part["block"] == other]
    if not len(a) or not len(b):
        return pd.DataFrame({"vec_id": [], "links": [], "root": []}).astype("int64")
    names = np.unique(np.concatenate([*a["near"], *b["near"]]))

    def marks(rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(rows), len(names)), "float32")
        for i, near in enumerate(rows["near"]):
            out[i, np.searchsorted(names, near)] = 1
        return out

    ma, mb = marks(a), marks(b)
    before = names < point
    need = 1 if point < 0 else shared
    met = (ma @ mb.T >= need) & (ma[:, before] @ mb[:, before].T == 0)
    ua, ub = (unit(np.stack([np.asarray(v, "float64") for v in x["embedding"]])) for x in (a, b))
    ia, ib = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
    linked = met & (ua @ ub.T >= cosine) & (ia[:, None] != ib[None, :])
    na, nb = a["copies"].to_numpy(), b["copies"].to_numpy()
    counts, ids = (linked @ nb, ia) if one == other else (np.concatenate([linked @ nb, na @ linked]), np.concatenate([ia, ib]))
    root = {int(x): int(x) for x in ids}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(linked.any(1)):
        mine = top(int(ia[i]))
        for x in np.unique(ib[linked[i]]):
            theirs = top(int(x))
            if theirs != mine:
                root[max(mine, theirs)] = mine = min(mine, theirs)
    keep = counts > 0
    return pd.DataFrame({"vec_id": ids[keep], "links": counts[keep], "root": [top(int(x)) for x in ids[keep]]})


def links(rows: DataFrame, cosine: float = COSINE, shared: int = SHARED) -> DataFrame:
    """vec_id, links and root: partial counts of links, and a vector that each is linked to through others.

    rows are distinct vectors: vec_id, label, embedding and copies.
    """
    known = store(described(rows, points(rows)))
    lists = known.select("vec_id", "label", F.explode("near").alias("point"))
    # stored, so that the join knows its size, and can split the longest lists if it shuffles
    sizes = store(lists.groupBy("label", "point").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "point", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    places = lists.join(sizes, ["label", "point"]).groupBy("vec_id").agg(F.collect_list(F.struct("point", "blocks")).alias("places"))
    spread = (
        known.join(places, "vec_id").withColumn("place", F.explode("places")).select("vec_id", "label", "embedding", "copies", "near", "place.*")
        .withColumn("block", F.pmod(F.xxhash64("vec_id", "point"), F.col("blocks")).cast("int"))
        .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("b1", F.least("block", "mate")).withColumn("b2", F.greatest("block", "mate"))
    )
    return spread.groupBy("label", "point", "b1", "b2").applyInPandas(
        lambda part: compared(part, cosine, shared), "vec_id long, links long, root long"
    )


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    every = store(
        embeddings.withColumn("_odd", ~usable() | F.col("vec_id").isNull()).groupBy("vec_id").agg(F.min(F.struct("_odd", "label", "embedding")).alias("row"))
        .select("vec_id", F.col("row._odd").alias("odd"), "row.label", "row.embedding")
    )
    alike = store(every.where("not odd").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    found = store(links(alike, cosine, shared))
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    classes = (
        alike.join(counts, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    )
    return (
        every.join(classes.withColumn("odd", F.lit(False)), ["label", "embedding", "odd"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
    )
