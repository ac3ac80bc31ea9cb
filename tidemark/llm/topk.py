"""Exact top-k search by inner product with Fagin's threshold algorithm (operator 11).

The components of a vector x become the integers floor(SCALE * x), x as double. The vectors of one dimension are
dealt into blocks of about VALUES numbers by a hash of their id. A block holds one sorted list of its vectors for each
dimension. A query reads the lists of the dimensions where it is not zero from their better end on, all to the same
depth, looks up the vectors that it meets, and keeps the k best. No vector that it has not met can score more than the
sum over the lists of its own component times the next value there; once that bound is below the kth best score, the
block has nothing more to give. (Where the bound equals that score it reads on, for a smaller id would win the tie.)

First every query searches the block that it lies in itself. Its kth score there is a lower bound of its kth score
overall, with which it starts in all other blocks, so that most of these end early, and return only what can still
be among the first k. Queries travel in packs of PACK; a task searches one block for up to PACKS of them, so neither
blocks nor tasks grow with the table.

All sums are exact: in doubles where they stay below 2^53, in Python's integers otherwise. Scores beyond 64 bits are
ranked exactly and returned as the nearest long.

Vectors that are null or hold null or non-finite components take no part, and neither does a null vec_id. A vec_id that
repeats counts once, with the least of its vectors that take part. Vectors of different dimensions are never compared;
empty vectors score 0 with each other. Ties go to the smaller vec_id. An empty table gives an empty result. Other
columns, whatever they are called, play no part.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

SCALE = 1024
TOP = 10
#: Of vec_ids: those that are divisible by it are queries.
EVERY = 100
#: Numbers in a block, queries that travel together, and packs that a task takes.
VALUES, PACK, PACKS = 1 << 19, 128, 64
#: Depth to which lists are read first; each further step is twice as long.
STEP = 16
FOUND = "query_id long, vec_id long, score decimal(38,0)"


def usable(vector: str = "embedding") -> Column:
    """Whether a row's vector takes part."""
    return F.col("vec_id").isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as exact integers: doubles where these hold them, else Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not x.size or np.abs(scaled).max() < 2**53:
        return scaled
    out = np.empty(x.shape, object)
    out.flat = [int(s) if abs(s) < 2**53 else int(v) * scale for s, v in zip(scaled.flat, x.flat)]
    return out


def exact(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in doubles if every sum of products stays below 2^53, both in Python's integers otherwise."""
    if rows.dtype != object and queries.dtype != object:
        most = [float(np.abs(x).max()) if x.size else 0.0 for x in (rows, queries)]
        if most[0] * most[1] * max(1, rows.shape[1]) < 2**53:
            return rows, queries
    spell = lambda x: x if x.dtype == object else np.array([int(v) for v in x.flat], object).reshape(x.shape)
    return spell(rows), spell(queries)


class Block:
    """Some vectors with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray):
        """rows: one for each id, integers; order: for each dimension the rows by rising value."""
        self.ids, self.rows = ids, rows
        self.order = np.stack([order, order[:, ::-1]])  # from the least on, and from the greatest on
        self.lists = np.take_along_axis(rows.T[None], self.order, axis=2) if rows.size else self.order

    def search(self, own: int, query: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but that of id `own`, as far as these reach the score `floor`."""
        n = len(self.ids)
        used = np.flatnonzero(query != 0)
        weight = query[used]
        end = (weight > 0).astype("int64")  # each list is read from where its product is greatest
        met = self.ids == own
        ids, scores = np.empty(0, "int64"), np.empty(0, self.rows.dtype)
        depth, step = 0, STEP
        while depth < n:
            bound = (weight * self.lists[end, used, depth]).sum() if len(used) else 0
            if floor is not None and bound < floor or len(ids) == k and bound < scores[-1]:
                break
            # a query of zeros scores 0 with all of them, and has no list to tell which to look at first
            seen = self.order[end, used, depth : depth + step].ravel() if len(used) else np.arange(n)
            seen = np.unique(seen[~met[seen]])
            met[seen] = True
            got = self.rows[seen] @ query
            if floor is not None:
                seen, got = seen[got >= floor], got[got >= floor]
            ids, scores = np.concatenate([ids, self.ids[seen]]), np.concatenate([scores, got])
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
            depth, step = depth + step if len(used) else n, step * 2
        return ids, scores


def packed(ids: np.ndarray, vectors: list, **more) -> pd.DataFrame:
    """Ids and vectors as one row of bytes."""
    values = np.array([np.asarray(v, "float64") for v in vectors], "float64").reshape(len(ids), -1)
    return pd.DataFrame([{"ids": ids.astype("int64").tobytes(), "vectors": values.tobytes(), **more}])


def unpacked(row, scale: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "int64")
    return ids, whole(np.frombuffer(row["vectors"], "float64").reshape(len(ids), -1), scale)


def indexed(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """A row for each block of rows (dim, block, vec_id, embedding): ids, vectors, and the order of each dimension's list."""

    def built(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        out = packed(part["vec_id"].to_numpy(), part["embedding"].tolist(), dim=part["dim"].iloc[0], block=part["block"].iloc[0])
        order = np.argsort(unpacked(out.iloc[0], scale)[1].T, axis=1, kind="stable")
        return out.assign(orders=[order.astype("uint32").tobytes()])

    return rows.groupBy("dim", "block").applyInPandas(built, "dim int, block int, ids binary, vectors binary, orders binary")


def searched(k: int, scale: int, at_home: bool):
    """A task: the best vectors of one block (the only row of `index`) for packs of queries that lie in it, or that do not."""

    def task(index: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(index):
            ids, rows = unpacked(index.iloc[0], scale)
            order = np.frombuffer(index["orders"].iloc[0], "uint32").reshape(rows.shape[1], len(ids)).astype("int64")
            block = None
            for _, pack in packs.iterrows():
                own, queries = unpacked(pack, scale)
                rows, queries = exact(rows, queries)
                if block is None or block.rows.dtype != rows.dtype:
                    block = Block(ids, rows, order)
                for one, query, floor, home in zip(own.tolist(), queries, pack["floors"], pack["homes"]):
                    if (home == index["block"].iloc[0]) != at_home:
                        continue
                    found, scores = block.search(one, query, k, None if floor is None else int(floor))
                    out += [(one, i, int(s)) for i, s in zip(found.tolist(), scores)]
        frame = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        return frame.assign(score=[spelled(s) for s in frame["score"]])

    return task


def spelled(score: int):
    """A score as a decimal of 38 digits; what is larger (beyond any long) as the largest of these."""
    return Decimal(max(-(10**38) + 1, min(10**38 - 1, score)))


def best(found: DataFrame, k: int) -> DataFrame:
    """found with rank, of the k best of each query. Spark keeps k of each query in every task before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top(embeddings: DataFrame, queries: Column, k: int = TOP, scale: int = SCALE, values: int = VALUES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors for each row of embeddings (vec_id, embedding) that is a query."""
    every = store(
        embeddings.where(usable()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks")).withColumn("dim", F.size("embedding"))
    )
    size = F.least(F.lit(65536), F.greatest(F.lit(64), F.lit(values) / F.greatest(F.col("dim"), F.lit(1))))
    # a row for each dimension; stored, so that Spark knows how small it is
    sizes = store(every.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).select(
        "dim", F.ceil(F.col("n") / size).cast("int").alias("blocks"), F.ceil(F.col("asking") / PACK).cast("int").alias("packs"),
    ))
    dealt = every.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.col("blocks")).cast("int"))
    index = store(indexed(dealt.select("dim", "block", "vec_id", "embedding"), scale))
    asked = dealt.where("asks").select("dim", "block", "blocks", "packs", "vec_id", "embedding")

    def pack(part: pd.DataFrame, **more) -> pd.DataFrame:
        row = packed(part["vec_id"].to_numpy(), part["embedding"].tolist(), dim=part["dim"].iloc[0], **more)
        return row.assign(homes=[part["block"].tolist()], floors=[part["floor"].tolist()])

    # first the block that a query lies in; it has few queries, as it has few rows
    sent = "ids binary, vectors binary, dim int, homes array<int>, floors array<decimal(38,0)>"
    own = asked.withColumn("floor", F.lit(None).cast("decimal(38,0)")).groupBy("dim", "block").applyInPandas(lambda part: pack(part, block=part["block"].iloc[0]), f"{sent}, block int")
    near = store(index.groupBy("dim", "block").cogroup(own.groupBy("dim", "block")).applyInPandas(searched(k, scale, True), FOUND))

    # then all others, from that block's kth score on
    floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("floor")).where(F.col("_n") == k).drop("_n")
    known = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").withColumn("pack", F.pmod(F.xxhash64(F.lit("pack"), "vec_id"), F.col("packs")).cast("int"))
    packs = known.groupBy("dim", "pack").applyInPandas(
        lambda part: pack(part, blocks=part["blocks"].iloc[0], group=part["pack"].iloc[0] // PACKS), f"{sent}, blocks int, group int"
    )
    sent_on = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    spread = index.join(sizes.where("packs > 0"), "dim").withColumn("group", F.explode(F.sequence(F.lit(0), F.floor((F.col("packs") - 1) / PACKS).cast("int")))).drop("blocks", "packs")
    key = ["dim", "block", "group"]
    far = spread.groupBy(*key).cogroup(sent_on.groupBy(*key)).applyInPandas(searched(k, scale, False), FOUND)
    kept = F.least(F.greatest(F.col("score"), F.lit(-(1 << 63)).cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    return best(near.unionByName(far), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", kept.cast("long").alias("score"))


def nearest(embeddings: DataFrame) -> DataFrame:
    """The ten best of all vectors for each whose vec_id is divisible by EVERY."""
    return top(embeddings, F.col("vec_id") % EVERY == 0)
