"""Small helpers shared by the corpus operators: table access, ranks, samples; and the cut points of the package."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import store

__all__ = ["dense_rank_ids", "runs", "sampled", "store", "table", "words"]


WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """The runs of letters (Unicode's categories L) in a text: no digits, and no other signs of numbers such as a half."""
    found = WORD.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in "".join(c if c.isalpha() else " " for c in word).split()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, read whole through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(df: DataFrame, keys: list[str], size: int, most: int = 16_384) -> Column:
    """A number for each row that rises with the keys, about `size` rows having the same (more, where that takes over `most` runs).

    The bounds between runs are quantiles of a sample of the rows' keys, 32 for each run and so bounded, which is chosen
    by a hash. Neither gaps in the keys nor many rows of one key make a run large, as long as the last key tells such rows
    apart. Keys are integers; nulls come first.
    """
    n = df.count()
    number = min(most, math.ceil(n / size))
    if number < 2:
        return F.lit(0)
    place = F.struct(*[F.col(k).cast("long").alias(f"k{i}") for i, k in enumerate(keys)])
    share = F.pmod(F.xxhash64(F.lit("run"), *keys), F.lit(1_000_003)) / F.lit(1_000_003)
    rows = df.where(share < 32 * number / n).select(place.alias("p")).select("p.*").collect()
    some = sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x or 0) for x in r])
    bounds = list(dict.fromkeys(some[len(some) * i // number] for i in range(1, number))) if some else []
    if not bounds:
        return F.lit(0)
    # two steps, so that a row meets about twice the square root of the bounds
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    one = "struct<" + ", ".join(f"k{i}: bigint" for i in range(len(keys))) + ">"
    spelled = lambda b: {f"k{i}": x for i, x in enumerate(b)}
    firsts = F.from_json(F.lit(json.dumps([spelled(g[0]) for g in groups[1:]])), f"array<{one}>")
    inside = F.from_json(F.lit(json.dumps([{"g": [spelled(b) for b in g]} for g in groups])), f"array<struct<g: array<{one}>>>")
    before = F.size(F.filter(firsts, lambda b: b <= place))
    return (before * width + F.size(F.filter(F.get(inside, before)["g"], lambda b: b <= place))).cast("int")


def dense_rank_ids(df: DataFrame, group: list[str], order: list[str], name: str, per_run: int = 16_384) -> DataFrame:
    """Number the rows of each group from 0 in the given order of integers, without one task per group.

    The rows are cut into runs of about per_run rows in that order and numbered inside (group, run); the runs'
    sizes, one row each, are summed up in front of them. Nulls come first. Ties get distinct numbers. The rows are stored
    with the ids that tell ties apart, so that whatever is computed again finds the same.
    """
    told = store(df.withColumn("_row_id", F.monotonically_increasing_id()))
    order = [*order, "_row_id"]
    rows = told.withColumn("_run", runs(told, order, per_run))
    inside = Window.partitionBy(*group, "_run").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*group, "_run").agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        rows.withColumn("_row", F.row_number().over(inside))
        .join(starts, [*group, "_run"])
        .withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long"))
        .drop("_run", "_row", "_row_id", "_before")
    )


def sampled(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """About `most` rows of each value of `by` (all, where there are fewer), chosen by the MD5 hash of `key`.

    The same rows are chosen on every run. The values of `by` must be few (languages, labels): their sizes
    are broadcast, and the rows are not shuffled.
    """
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))
    text = F.concat(F.lit("sample:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    share = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return rows.join(F.broadcast(sizes), by).where(share * F.col("_size") < F.lit(most)).drop("_size")
