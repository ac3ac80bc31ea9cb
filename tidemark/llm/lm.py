"""Cross-entropy difference under matched language models (operator 5).

Two bigram models, of the target documents and of all others (the background), share one vocabulary: the tokens of a
byte-level BPE file, and a symbol for the start and the end of a text. Both have the same order and are smoothed
alike, by interpolating bigrams, single tokens and the uniform distribution over all tokens that occur, so only their
counts differ. Counts are of all documents whole. A document is scored by models without it: its own counts
are taken out of the side that it belongs to. Its score is its mean loss per token (in nats; the end counts as one)
under the target model less that under the background model: the lower, the closer to the target.

Bigram counts grow with the corpus: they are a Spark table, added up in each chunk of texts and then by bigram. Those
with at least one in HOT of all bigrams, so HOT at most at any size, are broadcast, and so are the counts of single
tokens, of which there are no more than the vocabulary file has. Each document's other bigrams are joined to
the table; none of these holds more than one in HOT of the rows, so no key is hot. The split has no influence on results.

Null and empty texts have no token, losses and score 0, and count nowhere. Without target (or background) documents
besides the one that is scored that model is uniform. A null doc_id is never a target; of rows with one doc_id all are,
or none. Each of several equal rows counts, so the others stay when one is scored. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: Shares of bigrams, single tokens and the uniform distribution.
WEIGHTS = (0.6, 0.3, 0.1)
#: Bigrams with at least one in so many of all are broadcast (6 MB), the others joined.
HOT = 1 << 18
#: Tokens that a task counts at a time.
CHUNK = 1 << 21
#: The symbol for start and end; token ids follow from 1.
EDGE = 0
LOW = (1 << 32) - 1


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """The vocabulary of a tiktoken file, ready to encode."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pairs(symbols: np.ndarray) -> np.ndarray:
    """The bigrams of a text, its edges included: one symbol in the upper 32 bits, its successor in the lower ones."""
    whole = np.concatenate([[EDGE], symbols, [EDGE]]).astype("int64")
    return (whole[:-1] << 32) | whole[1:]


def symbols_of(text: str | None, tool) -> np.ndarray:
    return np.array(tool.encode_ordinary(text or ""), "int32") + 1


def bigrams(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """How often each bigram is in background and target; rows have text and target."""

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, held = encoder(path, pattern), ([], [])

        def flush() -> pd.DataFrame:
            parts = []
            for side in (0, 1):
                if held[side]:
                    cell, n = np.unique(np.concatenate(held[side]), return_counts=True)
                    parts.append(pd.DataFrame({"cell": cell, "background": n * (1 - side), "target": n * side}))
                    held[side].clear()
            return pd.concat(parts)

        size = 0
        for batch in batches:
            for text, target in zip(batch["text"], batch["target"]):
                symbols = symbols_of(text, tool)
                if len(symbols):
                    held[int(target)].append(pairs(symbols))
                    size += len(symbols)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return (
        rows.select("text", "target").mapInPandas(counted, "cell long, background long, target long")
        .groupBy("cell").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))
    )


def share(part: np.ndarray, whole: np.ndarray, outcomes: int) -> np.ndarray:
    """part / whole, and the uniform distribution where the whole is nothing."""
    return np.divide(part, whole, out=np.full(len(part), 1 / outcomes), where=whole > 0)


def priced(symbols: np.ndarray, known: tuple) -> tuple:
    """Losses of a text, its bigrams that are not broadcast taken as new, and cell, times and factors of these.

    Losses and factors are four: under the background with and without the text itself, and under the target likewise.
    A factor tells by how much each occurrence of the bigram raises its probability, relative to that of a new one.
    """
    single, sizes, hot, counts, outcomes = known
    a, b, c = WEIGHTS
    cell, times = np.unique(pairs(symbols), return_counts=True)
    own, n = np.unique(np.append(symbols, EDGE), return_counts=True)
    first, last = cell >> 32, cell & LOW
    own_first, own_last = n[np.searchsorted(own, first)], n[np.searchsorted(own, last)]
    at = np.minimum(np.searchsorted(hot, cell), max(0, len(hot) - 1))
    is_hot = hot[at] == cell if len(hot) else np.zeros(len(cell), bool)
    rare = ~is_hot
    losses, factors = [], []
    for side in (0, 1):
        found = np.where(is_hot, counts[side][at], 0) if len(hot) else np.zeros(len(cell))
        for mine in (0, 1):
            # of the side that the text is not in, no count is less than nothing
            less = lambda whole, part: np.maximum(whole - part, 0) if mine else whole  # noqa: E731, B023
            before, after = less(single[side][first], own_first), less(single[side][last], own_last)
            lower = b * share(after, np.full(len(cell), less(sizes[side], n.sum())), outcomes) + c / outcomes
            losses.append(float(-(times * np.log(a * share(less(found, times), before, outcomes) + lower)).sum()))
            before, lower = before[rare], lower[rare]
            factors.append(np.divide(a, before, out=np.zeros(len(lower)), where=before > 0) / lower)
    return (*losses, cell[rare], times[rare], *factors)


#: What `priced` gives, for each side and with or without the text.
KINDS = ("far", "far_alone", "near", "near_alone")


def score(docs: DataFrame, target: DataFrame, path: str, pattern: str, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every document; target has the doc_id of target documents."""
    # the targets grow with the corpus: a shuffled join at every size, never a broadcast
    chosen = target.where("doc_id is not null").select("doc_id").distinct().withColumn("target", F.lit(True)).hint("merge")
    texts = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id", "left")
    table = store(bigrams(texts.select("text", F.coalesce("target", F.lit(False)).alias("target")), path, pattern))
    every = F.col("background") + F.col("target")
    total = table.agg(F.coalesce(F.sum(every), F.lit(0))).first()[0]
    # one row for each token of the vocabulary at most
    tokens = table.groupBy(F.col("cell").bitwiseAND(LOW).alias("symbol")).agg(F.sum("background").alias("background"), F.sum("target").alias("target")).toPandas()
    single = np.zeros((2, int(tokens["symbol"].max()) + 1 if len(tokens) else 1), "int64")
    for side, name in enumerate(("background", "target")):
        single[side][tokens["symbol"].astype("int64")] = tokens[name]
    often = table.where(every * hot >= total).toPandas().sort_values("cell")
    columns = [often[x].to_numpy("int64") for x in ("cell", "background", "target")]
    shared = docs.sparkSession.sparkContext.broadcast((single, single.sum(1), columns[0], columns[1:], max(1, len(tokens))))
    arrays = [f"{x}_factors" for x in KINDS]

    form = ", ".join(["n_tokens long", *[f"{x} double" for x in KINDS], "cells array<long>", "times array<int>", *[f"{x} array<float>" for x in arrays]])

    @F.pandas_udf(form)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool, known = encoder(path, pattern), shared.value
        for batch in batches:
            found = []
            for text in batch:
                symbols = symbols_of(text, tool)
                found.append((len(symbols), *(priced(symbols, known) if len(symbols) else (0.0,) * 4 + ([],) * 6)))
            yield pd.DataFrame(found, columns=["n_tokens", *KINDS, "cells", "times", *arrays])

    own = F.coalesce("target", F.lit(False))
    picked = [F.when(own == F.lit(side == "near"), F.col(f"{side}_alone{x}")).otherwise(F.col(f"{side}{x}")).alias(f"{side}{x}") for x in ("", "_factors") for side in ("far", "near")]
    # stored with their numbers, so that both uses have the same
    parts = store(
        docs.select("doc_id", scored("text").alias("_x")).select("doc_id", "_x.*").join(chosen, "doc_id", "left")
        .select("doc_id", own.alias("target"), "n_tokens", "cells", "times", *picked, F.monotonically_increasing_id().alias("_row"))
    )
    each = parts.select("_row", F.col("target").alias("mine"), F.explode(F.arrays_zip("cells", "times", "far_factors", "near_factors")).alias("_c")).select("_row", "mine", "_c.*")
    others = {"far": F.col("background") - F.when(F.col("mine"), 0).otherwise(F.col("times")), "near": F.col("target") - F.when(F.col("mine"), F.col("times")).otherwise(0)}
    saved = [F.sum(F.col("times") * F.log1p(n * F.col(f"{x}_factors"))).alias(f"_{x}") for x, n in others.items()]
    more = each.join(table.where(every * hot < total), each["cells"] == table["cell"]).groupBy("_row").agg(*saved)
    n = F.when(F.col("n_tokens") > 0, F.col("n_tokens") + 1).otherwise(1)
    whole = parts.drop("cells", "times", "far_factors", "near_factors").join(more, "_row", "left")
    return whole.select(
        "doc_id", "n_tokens", *[((F.col(x) - F.coalesce(f"_{x}", F.lit(0.0))) / n).alias(name) for x, name in (("near", "target_loss"), ("far", "background_loss"))]
    ).withColumn("score", F.col("target_loss") - F.col("background_loss"))
