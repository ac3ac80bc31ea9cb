"""Shortest-pack-first histogram packing (operator 7).

Each document becomes a run of token ids with one end id. Whole windows of it fill sequences of their
own; of the rest only its length matters. The histogram of these lengths, which has at most `size` rows,
is packed on the driver: lengths go longest first into the open pattern with the least in it (the one
with the most room), and each pattern carries a count, so the work depends on the lengths, not on the
documents. Patterns come back to documents by rank: the pieces of one length are numbered, and every
slot of a pattern owns a range of these numbers.

A sequence counts as padded to `size` tokens, unless its length is a power of two, which needs no padding.

Null and empty texts are a single end id. A string such as <|endoftext|> in a text is that special token, as it is for
the tokenizers library. Equal documents and ties are numbered apart. An empty table
gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_rank_ids, store

SIZE = 1024
END = 0


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """The vocabulary of a tokenizers file, ready to encode whole texts; strings of special tokens become these."""
    import tiktoken

    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, path: str, pattern: str, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of the pieces of each document."""

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(path, pattern)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*(tool.encode(text, allowed_special="all") if text else ()), END], "<u4")
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    out.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pattern, how many sequences have it), by shortest-pack-first over the histogram."""
    room: dict[int, list[list]] = {}  # free space -> [lengths, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max(room, default=0)
            if free < length:
                room.setdefault(size - length, []).append([(length,), left])
                break
            lengths, count = room[free][-1]
            used = min(left, count)
            room[free][-1][1] -= used
            if count == used:
                room[free].pop()
                if not room[free]:
                    del room[free]
            room.setdefault(free - length, []).append([(*lengths, length), used])
            left -= used
    return [(tuple(lengths), count) for free in sorted(room) for lengths, count in room[free]]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset) of every slot of every pattern."""
    out, taken, sequence = [], {}, 0
    for lengths, count in packs:
        offset = 0
        for length in lengths:
            at = taken.get(length, 0)
            out.append((length, at, at + count - 1, sequence, offset))
            taken[length] = at + count
            offset += length
        sequence += count
    return out


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """parts (doc_id, start, length, ...) with sequence_id and offset of each piece."""
    spark = parts.sparkSession
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    owned = slots(patterns(counts, size))
    table = spark.createDataFrame(owned, "length long, _from long, _to long, _sequence long, offset long")
    ranked = dense_rank_ids(parts, ["length"], ["doc_id", "start"], "_rank")
    return (
        ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & F.col("_rank").between(F.col("_from"), F.col("_to")))
        .withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from"))
        .drop(table["length"]).drop("_rank", "_from", "_to", "_sequence")
    )


def packed(docs: DataFrame, path: str, pattern: str, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    return pack(store(pieces(docs, path, pattern, size)), size).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
