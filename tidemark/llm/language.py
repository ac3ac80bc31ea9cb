"""Language identification by rank-order profiles (operator 2).

A language's profile is its most frequent character n-grams in order. A text's own most frequent n-grams
are ranked likewise, and each counts how far out of place it is in the profile (the profile's length,
where it is missing). The language with the least sum is predicted; equal sums go to the first name.

n-grams are taken inside words: letters only, lower case, with one mark before and behind. A text that is
null, empty or without a letter gives `und` and score 0. The score is how much nearer the best language
is than the next: 1 - best / next.

Profiles are learned from at most DOCS whole texts of each language (chosen by a hash of doc_id); rows
with a null language or null text teach nothing. Without any profile everything is `und`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, words

LENGTHS = (1, 2, 3, 4)
#: n-grams of a profile, and of a text's own ranking.
TOP = 400
#: Documents of each language that its profile is learned from, at most (about).
DOCS = 1500
#: Distinct words whose n-grams a worker remembers.
MEMO = 200_000


def grams(word: str) -> list[str]:
    """The n-grams of one word with a mark at either end."""
    marked = f"_{word}_"
    out = list(word)  # a mark alone says nothing
    for n in LENGTHS[1:]:
        out += [marked[i : i + n] for i in range(len(marked) - n + 1)]
    return out


def ordinal(gram: str) -> tuple[int, int]:
    """Two numbers that order equally frequent n-grams as their code points do."""
    points = [ord(c) for c in gram] + [0] * (max(LENGTHS) - len(gram))
    return points[0] << 42 | points[1] << 21 | points[2], points[3]


def learn(rows: DataFrame, docs: int = DOCS, top: int = TOP) -> dict[str, list[str]]:
    """Profiles by language from columns doc_id, text and lang. They are few and of fixed length, so they fit the driver."""

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                spoken: Counter = Counter()
                for text in part["text"]:
                    spoken.update(words(text.lower()))
                found: Counter = Counter()
                for word, n in spoken.items():
                    for gram in grams(word):
                        found[gram] += n
                yield pd.DataFrame({"lang": lang, "gram": list(found), "n": np.fromiter(found.values(), "int64", len(found))})

    known = rows.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = (
        sampled(known, "lang", "doc_id", docs).mapInPandas(counted, "lang string, gram string, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    profiles: dict[str, list[str]] = {}
    for row in best.orderBy("lang", "rank").select("lang", "gram").collect():
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


class Grams(dict):
    """Number of each n-gram seen, with its rank in all profiles and its place among equally frequent ones by number."""

    def __init__(self, places: list[dict[str, int]], top: int):
        self.places, self.top = places, top
        self.rank = np.empty((1024, len(places)), "int32")
        self.order = np.empty((1024, 2), "int64")

    def __missing__(self, gram: str) -> int:
        number = self[gram] = len(self)
        if number == len(self.order):
            self.rank = np.concatenate([self.rank, np.empty_like(self.rank)])
            self.order = np.concatenate([self.order, np.empty_like(self.order)])
        self.rank[number] = [place.get(gram, self.top) for place in self.places]
        self.order[number] = ordinal(gram)
        return number


class Spelled(dict):
    """Numbers of the n-grams of each word seen."""

    def __init__(self, numbers: Grams):
        self.numbers = numbers

    def __missing__(self, word: str) -> np.ndarray:
        found = grams(word)
        ids = self[word] = np.fromiter(map(self.numbers.__getitem__, found), "int32", len(found))
        return ids


class Ranker:
    """Out-of-place distances of texts to a set of profiles, with what a worker remembers between texts."""

    def __init__(self, profiles: dict[str, list[str]], top: int):
        self.names, self.top = sorted(profiles), top
        self.places = [{gram: i for i, gram in enumerate(profiles[name])} for name in self.names]
        self.forget()

    def forget(self) -> None:
        self.grams = Grams(self.places, self.top)
        self.words = Spelled(self.grams)

    def predict(self, text: str | None) -> tuple[str, float]:
        spoken = Counter(words(text.lower())) if text and self.names else None
        if not spoken:
            return "und", 0.0
        if len(self.words) > MEMO:
            self.forget()
        ids = list(map(self.words.__getitem__, spoken))
        sizes = np.fromiter(map(len, ids), "int64", len(ids))
        times = np.repeat(np.fromiter(spoken.values(), "int64", len(ids)), sizes)
        together = np.concatenate(ids)
        if 8 * len(together) > len(self.grams):  # counting in place beats sorting
            every = np.bincount(together, times)
            found = np.flatnonzero(every)
            count = every[found]
        else:
            found, where = np.unique(together, return_inverse=True)
            count = np.bincount(where, times)
        if len(found) > self.top:  # leave out what can't be among the first
            enough = count >= np.partition(count, -self.top)[-self.top]
            found, count = found[enough], count[enough]
        order = self.grams.order[found]
        best = found[np.lexsort((order[:, 1], order[:, 0], -count))[: self.top]]
        rank = self.grams.rank[best]
        off = np.abs(rank - np.arange(len(best))[:, None])
        off[rank >= self.top] = self.top
        far = off.sum(0)
        near = np.argsort(far, kind="stable")
        first, second = far[near[0]], far[near[1]] if len(near) > 1 else len(best) * self.top
        return self.names[near[0]], float(1 - first / second) if second else 0.0


def identify(docs: DataFrame, profiles: dict[str, list[str]], top: int = TOP, text: str = "text", into: str = "language") -> DataFrame:
    """docs with a struct column of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(profiles, top)
        for batch in batches:
            yield pd.DataFrame([ranker.predict(t) for t in batch], columns=["lang_pred", "score"])

    return docs.withColumn(into, predicted(F.col(text)))


def held_out(key: str = "doc_id"):
    """Whether a row may not be learned from: its crc32 modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those that are not held out."""
    profiles = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select(
        "doc_id", "held_out", "language.lang_pred", "language.score"
    )
