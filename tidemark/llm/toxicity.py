"""Toxicity by averaged subword embeddings under a linear softmax (operator 8).

A word is the bag of its character n-grams and itself, each hashed to one of BUCKETS vectors; a word's
vector is their mean, and a window's is the mean of its words'. Two class weights and the vectors are
trained together, in numpy, by Adagrad on the softmax loss. A misspelt word that was never seen still
shares most of its n-grams with one that was.

A toxic word in a long text would vanish in the mean of all words, so the mean is taken over sliding
windows of WINDOW words and a text scores as its most toxic window. Labels are of whole texts, therefore
training alternates: the first rounds take some windows of each text, later ones the window that scores
highest (and some others of the clean texts).

Because everything is linear, a word adds one number to its window: scoring sums these numbers.

Learned from at most DOCS labelled texts of each class (chosen by a hash of doc_id) and CHARS characters of
these in all (whole texts, chosen by a hash of doc_id and text). Rows that repeat teach once. Null labels, null
texts and held-out rows teach nothing; without labels of both classes every score is 0. Null and empty
texts, and those without a letter, have score 0.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, store, words

LENGTHS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIMENSIONS = 8
WINDOW = 8
#: Labelled documents of either class that the model learns from, at most (about).
DOCS = 3000
#: Characters of all these documents, at most (about): they go to the driver.
CHARS = 32_000_000
THRESHOLD = 0.3
#: Share of a word's subwords that training sees at a time, so that a part of a word must do.
KEEP = 0.4
#: Distinct words whose number a worker remembers.
MEMO = 200_000


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams."""
    marked = f"<{word}>".encode("utf-32-le", "surrogatepass")
    n = len(marked) // 4
    return [zlib.crc32(marked)  % BUCKETS] + [
        zlib.crc32(marked[4 * i : 4 * (i + k)], k) % BUCKETS for k in LENGTHS for i in range(n - k + 1)
    ]


def words_of(text: str) -> list[str]:
    """The words of a text; one that is repeated at once counts once, for saying it again makes it no worse."""
    return [word for word, _ in groupby(words(text.lower()))]


def held_out(key: str = "doc_id"):
    """Whether a row may not be learned from: its crc32 modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Sample:
    """The words of labelled texts as numbers, and each distinct word's buckets."""

    def __init__(self, texts: list[str], labels: list[int]):
        number: dict[str, int] = {}
        self.texts, self.labels = [], []
        for text, label in zip(texts, labels):
            ids = [number.setdefault(w, len(number)) for w in words_of(text)]
            if ids:
                self.texts.append(np.array(ids, "int32"))
                self.labels.append(label)
        self.labels = np.array(self.labels, "int64")
        buckets, sizes = array("i"), array("i")
        for word in number:
            found = subwords(word)
            buckets.extend(found)
            sizes.append(len(found))
        self.size, self.bucket = np.array(sizes, "int64"), np.array(buckets, "int32")
        self.start = np.cumsum(self.size) - self.size

    def parts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of these words one after another, and which of the words each is of."""
        size = self.size[words]
        of = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        return self.bucket[self.start[words][of] + at], of


def best_windows(scores: np.ndarray) -> np.ndarray:
    """Means of all windows of WINDOW words (one window where there are fewer)."""
    k = min(WINDOW, len(scores))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    return (total[k:] - total[:-k]) / k


def train(sample: Sample, rounds: int = 8, batch: int = 256, steps: int = 500, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float] | None:
    """(number that each bucket adds, bias), or None without both classes.

    Small samples take smaller batches and more rounds, so that there are about `steps` updates at least.
    """
    if len(set(sample.labels.tolist())) < 2:
        return None
    batch = min(batch, max(16, len(sample.texts) // 20))
    favour = min(8.0, max(1.0, (sample.labels == 0).sum() / (sample.labels == 1).sum()) ** 0.5)  # of the rarer class
    rounds = max(rounds, -(-steps * batch // (2 * len(sample.texts))))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype("float32") / 64
    weights, bias = np.zeros((DIMENSIONS, 2), "float32"), np.zeros(2, "float32")
    weights[:, 1] = draw.normal(0, 0.5, DIMENSIONS)
    weights[:, 0] = -weights[:, 1]
    square, square_w, square_b = np.full(BUCKETS, 1e-3, "float32"), np.full((DIMENSIONS, 2), 1e-3, "float32"), np.full(2, 1e-3, "float32")
    for turn in range(rounds):
        word_score = None
        if turn >= 2:
            number = vectors @ (weights[:, 1] - weights[:, 0])
            word_score = np.add.reduceat(number[sample.bucket], sample.start) / sample.size
        chosen: list[tuple[np.ndarray, int]] = []
        for words, label in zip(sample.texts, sample.labels):
            k, places = min(WINDOW, len(words)), len(words) - min(WINDOW, len(words)) + 1
            at = set(draw.integers(0, places, 4 if word_score is None else 1 - label).tolist())
            if word_score is not None:
                at.add(int(best_windows(word_score[words]).argmax()))
            chosen += [(words[i : i + k], label) for i in at]
        for some in np.array_split(draw.permutation(len(chosen)), max(1, len(chosen) // batch)):
            size = np.array([len(chosen[i][0]) for i in some])
            words = np.concatenate([chosen[i][0] for i in some])
            y = np.array([chosen[i][1] for i in some])
            window = np.repeat(np.arange(len(some)), size)
            bucket, of = sample.parts(words)
            kept = draw.random(len(of)) < KEEP  # the others count as subwords that nobody knows
            kept[np.append(True, window[of][1:] != window[of][:-1])] = True  # no window without any
            bucket, of = bucket[kept], of[kept]
            share = (1 / sample.size[words] / size[window]).astype("float32")[of]
            row = window[of]
            starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(some)))])[:-1]
            mean = np.add.reduceat(vectors[bucket] * share[:, None], starts)
            z = mean @ weights + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= np.where(y == 1, favour, 1)[:, None]
            step = p @ weights.T
            grad_w, grad_b = mean.T @ p / len(y), p.mean(0)
            square_w += grad_w**2
            square_b += grad_b**2
            weights -= 0.2 * rate * grad_w / np.sqrt(square_w)
            bias -= 0.2 * rate * grad_b / np.sqrt(square_b)
            order = np.argsort(bucket, kind="stable")
            hit, first = np.unique(bucket[order], return_index=True)
            grad = np.add.reduceat((step[row] * share[:, None])[order], first)
            square[hit] += (grad**2).mean(1)
            vectors[hit] -= rate * grad / np.sqrt(square[hit])[:, None]
    return (vectors @ (weights[:, 1] - weights[:, 0])).astype("float32"), float(bias[1] - bias[0])


class Numbers(dict):
    """What each word adds to its window."""

    def __init__(self, buckets: np.ndarray):
        self.buckets = buckets

    def __missing__(self, word: str) -> float:
        number = self[word] = float(self.buckets[subwords(word)].mean())
        return number


def learn(docs: DataFrame, labels: DataFrame, most: int = DOCS, chars: int = CHARS) -> tuple[np.ndarray, float] | None:
    """A model from the labelled documents that are not held out; a document with several labels counts as toxic if one says so."""
    # ids has about 2 * most rows at any size of the corpus
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = sampled(marks.where(~held_out()).select(F.col("doc_id"), F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")), "toxic", "doc_id", most)
    known = store(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"]))
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    share = F.pmod(F.xxhash64(F.lit("chars"), "doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003)
    rows = known.where(share * total <= chars).orderBy("doc_id", "text").select("text", "toxic").toPandas()
    return train(Sample(rows["text"].tolist(), rows["toxic"].tolist()))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the probability of being toxic of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        memo = Numbers(known[0]) if known else {}
        for batch in batches:
            out = np.zeros(len(batch))
            for i, value in enumerate(batch):
                words = words_of(value) if value and known else None
                if not words:
                    continue
                best = best_windows(np.fromiter(map(memo.__getitem__, words), "float64", len(words))).max() + known[1]
                out[i] = 1 / (1 + np.exp(-np.clip(best, -500, 500)))
                if len(memo) > MEMO:
                    memo.clear()
            yield pd.Series(out)

    return docs.withColumn(into, scored(F.col(text)))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels)
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
