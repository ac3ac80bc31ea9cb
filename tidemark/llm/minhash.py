"""Near-duplicate documents by consistent weighted sampling (operator 3).

A document is a weighted set: its shingles of five words (\\w+, lower case), each with its term frequency times
its inverse document frequency, ln(documents / documents with the shingle) + 1. Frequencies are counted exactly, over all
documents; only what is rarer than 1 in 10,000 documents counts as being in 1 in 10,000, so up to 10,000 documents every
weight is its own, and beyond that the numbers needed stay bounded, however large the corpus: at most (distinct shingles
per document) / RARE, and never more than MOST. These shingles are found in two passes. The first counts all shingles
in BUCKETS buckets, the second those of buckets that reach the bound, exactly.

Improved consistent weighted sampling draws BANDS x ROWS samples of each set; two sets agree in a sample
with probability equal to their weighted Jaccard similarity. Documents that share a band and agree in AGREE
of all samples are candidates: of pairs as similar as asked, sampling finds 99.98 in 100 by their bands, and
fewer than one in 10^11 agree in too few samples.

In each bucket every document is first verified against the least; verified links give components. Where a
bucket still holds several components, the pairs across them are verified too: in small buckets by a join,
in those of more than SMALL documents as matrices, in blocks of about BLOCK documents, of which a task
returns a spanning forest of the links, not the pairs. So a large group of near copies costs neither a row
for each pair nor one task, and no link between components is lost.

Equal texts are one class without sampling. Null texts, texts without a word and rows without a doc_id
are alike nothing (but equal texts without a word are equal). Texts of fewer than five words have one
shingle, all of them. Repeated rows get equal classes.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store
from .graph import components

WORD = re.compile(r"\w+")
SHINGLE = 5
BANDS, ROWS = 12, 3
SIMILAR = 0.8
#: Share of the documents below which a shingle's frequency no longer changes its weight, and shingles that can have a number of their own.
RARE, MOST = 1e-4, 1 << 22
#: Counters of the first pass, how many of them travel together, and characters that a task cuts into words at a time.
BUCKETS, CHUNK, PORTION = 1 << 24, 1 << 14, 1_000_000
TABLE_BITS = 14
#: Samples that candidates must agree in.
AGREE = 10
#: Documents of a bucket whose pairs are joined; of a block beyond that; and features that are multiplied at a time.
SMALL, BLOCK, FEATURES = 24, 768, 1024
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point, whether it belongs to words, and a 64-bit hash."""
    known = np.zeros(sys.maxunicode + 1, bool)
    for found in WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        known[found.start() : found.end()] = True
    return known, mixed(np.arange(1, sys.maxunicode + 2, dtype="uint64"))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64, and their inverses."""
    out = []
    for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
        factors = np.full(n, base, "uint64")
        factors[0] = 1
        out.append(np.cumprod(factors))
    return tuple(out)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of these texts one after another, and how many each text has."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    known, value = characters()
    inside = known[points]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view("int8"), [0]])))
    begin, end = edge[::2], edge[1::2]
    power, inverse = powers(1 << max(20, len(points).bit_length()))
    total = np.concatenate([np.zeros(1, "uint64"), np.cumsum(value[points] * power[: len(points)], dtype="uint64")])
    ends = np.cumsum([len(t) + 1 for t in lower])
    return mixed((total[end] - total[begin]) * inverse[begin]), np.diff(np.searchsorted(begin, np.append(0, ends)))


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of these texts one after another, and how many each text has."""
    words, n = word_hashes(texts)
    first = np.cumsum(n) - n
    whole = max(0, len(words) - SHINGLE + 1)
    key = np.zeros(whole, "uint64")
    for i in range(SHINGLE):
        key = key * _U(0x9E3779B97F4A7C15) + words[i : i + whole]
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    out = np.zeros(len(at), "uint64")
    long = np.repeat(n >= SHINGLE, many)
    out[long] = key[at[long]]
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):  # all of a short text is one shingle
        short = 0
        for h in words[first[i] : first[i] + n[i]].tolist():
            short = (short * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
        out[int(many[:i].sum())] = short
    return mixed(out), many


def portions(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Parts of about PORTION characters (or one text), and where each begins."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= PORTION:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


class Weights:
    """Weighted sets of texts, given the frequent shingles in order, their idf, and the idf of all others."""

    _last: tuple = (None, None)

    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray, float]):
        self.key, self.idf, self.most = lexicon
        self.maybe = np.zeros(BUCKETS, bool)
        self.maybe[self.key & _U(BUCKETS - 1)] = True

    @classmethod
    def of(cls, lexicon: tuple[np.ndarray, np.ndarray, float]) -> Weights:
        """Those of a lexicon; made once while a worker has the same."""
        if cls._last[0] is not lexicon:
            cls._last = (lexicon, cls(lexicon))
        return cls._last[1]

    def sets(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct shingles of each text in order of their hash, and their weights."""
        for _, some in portions(texts):
            keys, many = shingle_hashes(some)
            for part in np.split(keys, np.cumsum(many)[:-1]):
                key, times = np.unique(part, return_counts=True)
                weight = times.astype("float32") * np.float32(self.most)
                known = np.flatnonzero(self.maybe[key & _U(BUCKETS - 1)])
                if len(known):
                    at = np.searchsorted(self.key, key[known]).clip(max=len(self.key) - 1)
                    hit = self.key[at] == key[known]
                    weight[known[hit]] = times[known[hit]] * self.idf[at[hit]]
                yield key, weight

    def shingles(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return next(self.sets([text]))


def crowded(texts: DataFrame, least: float) -> np.ndarray:
    """Which buckets of shingles reach a count over all texts, eight to a byte. A bucket counts every shingle in it, so none of `least` texts is missed."""

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, "uint32")
        for batch in batches:
            for _, some in portions(batch["text"].tolist()):
                np.add.at(total, (shingle_hashes(some)[0] & _U(BUCKETS - 1)).astype("int64"), 1)
        for i, part in enumerate(np.split(total, max(1, BUCKETS // CHUNK))):
            if most := part.max():
                kind = "u1" if most < 256 else "u4"
                yield pd.DataFrame({"chunk": [i], "kind": [kind], "counts": [zlib.compress(part.astype(kind).tobytes(), 1)]})

    def summed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, kind, counts in zip(batch["chunk"], batch["kind"], batch["counts"]):
                part = np.frombuffer(zlib.decompress(counts), kind).astype("int64")
                total[chunk] = total[chunk] + part if chunk in total else part
        for chunk, counts in total.items():
            yield pd.DataFrame({"chunk": [chunk], "held": [np.packbits(counts >= least).tobytes()]})

    found = texts.select("text").mapInPandas(counted, "chunk int, kind string, counts binary").repartition("chunk").mapInPandas(summed, "chunk int, held binary").toPandas()
    out, size = np.zeros(BUCKETS // 8, "u1"), min(BUCKETS, CHUNK) // 8
    for chunk, held in zip(found["chunk"], found["held"]):
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(held, "u1")
    return out


def lexicon(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The shingles in at least RARE of the documents in order of their hash, their idf, and the idf of all others.

    Should texts be so long that over MOST shingles are that frequent, the bound rises until no more are. The idf of
    the others is that of a shingle at the bound, or in one document where the bound is lower.
    """
    texts = docs.where("text is not null")
    n = texts.count()
    bound = max(1.0, RARE * n)
    least = max(2.0, bound)
    maybe = docs.sparkSession.sparkContext.broadcast(crowded(texts, least))

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crowd = np.unpackbits(maybe.value).astype(bool)
        for batch in batches:
            for _, some in portions(batch["text"].tolist()):
                key, many = shingle_hashes(some)
                held = crowd[key & _U(BUCKETS - 1)]
                key, owner = key[held], np.repeat(np.arange(len(many)), many)[held]
                order = np.lexsort((key, owner))
                key, owner = key[order], owner[order]
                new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[: len(key)]
                key, times = np.unique(key[new], return_counts=True)
                yield pd.DataFrame({"shingle": key.view("int64"), "n": times})

    frequent = store(texts.select("text").mapInPandas(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    while (many := frequent.count()) > MOST:
        bound = 1.0 + max(bound, frequent.agg(F.percentile_approx("n", 1 - MOST / many)).first()[0])
        frequent = frequent.where(F.col("n") >= bound)
    rows = frequent.toPandas()  # at most MOST
    key = rows["shingle"].to_numpy("int64").view("uint64")
    order = np.argsort(key)
    idf = np.log(max(n, 1) / rows["n"].to_numpy("float64")[order]) + 1
    return key[order], idf.astype("float32"), float(np.log(max(n, 1) / bound) + 1)


def sampler(seed: int = 11) -> tuple[np.ndarray, ...]:
    """Multipliers of the samples, and tables of the gamma and uniform variates that sampling draws by hash."""
    draw = np.random.default_rng(seed)
    odd = draw.integers(0, 1 << 63, BANDS * ROWS, dtype="uint64") * _U(2) + _U(1)
    size = 1 << TABLE_BITS
    r, c, beta = draw.gamma(2, 1, size), draw.gamma(2, 1, size), draw.uniform(0, 1, size)
    return odd, r.astype("float32"), (1 / r).astype("float32"), beta.astype("float32"), np.log(c).astype("float32")


def drawn(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """BANDS x ROWS samples (32 bits each) of every set; the sets' elements stand one after another."""
    odd, r, inverse, beta, log_c = tables
    log_w = np.log(weights)
    out = np.empty((len(starts), len(odd)), "uint64")
    mask = _U((1 << TABLE_BITS) - 1)
    for k, factor in enumerate(odd):
        x = keys * factor
        i = (x >> _U(64 - TABLE_BITS)).astype("int64")
        j = ((x >> _U(64 - 2 * TABLE_BITS)) & mask).astype("int64")
        b = beta[i]
        t = np.floor(log_w * inverse[i] + b)
        a = log_c[j] - r[i] * (t - b + np.float32(1))
        bits = a.astype("float32").view("uint32")
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype("uint64")
        name = (x ^ (t.astype("int64").view("uint64") * _U(0x9E3779B97F4A7C15))) >> _U(20) & _U(0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat((bits << _U(32)) | name, starts)
    return out & _U(0xFFFFFFFF)


def banded(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    parts = samples.reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype="uint64"), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mixed(key * _U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view("int64")


def sketched(docs: DataFrame, shingles: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, the two halves of the text's 128-bit hash, total weight, band keys and samples of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(shingles)

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, tables = Weights.of(shared.value), sampler()
        for batch in batches:
            n = len(batch)
            bands: list = [[]] * n
            samples: list = [[]] * n
            total, names = np.zeros(n), np.zeros((n, 2), "int64")
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush() -> None:
                if held:
                    sizes = np.array([len(k) for _, k, _ in held])
                    keys, weights = (np.concatenate([x[j] for x in held]) for j in (1, 2))
                    found = drawn(keys, weights, np.cumsum(sizes) - sizes, tables)
                    for (i, _, some), b, x in zip(held, banded(found), found.astype("uint32").view("int32")):
                        bands[i], samples[i], total[i] = b, x, some.sum(dtype="float64")
                    held.clear()

            waiting, texts = 0, batch["text"].tolist()
            for i, (text, (key, weight)) in enumerate(zip(texts, weights.sets(texts))):
                if text is None:
                    continue
                names[i] = np.frombuffer(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), "int64")
                if len(key):
                    held.append((i, key, weight))
                    waiting += len(key)
                if waiting > 8192:
                    flush()
                    waiting = 0
            flush()
            missing = batch["text"].isna().to_numpy()
            h1, h2 = (pd.Series(names[:, j]).astype("Int64").mask(missing) for j in (0, 1))
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "h1": h1, "h2": h2, "total": total, "bands": bands, "samples": samples})

    return docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(
        rows, "doc_id long, h1 long, h2 long, total double, bands array<long>, samples array<int>"
    )


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (ordered hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(a[0], b[0]).clip(max=len(a[0]) - 1)
    both = a[0][at] == b[0]
    shared = np.minimum(a[1][at[both]], b[1][both]).sum(dtype="float64")
    return float(shared / (a[1].sum(dtype="float64") + b[1].sum(dtype="float64") - shared))


def verified(pairs: DataFrame, docs: DataFrame, shingles: tuple[np.ndarray, np.ndarray, float], similar: float) -> DataFrame:
    """Those pairs (a, b) whose texts are at least as similar as asked."""
    shared = docs.sparkSession.sparkContext.broadcast(shingles)
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    with_b = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    with_both = with_b.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")

    def kept(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, last, mine = Weights.of(shared.value), None, None
        for batch in batches:
            keep, texts = [], batch["text_b"].tolist()
            for a, text_a, other in zip(batch["a"], batch["text_a"], weights.sets(texts)):
                if a != last:
                    last, mine = a, weights.shingles(text_a)
                keep.append(similarity(mine, other) >= similar)
            yield batch.loc[keep, ["a", "b"]]

    return with_both.select("a", "b", "text_a", "text_b").mapInPandas(kept, "a long, b long")


def agreeing(a: Column, b: Column) -> Column:
    """Whether two arrays of samples agree in AGREE places."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) >= AGREE


def forest(ids_a: np.ndarray, ids_b: np.ndarray, linked: np.ndarray, joined: dict[int, int]) -> list[tuple[int, int]]:
    """Links that join what is not joined yet; joined is changed."""

    def top(x: int) -> int:
        while joined.setdefault(x, x) != x:
            joined[x] = joined[joined[x]]
            x = joined[x]
        return x

    out = []
    for i in np.flatnonzero(linked.any(1)):
        a = int(ids_a[i])
        for b in ids_b[linked[i]].tolist():
            one, other = top(a), top(b)
            if one != other:
                joined[max(one, other)] = min(one, other)
                out.append((a, b))
    return out


def halves(part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two blocks that a task compares; the same one twice inside a block."""
    one, other = part["b1"].iloc[0], part["b2"].iloc[0]
    return part[part["block"] == one], part[part["block"] == other]


def worth_comparing(part: pd.DataFrame) -> pd.DataFrame:
    """key and doc_id of the documents that agree in AGREE samples with one of another component."""
    a, b = halves(part)
    if not len(a) or not len(b):
        return pd.DataFrame({"key": [], "doc_id": []}).astype("int64")
    x, y = np.stack(a["samples"].to_numpy()), np.stack(b["samples"].to_numpy())
    same = np.zeros((len(a), len(b)), "uint8")
    for k in range(x.shape[1]):
        same += x[:, k, None] == y[None, :, k]
    near = (same >= AGREE) & (a["component"].to_numpy()[:, None] != b["component"].to_numpy()[None, :])
    ids = np.unique(np.concatenate([a["doc_id"].to_numpy()[near.any(1)], b["doc_id"].to_numpy()[near.any(0)]]))
    return pd.DataFrame({"key": np.full(len(ids), part["key"].iloc[0]), "doc_id": ids})


def shared_weight(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of the lesser weights of each two sets, as a product of matrices.

    A shingle with several weights counts once for each step between them, in every set that reaches the step.
    """
    n = len(sets)
    out = np.zeros((n, n))
    sizes = [len(k) for k, _ in sets]
    if not sum(sizes):
        return out
    key, weight = (np.concatenate([x[i] for x in sets]) for i in (0, 1))
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((weight, key))
    key, weight, owner = key[order], weight[order].astype("float64"), owner[order]
    new_key = np.append(True, key[1:] != key[:-1])
    new_step = new_key | np.append(True, weight[1:] != weight[:-1])
    step = np.cumsum(new_step) - 1  # number of each entry's step; the steps of a key follow each other
    first = step[np.maximum.accumulate(np.where(new_key, np.arange(len(key)), 0))]
    low = np.where(new_key[new_step], 0.0, np.append(0.0, weight[new_step][:-1]))
    height = weight[new_step] - low
    reach = step - first + 1
    at = np.repeat(np.arange(len(key)), reach)
    feature = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach)
    holder = owner[at]
    common = np.bincount(feature) > 1
    number = np.cumsum(common) - 1
    kept = common[feature]
    feature, holder, height = number[feature[kept]], holder[kept], height[common]
    by = np.argsort(feature, kind="stable")
    feature, holder = feature[by], holder[by]
    for low_f in range(0, len(height), FEATURES):
        i, j = np.searchsorted(feature, (low_f, low_f + FEATURES))
        marks = np.zeros((n, min(FEATURES, len(height) - low_f)))
        marks[holder[i:j], feature[i:j] - low_f] = 1
        out += (marks * height[low_f : low_f + FEATURES]) @ marks.T
    return out


def blocked(rows: DataFrame) -> DataFrame:
    """rows (key, doc_id, ...) dealt out for comparing each two blocks of a key: block, b1 and b2."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    return (
        rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.col("_blocks")).cast("int"))
        .withColumn("_mate", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("b1", F.least("block", "_mate")).withColumn("b2", F.greatest("block", "_mate")).drop("_blocks", "_mate")
    )


def linked_in_blocks(members: DataFrame, docs: DataFrame, shingles: tuple[np.ndarray, np.ndarray, float], similar: float) -> DataFrame:
    """Links (a, b) across components among members (key, doc_id, component, samples) of large buckets."""
    asked = store(blocked(members).groupBy("key", "b1", "b2").applyInPandas(worth_comparing, "key long, doc_id long").distinct())
    shared = docs.sparkSession.sparkContext.broadcast(shingles)

    def compared(part: pd.DataFrame) -> pd.DataFrame:
        a, b = halves(part)
        both = a if part["b1"].iloc[0] == part["b2"].iloc[0] else pd.concat([a, b])
        sets = list(Weights.of(shared.value).sets(both["text"].tolist()))
        total = np.array([w.sum(dtype="float64") for _, w in sets])
        least = shared_weight(sets)
        ids, component = both["doc_id"].to_numpy(), both["component"].to_numpy()
        linked = (least >= similar * (total[:, None] + total[None, :] - least) - 1e-9) & (component[:, None] != component[None, :])
        return pd.DataFrame(forest(ids, ids, linked, {}), columns=["a", "b"]).astype("int64")

    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    rows = blocked(asked.join(members.select("key", "doc_id", "component"), ["key", "doc_id"])).join(texts, "doc_id")
    return rows.groupBy("key", "b1", "b2").applyInPandas(compared, "a long, b long")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and kept of every document."""
    shingles = lexicon(docs)
    sketches = store(sketched(docs, shingles))
    alike = store(
        sketches.where("h1 is not null").groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in ("total", "bands", "samples")])
    )
    buckets = alike.select("doc_id", F.explode("bands").alias("key"))
    # stored, so that the join after it can split the largest buckets
    heads = store(buckets.groupBy("key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = store(buckets.join(heads, "key"))
    sketch = alike.select("doc_id", "total", "samples")
    other = sketch.select(F.col("doc_id").alias("a"), F.col("total").alias("total_a"), F.col("samples").alias("samples_a"))
    near = (F.least("total", "total_a") >= F.greatest("total", "total_a") * (similar - 1e-6)) & agreeing(F.col("samples"), F.col("samples_a"))
    stars = store(
        members.where(F.col("doc_id") != F.col("head")).select(F.col("head").alias("a"), "doc_id").distinct()
        .join(other, "a").join(sketch, "doc_id").where(near).select("a", F.col("doc_id").alias("b"))
    )
    edges = store(verified(stars, docs, shingles, similar))
    parts = components(edges)
    labelled = members.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = labelled.where("n > 2").groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("key")
    unsettled = store(labelled.join(split, "key").join(sketch, "doc_id").select("key", "doc_id", "n", "component", "total", "samples"))
    few = unsettled.where(F.col("n") <= SMALL)
    mate = few.select("key", *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "component", "total", "samples")])
    across = (
        few.join(mate, (few["key"] == mate["key"]) & (F.col("doc_id_a") < F.col("doc_id")) & (F.col("component_a") != F.col("component")) & near)
        .select(F.col("doc_id_a").alias("a"), F.col("doc_id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    )
    many = unsettled.where(F.col("n") > SMALL).select("key", "doc_id", "component", "samples")
    more = store(verified(across, docs, shingles, similar).unionByName(linked_in_blocks(many, docs, shingles, similar)))
    every = components(edges.unionByName(more)) if more.take(1) else parts
    return (
        sketches.select("doc_id", "h1", "h2").join(alike.select("h1", "h2", F.col("doc_id").alias("first")), ["h1", "h2"], "left")
        .join(every.withColumnRenamed("node", "first"), "first", "left")
        .select("doc_id", F.coalesce("component", "first", "doc_id").alias("class_id"))
        .unionByName(docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("class_id")))
        .withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))
    )
