"""Operators 1, 3, 6 and 9, and the pipeline, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import fingerprints, minhash, repeats, toxicity, vectors
from tidemark.llm.graph import components


def unions(nodes, pairs):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == unions(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(docs, texts):
    rows = {r.doc_id: r for r in fingerprints.compared(docs).collect()}
    order = sorted(rows, reverse=True)
    of = {i * 3 + 1: t or "" for i, t in enumerate(texts)}
    seen = {}
    for doc, after in zip(order, order[1:] + order[:1]):
        text, n = of[doc], len(of[doc]) // 3
        edited = text[: len(text) - n] + of[after][:n]
        assert rows[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[doc].n_chars == len(text)
        assert seen.setdefault(text, rows[doc].fingerprint) == rows[doc].fingerprint
        own, other = rows[doc].fingerprint.split("."), rows[after].fingerprint.split(".")
        some = [(a, b) for a, b in zip(own, other) if (a, b) != ("-", "-")]
        assert rows[doc].near_next == pytest.approx(sum(a == b for a, b in some) / len(some) if some else 1.0)
        assert 0 <= rows[doc].near_edited <= 1


def test_fingerprint_band(spark):
    """Only terms inside the band count: a word in nearly all documents, or in one, changes nothing."""
    rows = [(i, f"common middle{i % 3} other{i % 4}") for i in range(40)] + [(90, "common middle1 other1 unique"), (91, "middle1 other1")]
    got = {r.doc_id: r.fingerprint for r in fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {"middle0", "middle2", "other0", "other1", "other2", "other3"}
    assert set(fingerprints.lexicon(spark.createDataFrame(rows, "doc_id long, text string"), common=0.34, rare=0.05)) == {xx64(w) for w in want}
    assert got[91] == got[1] == got[13]


def xx64(word):
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64(word.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def murmur(values):
    """Spark's hash of an int and an array of longs."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF

    def block(h, k):
        return (rot(h ^ (rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF

    def end(h, n):
        h ^= n
        h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ (h >> 16)

    h = end(block(42, values[0] & 0xFFFFFFFF), 4)
    for v in values[1]:
        h = end(block(block(h, v & 0xFFFFFFFF), (v >> 32) & 0xFFFFFFFF), 8)
    return h


def fingerprint_by_hand(text, band):
    """The fingerprint from the definition: sublexicon i holds the terms of which some bits are zero."""
    every = sorted({xx64(w) for w in regex.findall(r"[\p{L}\p{N}]+", text.lower())})
    kept = [t for t in every if t in band]
    out, i = [], 0
    for bits, many in fingerprints.SHARES:
        for _ in range(many):
            some = [t for t in kept if ((t & (2**64 - 1)) >> (23 * i % 56)) & ((1 << bits) - 1) == 0]
            some = some if bits or kept else every
            out.append(f"{murmur((i, some)):08x}" if some else "-")
            i += 1
    return out


def test_fingerprints_by_hand(docs, texts):
    """Every fingerprint, of texts and edited texts, and every likeness, from document frequencies counted in Python."""
    counts = Counter(w for t in texts for w in set(regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())))
    n = len(texts)
    band = {xx64(w) for w, c in counts.items() if n * fingerprints.RARE <= c <= max(1.0, n * fingerprints.COMMON)}
    rows = {r.doc_id: r for r in fingerprints.compared(docs).collect()}
    order = sorted(rows, reverse=True)
    of = {i * 3 + 1: t or "" for i, t in enumerate(texts)}

    def like(a, b):
        some = [(x, y) for x, y in zip(a, b) if (x, y) != ("-", "-")]
        return sum(x == y for x, y in some) / len(some) if some else 1.0

    for doc, after in zip(order, order[1:] + order[:1]):
        third = len(of[doc]) // 3
        own, other = fingerprint_by_hand(of[doc], band), fingerprint_by_hand(of[after], band)
        changed = fingerprint_by_hand(of[doc][: len(of[doc]) - third] + of[after][:third], band)
        assert rows[doc].fingerprint.split(".") == own and rows[doc].edited_fingerprint.split(".") == changed
        assert rows[doc].near_edited == pytest.approx(like(own, changed)) and rows[doc].near_next == pytest.approx(like(own, other))


def test_fingerprints_without_a_term_in_the_band(spark):
    """Rare words alone still tell texts apart; texts without words are alike."""
    rows = [(i, "some common words here") for i in range(400)] + [(1000, "qwertz"), (1001, "asdfgh"), (1002, "qwertz qwertz"), (1003, "..."), (1004, None)]
    got = {r.doc_id: r for r in fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000].fingerprint == got[1002].fingerprint != got[1001].fingerprint and got[1001].near_next == 0
    assert got[1004].near_next == 1.0 and set(got[1003].fingerprint) == {"-", "."}


def test_next_of_skewed_keys(spark):
    """A far-off doc_id, many missing ones and one in a third of the rows neither lose rows nor their order."""
    rows = [(i, f"t{i}") for i in range(1500)] + [(2**62, "far")] + [(None, f"n{i}") for i in range(700)] + [(77, "same")] * 1000
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    got = fingerprints.with_next(frame, ["text"], "tie").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in got) == sorted((d is not None, d or 0, t) for d, t in rows)
    assert Counter((r.next.doc_id, r.next.text) for r in got) == Counter(rows)
    place = sorted({d for d, _ in rows if d is not None}, reverse=True) + [None]
    for r in got:
        assert r.next.doc_id in (r.doc_id, place[(place.index(r.doc_id) + 1) % len(place)])


def test_next_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 4)
    ids = random.Random(1).sample(range(10_000), 300)
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").withColumn("_tie", F.lit(0))
    got = {r.doc_id: (r.next.doc_id, r.next.text) for r in fingerprints.with_next(rows, ["text"], "_tie").collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: (b, f"t{b}") for a, b in zip(order, order[1:] + order[:1])}


def test_fingerprints_are_native(docs, monkeypatch):
    """No plan on the whole way has Python in it: what is stored between, the lexicon, and the result."""
    plans, inner = [fingerprints.edited(docs)], fingerprints.store
    monkeypatch.setattr(fingerprints, "store", lambda df: plans.append(df) or inner(df))
    plans.append(fingerprints.compared(docs))
    assert len(plans) > 2
    for df in plans:
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_fingerprints_odd(odd, empty, spark):
    assert fingerprints.compared(odd).count() == 6
    assert fingerprints.compared(empty).count() == 0
    one = fingerprints.compared(spark.createDataFrame([(5, "abc def ghi")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abc def abc").hexdigest()


def weighted_sets(texts):
    """Shingles of each text with tf times idf, from counts in dictionaries."""
    sets = []
    for text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        sets.append(Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter())
    df, n = Counter(x for s in sets for x in s), sum(t is not None for t in texts)
    idf = {x: math.log(n / max(c, minhash.RARE * n)) + 1 for x, c in df.items()}
    return [{x: c * idf[x] for x, c in s.items()} for s in sets]


def likeness(a, b):
    shared = sum(min(w, b[x]) for x, w in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if shared else 0.0


def test_near_copies(docs, texts, monkeypatch):
    sets = weighted_sets(texts)
    ids = [i * 3 + 1 for i in range(len(texts))]
    pairs = [(i * 3 + 1, j * 3 + 1) for i in range(len(texts)) for j in range(i + 1, len(texts)) if likeness(sets[i], sets[j]) >= 0.8 or texts[i] == texts[j]]
    want = unions(ids, pairs)
    assert len(pairs) > 60
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == want
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == want


def test_shingles_of_portions(texts, monkeypatch):
    """Sets are those of plain Python, whatever portions the texts come in; short, empty and missing texts included."""
    some = [*texts[55:], "one", "Two words", None, "", "ÀÉ ß_x Σίσυφος ½ 12", "a b c d e", "a b c d e f"]
    want = weighted_sets(some)
    empty = (np.empty(0, "u8"), np.empty(0, "f4"), float(np.log(1 / minhash.RARE) + 1))
    for size in (1, 500, 10**6):
        monkeypatch.setattr(minhash, "PORTION", size)
        got = list(minhash.Weights(empty).sets(some))
        assert [len(k) for k, _ in got] == [len(s) for s in want] and all((np.diff(k.astype("f8")) >= 0).all() for k, _ in got)
        for (ka, wa), a in zip(got, want):
            for (kb, _), b in zip(got, want):
                assert len(np.intersect1d(ka, kb)) == len(a.keys() & b.keys())


@pytest.mark.parametrize("n", range(7))
def test_shingles_of_one_short_text(n):
    """A text of few words alone in its portion, as the first and as the second of two that are compared."""
    text = " ".join("abcdefg"[:n])
    keys, many = minhash.shingle_hashes([text])
    assert many.tolist() == [0 if n == 0 else max(1, n - 4)] and len(set(keys.tolist())) == many[0]
    assert np.array_equal(minhash.shingle_hashes([None, text, ""])[0], keys)


def test_near_copies_of_short_texts(spark, tmp_path):
    """Tables of one short text, of a text and the same in other letters, and the pipeline's stage over such texts."""
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in minhash.classes(one).collect()] == [(1, 1, True)]
    texts = [" ".join(letters[:n]) for n in range(1, 7) for letters in ("abcdef", "ABCDEF", "ghijkl")]
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, many, str(tmp_path)).collect()) == [i for i in range(18) if i % 3 != 1]


def test_frequent_shingles(spark):
    """Document frequencies are exact for every shingle that reaches the bound, and no other is listed."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices("a b c d".split(), k=rng.randint(3, 60))) for _ in range(400)] + ["x y z", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    key, idf, most = minhash.lexicon(rows)
    df = Counter(x for s in weighted_sets(texts) for x in s)
    want = sorted(math.log(401 / c) + 1 for c in df.values() if c >= 2)
    assert len(want) > 300 and abs(most - math.log(401) - 1) < 1e-6 and np.allclose(sorted(idf.tolist()), want, atol=1e-5) and (np.diff(key.astype("f8")) > 0).all()


def test_more_frequent_shingles_than_have_numbers(spark, monkeypatch):
    """The bound rises until the most frequent ones fit; all others share the idf at the bound."""
    monkeypatch.setattr(minhash, "MOST", 20)
    rows = spark.createDataFrame([(i, f"a b c d e f{i % 7} g{i % 40}") for i in range(400)] + [(400 + i, f"p{i // 2} q r s t u") for i in range(80)], "doc_id long, text string").repartition(4)
    key, idf, most = minhash.lexicon(rows)
    assert 0 < len(key) <= 20 and idf.max() <= most and abs(idf.min() - math.log(480 / 400) - 1) < 1e-6


def test_near_copies_recall(spark):
    """Pairs just above the threshold in a cluster and apart are found as brute force finds them."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(3000)]
    texts = []
    for _ in range(300):
        base = rng.choices(vocabulary, k=rng.randint(60, 160))
        texts.append(" ".join(base))
        for _ in range(rng.choice([1, 1, 1, 12])):
            near = list(base)
            for _ in range(rng.randint(0, max(1, len(near) // 50))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    sets = weighted_sets(texts)
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    near = {(a, b) for x in holders.values() for i, a in enumerate(x) for b in x[i + 1 :]}
    pairs = [p for p in near if likeness(sets[p[0]], sets[p[1]]) >= 0.8]
    want = unions(range(len(texts)), pairs)
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(pairs) > 500 and sum(got[i] != want[i] for i in want) <= 0.005 * len(want)


def test_similarity_by_hand():
    a, b = (np.array([1, 2, 5], "u8"), np.array([1.0, 2.0, 3.0], "f4")), (np.array([2, 5, 9], "u8"), np.array([1.0, 4.0, 1.0], "f4"))
    assert minhash.similarity(a, b) == pytest.approx((1 + 3) / (1 + 2 + 4 + 1))
    assert minhash.shared_weight([a, b])[0, 1] == pytest.approx(4)


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    tables = minhash.sampler()
    same = total = 0
    want = []
    for _ in range(60):
        key = rng.integers(0, 2**63, 120).astype("u8")
        w = rng.uniform(1, 8, 120).astype("f4")
        a, b = (np.sort(key[:100]), w[:100]), (key[20:], w[20:] * rng.choice([1, 1.5], 100).astype("f4"))
        order = np.argsort(b[0])
        b = (b[0][order], b[1][order])
        ai = np.argsort(key[:100])
        a = (key[:100][ai], w[:100][ai])
        x, y = (minhash.drawn(k, v, np.array([0]), tables)[0] for k, v in (a, b))
        same, total = same + (x == y).sum(), total + len(x)
        want.append(minhash.similarity(a, b))
    assert same / total == pytest.approx(np.mean(want), abs=0.05)


def test_near_copies_odd(odd, empty):
    got = [(r.doc_id, r.class_id, r.kept) for r in minhash.classes(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 2, True), (3, 3, True), (4, 1, False)], key=str)
    assert minhash.classes(empty).count() == 0


def vectors_of(rng, n):
    base = rng.normal(size=(n // 5, 16))
    out = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, 16)) * rng.choice([0.02, 0.1, 0.5], (n, 1))
    return out.astype("float32")


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = vectors_of(rng, 600)
    label = rng.integers(0, 3, 600)
    rows = [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = vectors.unit(x.astype("float64"))
    linked = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    for block in (1024, 7):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
        found = sum(r.n_links for r in got.values())
        assert 0.97 * linked.sum() <= found <= linked.sum()
        assert all(got[i].n_links <= linked[i].sum() for i in got)
        if found == linked.sum():
            want = unions(range(600), zip(*np.nonzero(linked)))
            assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def planted(rng, n, dim=64):
    """n random vectors of one label and n more, each at a cosine of 0.932 to 0.96 to one of them."""
    a = vectors.unit(rng.normal(size=(n, dim)))
    z = rng.normal(size=(n, dim))
    z = vectors.unit(z - (z * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.932, 0.96, (n, 1))
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * z])


@pytest.mark.parametrize("n", [500, 5000])
def test_vectors_recall(spark, n):
    """At least 0.99 of planted links near the threshold are found, and the lists that a vector goes to do not grow with the rows."""
    x = planted(np.random.default_rng(6), n)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = vectors.unit(x)
    want = np.concatenate([(u[i : i + 1000] @ u.T >= 0.93).sum(1) - 1 for i in range(0, len(u), 1000)])
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame).collect()}
    assert sum(want) >= 2 * n and 0.99 * sum(want) <= sum(got.values()) and all(got[i] <= want[i] for i in got)
    known = vectors.described(frame.withColumn("copies", F.lit(1)), vectors.points(frame))
    assert known.select(F.explode("near").alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] <= vectors.BLOCK  # so each goes to NEAREST blocks


def test_vectors_of_which_a_third_are_copies(spark):
    """Copies count as links, and do not crowd out the reference points."""
    rng = np.random.default_rng(9)
    x = planted(rng, 600, 16)
    x = np.concatenate([x, np.repeat(x[:1], 600, 0)])
    order = rng.permutation(len(x))
    x = x[order]
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = vectors.unit(x)
    linked = u @ u.T >= 0.93
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
    copies = [i for i in range(len(x)) if order[i] == 0 or order[i] >= 1200]
    assert sum(r.n_links for r in got.values()) >= 0.99 * linked.sum() and all(r.n_links <= linked[i].sum() for i, r in got.items())
    assert all(got[i].n_links >= 600 and got[i].component_id == got[copies[0]].component_id for i in copies)


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
        (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1e30, 1e29], 1), (12, [3.0, 0.0], 1), (12, [3.0, 0.0], 1), (12, [0.0, 1.0], None), (13, [], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("near", F.lit(1)).withColumn("point", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()}
    assert len(got) == 13
    assert {k: v for k, v in got.items() if v[0]} == {1: (3, 1), 2: (3, 1), 11: (3, 1), 12: (3, 1)}
    assert all(v == (0, k) for k, v in got.items() if k not in (1, 2, 11, 12))
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("letters", [b"ab", b"abc", bytes(range(256))])
def test_suffix_array(letters):
    rng = random.Random(3)
    for size in (0, 1, 2, 50, 2000):
        data = bytes(rng.choice(letters) for _ in range(size))
        got = repeats.suffix_array(np.frombuffer(data, "u1"), 100).tolist()
        assert [data[i : i + 100] for i in got] == sorted(data[i : i + 100] for i in range(size)) and sorted(got) == list(range(size))
    runs = b"a" * 700 + b"b" * 300 + b"\0" * 200 + b"a" * 500
    got = repeats.suffix_array(np.frombuffer(runs, "u1"), 100)
    assert [runs[i : i + 100] for i in got] == sorted(runs[i : i + 100] for i in range(len(runs)))


def removed(items):
    """doc_id -> which bytes go, by a set of all windows seen."""
    seen, out = set(), {}
    for doc, text in sorted(items):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        out[doc] = (data, gone)
    return out


def test_repeats(docs, texts):
    want = removed([(i * 3 + 1, t or "") for i, t in enumerate(texts)])
    assert sum(g.sum() for _, g in want.values()) > 5000
    for r in repeats.digests(docs).collect():
        data, gone = want[r.doc_id]
        kept = bytes(np.frombuffer(data, "u1")[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), gone.sum(), runs, hashlib.sha256(kept).hexdigest())


def test_segments_depend_on_their_text_alone(texts):
    """Texts are cut together, in sections that end anywhere, and each of them as if it were alone."""
    some = [(t or "").encode() for t in texts] * 5
    data, sizes = np.frombuffer(b"".join(some), "u1"), np.array([len(t) for t in some])
    assert len(data) > 3 * repeats.SECTION
    text, anchor, first, windows, _ = repeats.segments_of(data, sizes)
    alone = [repeats.segments(np.frombuffer(t, "u1")) for t in some]
    assert text.tolist() == np.repeat(np.arange(len(some)), [len(p[0]) for p in alone]).tolist()
    assert all(got.tolist() == np.concatenate([p[i] for p in alone]).tolist() for i, got in ((0, anchor), (2, first), (3, windows)))
    n = np.bincount(text, windows, len(some))
    assert n.tolist() == np.maximum(0, sizes - 99).tolist() and windows.max() <= 69


def test_ranges_known_to_repeat_are_joined():
    """A copy in the same portion of texts goes on as one range, not as one row for each of its segments."""
    rng = random.Random(12)
    text = "".join(rng.choices("abcdefgh ", k=5000)).encode()
    anchor, _, first, windows = repeats.segments(np.frombuffer(text, "u1"))
    part = {"text": text, "spans": (first << repeats.SPAN_BITS) + windows + 99, "anchors": anchor.view("int64"), "salts": np.ones(len(first), "int32")}
    got = pd.concat(repeats.taken(iter([pd.DataFrame([{"doc_id": i, repeats.COPY: 7, **part} for i in (4, 2, 9)])])))
    sent, known = got[got["bytes"].notna()], got[got["bytes"].isna()]
    assert sent["doc_id"].tolist() == [2] * len(first) and len(first) > 50
    assert sorted(zip(known["doc_id"], known["span"])) == [(4, 5000), (9, 5000)]
    long = np.arange(0, 3 << repeats.SPAN_BITS, 50)
    doc, _, span = repeats.merged(np.full(len(long), 3), np.full(len(long), 7), (long << repeats.SPAN_BITS) + 100)
    assert len(doc) == 6 and repeats.covered(int(long[-1]) + 150, span).sum() == long[-1] + 100


def test_repeats_of_hot_anchors(docs, texts):
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = known.withColumn(repeats.COPY, F.xxhash64("text"))
    plain = {r.doc_id: repeats.covered(40_000, r.spans).tobytes() for r in repeats.spans(known).collect()}
    hot = {r.doc_id: repeats.covered(40_000, r.spans).tobytes() for r in repeats.spans(known, group=1).collect()}
    assert plain == hot and plain


def test_repeats_of_one_hot_passage(spark, monkeypatch):
    """A passage between ever new neighbours goes to no suffix sort as a group far beyond the size asked for."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    items = [(i, "".join(rng.choices("ijklmnop ", k=150)) + passage + "".join(rng.choices("qrstuvwx ", k=150))) for i in range(60)]
    inner = repeats.sorted_windows

    def bounded(part):
        assert part.groupby(["key", "salt"]).size().max() <= 15
        return inner(part)

    cloudpickle.register_pickle_by_value(repeats)
    try:
        monkeypatch.setattr(repeats, "sorted_windows", bounded)
        rows = spark.createDataFrame(items, "doc_id long, text string").repartition(30).withColumn(repeats.COPY, F.xxhash64("text"))
        got = {r.doc_id: repeats.covered(600, r.spans).tobytes() for r in repeats.spans(rows, group=5).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(repeats)
    assert got == {doc: gone.tobytes() for doc, (_, gone) in removed(items).items() if gone.any()} and len(got) == 59


def test_repeats_of_equal_texts_in_many_partitions(spark, monkeypatch):
    """Equal texts, the commonest repeat, are dealt out as well: no group of a task is far beyond the size asked for."""
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefgh ", k=400))
    items = [(i, text) for i in range(80)] + [(100, "tail " + text)]
    inner = repeats.repeated

    def bounded(part):
        assert not len(part) or part.groupby(["key", "salt"]).size().max() <= 25
        return inner(part)

    cloudpickle.register_pickle_by_value(repeats)
    try:
        monkeypatch.setattr(repeats, "repeated", bounded)
        rows = spark.createDataFrame(items, "doc_id long, text string").repartitionByRange(81, "doc_id").withColumn(repeats.COPY, F.xxhash64("text"))
        got = {r.doc_id: repeats.covered(405, r.spans).tobytes() for r in repeats.spans(rows, group=8).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(repeats)
    assert len(got) == 80 and 0 not in got and all(sum(got[i]) == 400 for i in (*range(1, 80), 100))
    assert {repeats.salted(i, 5, 7) for i in range(50)} == {repeats.salted(5, i, 7) for i in range(50)} == set(range(7))


@pytest.mark.parametrize("group", [1, repeats.GROUP])
def test_repeats_of_repeated_rows(spark, group):
    """A row that occurs twice is cut like one: what it says first stays."""
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    items = [(i, "".join(rng.choices("ijklmnop ", k=150)) + passage + "".join(rng.choices("qrstuvwx ", k=150))) for i in range(6)]
    want = {doc: gone.tobytes() for doc, (_, gone) in removed(items).items() if gone.any()}
    rows = spark.createDataFrame([items[0], *items, items[3], items[0]], "doc_id long, text string").repartition(4)
    spans = repeats.spans(rows.withColumn(repeats.COPY, F.xxhash64("text")), group=group)
    assert {r.doc_id: repeats.covered(600, r.spans).tobytes() for r in spans.collect()} == want
    kept = {doc: hashlib.sha256(bytes(np.frombuffer(data, "u1")[~gone])).hexdigest() for doc, (data, gone) in removed(items).items()}
    got = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in repeats.digests(rows).collect())
    assert got == sorted((i, sum(want.get(i, b"")), kept[i]) for i in (0, *range(6), 3, 0))


def test_repeats_of_a_doc_id_with_two_texts(spark):
    """Texts that share a doc_id are cut each by itself, and the one with the lesser hash is the earlier."""
    rng = random.Random(10)
    p, q, shared = ("".join(rng.choices("abcdefgh ", k=419)) for _ in range(3))
    items = [(0, p), (1, p), (1, q), (2, "x" + q), (3, shared + p[:50]), (3, "y" + shared)]
    rows = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    order = {(r.doc_id, r.text): r.h for r in rows.withColumn("h", F.xxhash64("text")).collect()}
    ranked = sorted(items, key=lambda x: (x[0], order[x]))
    gone = {ranked[i]: sum(g) for i, (_, g) in removed([(i, t) for i, (_, t) in enumerate(ranked)]).items()}
    assert gone[1, q] == 0 and gone[1, p] == 419 and gone[2, "x" + q] == 419
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in repeats.digests(rows).collect()]
    assert sorted(got) == sorted((d, len(t), gone[d, t]) for d, t in items)


def test_repeats_of_a_window_in_very_many_contexts(spark):
    """100,000 texts hold one passage between neighbours of their own; it stays in the first of them alone."""
    n, passage = 100_000, "the same words in every single one of these texts, " * 2 + "which is a little more than one hundred bytes"
    rows = spark.range(0, n, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.md5(F.col("id").cast("string").cast("binary")), F.lit(passage), F.md5((-F.col("id")).cast("string").cast("binary"))).alias("text"))
    got = {r.doc_id: r.n_removed for r in repeats.digests(rows).select("doc_id", "n_removed").collect()}
    left, right, want = set(), set(), {}
    for i in range(n):  # how far its neighbours on either side are those of an earlier text
        before, after = hashlib.md5(str(i).encode()).hexdigest(), hashlib.md5(str(-i).encode()).hexdigest()
        far = max((k for k in range(1, 20) if before[-k:] in left), default=0) + max((k for k in range(1, 20) if after[:k] in right), default=0)
        want[i] = len(passage) + far if i else 0
        left.update(before[-k:] for k in range(1, 20))
        right.update(after[:k] for k in range(1, 20))
    assert got == want


def test_repeats_of_a_long_text(spark):
    """A text longer than a section, with a passage said again at its end and over a section's border."""
    rng = random.Random(12)
    start = "".join(rng.choices("abcdefghijklmnop ", k=200_000))
    text = start * 21 + start[:5000] + "é" + start[1000:2000]
    (row,) = repeats.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    # the first start stays, and the 99 bytes that lead from its end to the second are windows of their own once
    assert len(text.encode()) > repeats.SECTION and row.n_bytes == len(text.encode())
    assert row.n_removed == 20 * 200_000 + 5000 + 1000 and row.n_spans == 2


def test_repeats_in_sections(docs, texts, monkeypatch):
    monkeypatch.setattr(repeats, "SECTION", 300)
    data = np.frombuffer((texts[-1] * 2).encode(), "u1")
    anchor, whole, start, windows = repeats.segments(data)
    assert (np.cumsum(windows) - windows == start).all() and windows.sum() == len(data) - 99


def test_repeats_odd(odd, empty):
    long = odd.withColumn("text", F.when(F.length("text") > 0, F.repeat("text", 9)))
    rows = {(r.doc_id, r.n_removed) for r in repeats.digests(long).collect()}
    assert (4, 252) in rows and (None, 0) in rows and (2, 0) in rows
    assert len([1 for r in repeats.digests(long).collect() if r.doc_id == 1]) == 2
    assert repeats.digests(empty).count() == 0
    assert set(repeats.without_repeats(odd).columns) == set(odd.columns)


def test_texts_stay_valid(spark):
    base = "é" * 120
    rows = spark.createDataFrame([(1, "x" + base), (2, "yy" + base + "z")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in repeats.without_repeats(rows).collect()}
    assert got[1].startswith("x") and "�" not in got[2] and got[2].startswith("yy") and got[2].endswith("z")


def toxic_by_hand(text, model):
    """The score of the worst window of words, each the mean of its subwords' numbers."""
    words = [w for w, _ in groupby(regex.findall(r"\p{L}+", (text or "").lower()))]
    if not words or not model:
        return 0.0

    def word(w):
        grams = ["<" + w + ">"] + [("<" + w + ">")[i : i + k] for k in toxicity.LENGTHS for i in range(len(w) + 3 - k)]
        ids = [zlib.crc32(g.encode("utf-32-le"), k if i else 0) % toxicity.BUCKETS for i, (g, k) in enumerate(zip(grams, [0, *map(len, grams[1:])]))]
        return float(np.mean(model[0][ids], dtype="float64"))

    numbers = [word(w) for w in words]
    k = min(toxicity.WINDOW, len(numbers))
    best = max(sum(numbers[i : i + k]) / k for i in range(len(numbers) - k + 1))
    return 1 / (1 + math.exp(-(best + model[1])))


def labelled(spark, path):
    """A label for most documents of the fixture, of both classes."""
    rows = [(i * 3 + 1, 1, int(i % 4 == 0)) for i in range(70)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))


def test_toxicity_by_hand(spark, docs, texts, tmp_path):
    labelled(spark, tmp_path)
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.learn(docs, labels)
    assert model is not None
    rows = {r.doc_id: r for r in toxicity.predictions(docs, labels).collect()}
    for i, text in enumerate(texts):
        r = rows[i * 3 + 1]
        assert r.score == pytest.approx(toxic_by_hand(text, model), abs=1e-4) and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.predicted for r in rows.values()} == {0, 1}


def kept_characters(text, gone):
    """What is left of a text, without the characters of which every byte goes."""
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not gone[at : at + n].all():
            out.append(c)
        at += n
    return "".join(out)


def test_pipeline(spark, docs, texts, tmp_path):
    """Every stage, rerun on what its predecessor kept, against brute force."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labelled(spark, tmp_path)
    sf, now = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, model = {}, None
    for name, stage in corpus_pipeline.STAGES:
        if name == "toxicity":
            model = toxicity.learn(now, spark.read.parquet(str(tmp_path / "labels.parquet")))
        before, now = now, stage(spark, now, sf)
        if name != "packing":
            assert now.columns == before.columns
            now.write.parquet(str(tmp_path / name))
            now = spark.read.parquet(str(tmp_path / name))
            kept[name] = {r.doc_id: r.text for r in now.collect()}
    all_texts = {i * 3 + 1: t for i, t in enumerate(texts)}
    assert set(kept["language"]) == {k for k, t in all_texts.items() if regex.search(r"\p{L}", t or "")}
    assert kept["toxicity"] == {k: t for k, t in kept["language"].items() if toxic_by_hand(t, model) < 0.3}
    assert 10 < len(kept["toxicity"]) < len(kept["language"])
    ids = sorted(kept["toxicity"])
    sets = dict(zip(ids, weighted_sets([kept["toxicity"][k] for k in ids])))
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if likeness(sets[a], sets[b]) >= 0.8 or kept["toxicity"][a] == kept["toxicity"][b]]
    assert pairs and set(kept["near_copies"]) == set(unions(ids, pairs).values())
    want = removed(kept["near_copies"].items())
    assert kept["repeats"] == {k: kept_characters(kept["near_copies"][k], gone) for k, (_, gone) in want.items()}
    rows = now.collect()
    assert {r.doc_id for r in rows} == set(kept["repeats"])
    assert corpus_pipeline.run(spark, sf).count() == len(rows)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_odd_rows(spark, odd, empty, tmp_path):
    """Null doc_ids, repeated rows, clashing columns and empty tables, stage by stage."""
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = odd.withColumns({x: F.lit("mine") for x in ("_language", "_score", "_gone", "_repeated_spans_", "_row_id", "copy")})
    n = {"language": 4, "toxicity": 6, "near_copies": 5, "repeats": 6, "packing": 6}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, frame, str(tmp_path))
        assert got.count() == n[name] and stage(spark, empty, str(tmp_path)).count() == 0
        if name != "packing":
            assert got.columns == frame.columns and {r._score for r in got.collect()} == {"mine"}
