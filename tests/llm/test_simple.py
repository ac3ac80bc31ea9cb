"""Operators 2, 4, 5, 7 and 8."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import language, lm, packing, sharding, toxicity
from tidemark.llm.common import dense_rank_ids, runs

DATA = "/root/testdata/sf0.01"
JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_by_hand(real):
    """Distances of the ranker are those of a plain count of all n-grams."""
    profiles = language.learn(real.where(~language.held_out()))
    ranker = language.Ranker(profiles, language.TOP)
    for text in [r.text for r in real.orderBy("doc_id").limit(15).collect()]:
        counts = Counter(g for w in language.words(text.lower()) for g in language.grams(w))
        own = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], language.ordinal(x[0])))][: language.TOP]
        far = {}
        for name, profile in profiles.items():
            place = {g: i for i, g in enumerate(profile)}
            far[name] = sum(abs(i - place[g]) if g in place else language.TOP for i, g in enumerate(own))
        first, second = sorted(far.values())[:2]
        lang, score = ranker.predict(text)
        assert far[lang] == first and math.isclose(score, 1 - first / second)


def test_language_held_out(real):
    rows = language.predictions(real).join(real.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd(odd, empty, docs):
    got = [r.lang_pred for r in language.predictions(odd).collect()]
    assert len(got) == 6 and got.count("und") == 2
    assert language.predictions(empty).count() == 0
    by = {r.doc_id: r.lang_pred for r in language.predictions(docs).collect()}
    assert len(by) == docs.count()
    none = {r.lang_pred for r in language.predictions(docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()}
    assert none == {"und"}


def test_language_of_numbers(spark, real):
    """Signs of numbers are no letters."""
    rows = spark.createDataFrame([(7000001, "½ ² ① Ⅷ 12 ٣"), (7000002, "Ⅷ le chat"), (7000003, "_ - …")], "doc_id long, text string")
    profiles = language.learn(real.where(~language.held_out()))
    got = {r.doc_id: r.language.lang_pred for r in language.identify(rows, profiles).collect()}
    assert got[7000001] == got[7000003] == "und" != got[7000002]
    assert [language.words(t) for t in ("a½b", "x_y", "一二", "é1ß")] == [["a", "b"], ["x", "y"], ["一二"], ["é", "ß"]]


def test_language_ties():
    """Equal distances go to the first name."""
    ranker = language.Ranker({"b": ["x", "y"], "a": ["x", "y"]}, 400)
    assert ranker.predict("x y") == ("a", 0.0) and ranker.predict(None) == ("und", 0.0)


def test_shards(real):
    rows = sharding.placed(real).collect()
    by = defaultdict(list)
    for r in rows:
        assert r.grown_shard in (r["shard"], 40)
        by[r["shard"]].append((r.slot, r.doc_id))
    for some in by.values():
        assert sorted(s for s, _ in some) == list(range(len(some)))
        assert [d for _, d in sorted(some)] == sorted(d for _, d in some)
    moved = sum(r.grown_shard != r["shard"] for r in rows)
    assert 0 < moved < 3 * len(rows) / 41


def test_weights(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    n = Counter(r["shard"] for r in sharding.shard(keys, 3, [1.0, 1.0, 2.0]).collect())
    assert 0.45 < n[2] / 4000 < 0.55
    first = {r.doc_id: r["shard"] for r in sharding.shard(keys, 3, [1.0, 1.0, 2.0]).collect()}
    for r in sharding.shard(keys, 3, [1.0, 1.0, 2.5]).collect():
        assert r["shard"] in (first[r.doc_id], 2)


def test_shards_odd(odd, empty):
    rows = sharding.placed(odd).collect()
    assert len(rows) == 6 and {r.size for r in rows if r.doc_id in (2, 3)} == {16}
    assert sharding.placed(empty).count() == 0


def test_ranks(spark):
    rows = spark.createDataFrame([(i % 3, (i * 7919) % 5000 if i % 50 else None) for i in range(1000)], "g int, k long")
    by = defaultdict(list)
    for r in dense_rank_ids(rows, ["g"], ["k"], "n", per_run=10).collect():
        by[r.g].append((r.n, -1 if r.k is None else r.k))
    for some in by.values():
        some.sort()
        assert [n for n, _ in some] == list(range(len(some))) and [k for _, k in some] == sorted(k for _, k in some)


@pytest.mark.parametrize("keys", [[*range(5000), 2**62, -(2**62)], [None] * 4000 + [5] * 4000 + list(range(100))])
def test_runs_are_even(spark, keys):
    """Neither far-off keys nor many equal or missing ones make a run large."""
    rows = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3).withColumn("tie", F.monotonically_increasing_id())
    found = rows.withColumn("run", runs(rows, ["k", "tie"], 100)).collect()
    sizes = Counter(r.run for r in found)
    assert max(sizes.values()) <= 300 and len(sizes) > len(keys) / 300
    found.sort(key=lambda r: (r.k is not None, r.k or 0, r.tie))
    assert [r.run for r in found] == sorted(r.run for r in found)


def tokens(text):
    tool = Tokenizer.from_file(JSON)
    return [*tool.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing(docs, texts):
    rows = packing.packed(docs, JSON, PATTERN, 256).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids, at = tokens(text), 0
        for r in sorted(by[i * 3 + 1], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert sum(r.length for r in rows) >= 0.9 * 256 * len(sequences)


def test_patterns():
    rng = random.Random(1)
    for _ in range(30):
        histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(20)}
        packs = packing.patterns(histogram, 64)
        left = Counter()
        for lengths, n in packs:
            assert sum(lengths) <= 64 and n > 0
            for x in lengths:
                left[x] += n
        assert left == Counter(histogram)
        owned = defaultdict(list)
        for length, first, last, _, _ in packing.slots(packs):
            owned[length] += range(first, last + 1)
        assert {k: sorted(v) for k, v in owned.items()} == {k: list(range(n)) for k, n in histogram.items()}


def test_packing_odd(odd, empty):
    rows = packing.packed(odd, JSON, PATTERN).collect()
    assert len(rows) == 6 and len({(r.sequence_id, r.offset) for r in rows}) == 6
    assert packing.packed(empty, JSON, PATTERN).count() == 0


def lm_by_hand(items, chosen):
    """Losses of bigram counts kept in dictionaries, a row's own counts left out: (target, background) by place."""
    tool = lm.encoder(RANKS, PATTERN)
    grams = []
    for _, text in items:
        ids = tool.encode_ordinary(text or "")
        grams.append(list(zip([-1, *ids], [*ids, -1])) if ids else [])
    outcomes = len({b for g in grams for _, b in g})
    part = lambda n, whole: n / whole if whole else 1 / outcomes
    out = []
    for i, mine in enumerate(grams):
        pair = []
        for side in (True, False):
            two = Counter(x for j, g in enumerate(grams) if j != i and (items[j][0] in chosen) == side for x in g)
            one, before = Counter(), Counter()
            for (a, b), n in two.items():
                one[b] += n
                before[a] += n
            total = sum(two.values())
            pair.append(sum(-math.log(0.6 * part(two[a, b], before[a]) + 0.3 * part(one[b], total) + 0.1 / outcomes) for a, b in mine) / max(1, len(mine)))
        out.append((max(0, len(mine) - 1), *pair))
    return out


def lm_rows(frame):
    return sorted((r.doc_id, r.n_tokens, round(r.target_loss, 4), round(r.background_loss, 4)) for r in frame.collect())


@pytest.mark.parametrize("hot", [1, 200, lm.HOT])
def test_lm_by_hand(docs, texts, hot):
    """Whatever is broadcast, losses are those of counts without the document itself."""
    items = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    got = lm.score(docs, docs.where("doc_id % 2 = 0"), RANKS, PATTERN, hot).collect()
    want = dict(zip((k for k, _ in items), lm_by_hand(items, {k for k, _ in items if k % 2 == 0})))
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        n, near, far = want[r.doc_id]
        assert r.n_tokens == n and math.isclose(r.target_loss, near, abs_tol=1e-5) and math.isclose(r.background_loss, far, abs_tol=1e-5)
        assert math.isclose(r.score, near - far, abs_tol=1e-5)


def test_lm_of_many_characters(spark):
    """Texts without spaces in another script; a row that occurs twice meets its copy."""
    rng = random.Random(4)
    texts = ["".join(chr(0x4E00 + min(rng.randrange(900), rng.randrange(900))) if rng.random() < 0.8 else rng.choice("abc ") for _ in range(rng.randint(1, 300))) for _ in range(40)]
    items = [*enumerate(texts), (3, texts[3])]
    rows = spark.createDataFrame(items, "doc_id long, text string").repartition(3)
    want = lm_by_hand(items, set(range(0, 40, 4)))
    got = lm.score(rows, rows.where("doc_id % 4 = 0"), RANKS, PATTERN, 500).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in items)
    for r in got:
        n, near, far = want[r.doc_id]
        assert r.n_tokens == n and math.isclose(r.target_loss, near, abs_tol=1e-5) and math.isclose(r.background_loss, far, abs_tol=1e-5)
    lone = [r.background_loss for r in got if r.doc_id % 4 and r.doc_id != 3]
    assert [r.background_loss for r in got if r.doc_id == 3][0] < min(lone)


def test_lm_tells_languages_apart(real):
    french = real.where("lang = 'fr'")
    rows = lm.score(real, french, RANKS, PATTERN).join(real.select("doc_id", "lang"), "doc_id").where("n_tokens > 50").collect()
    assert sum((r.score < 0) == (r.lang == "fr") for r in rows) > 0.97 * len(rows)


def test_lm_odd(odd, empty):
    got = lm_rows(lm.score(odd, odd.where("doc_id = 4"), RANKS, PATTERN).fillna(-1, ["doc_id"]))
    items = [(r.doc_id, r.text) for r in odd.collect()]
    assert got == sorted((-1 if k is None else k, n, round(a, 4), round(b, 4)) for (k, _), (n, a, b) in zip(items, lm_by_hand(items, {4})))
    assert lm.score(empty, empty, RANKS, PATTERN).count() == 0 and lm.score(odd, empty.select("doc_id"), RANKS, PATTERN).count() == 6


LABELS = "doc_id LONG, quality INT, toxic INT"


def test_toxicity_generalises(spark):
    """Unseen misspellings of the learned words are caught in long texts, clean texts are not."""
    rng = random.Random(2)
    common = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["stinkwort", "dumbhead", "uglyface"]

    def text(toxic, spell):
        out = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        for _ in range(2 * toxic):
            out.insert(rng.randrange(len(out)), spell(rng.choice(bad)))
        return " ".join(out)

    plain = lambda w: w
    misspelt = lambda w: w[:5] + rng.choice("xyz") + w[5:]
    rows, labels = [], []
    for i in range(900):
        held = zlib.crc32(str(i).encode()) % 4 == 2
        rows.append((i, text(i % 3 == 0, misspelt if held else plain)))
        labels.append((i, 1, int(i % 3 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.predictions(frame, spark.createDataFrame(labels, LABELS)).collect()
    held = [r for r in got if r.held_out]
    toxic = [r for r in held if r.doc_id % 3 == 0]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.predicted for r in held) - sum(r.predicted for r in toxic) <= 0.02 * len(held)


def test_toxicity_of_the_given_labels(spark):
    """On documents that were not learned from, most toxic ones are caught and few others are."""
    where = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{where}/labels.parquet")
    rows = toxicity.predictions(spark.read.parquet(f"{where}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    both = sum(r.predicted and r.toxic for r in rows)
    assert both >= 0.8 * sum(r.toxic for r in rows) > 50 and both >= 0.8 * sum(r.predicted for r in rows)


def test_toxicity_odd(spark, odd, empty, docs):
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in toxicity.predictions(odd, none).collect()] == [0.0] * 6
    one = spark.createDataFrame([(1, 1, 1), (1, 1, None), (None, 1, 0)], LABELS)
    assert toxicity.predictions(odd, one).count() == 6
    both = spark.createDataFrame([(i * 3 + 1, 1, i % 2) for i in range(60)], LABELS)
    rows = toxicity.predictions(docs, both).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.predictions(empty, both).count() == 0


def test_toxicity_sample_is_bounded_in_characters(spark, monkeypatch):
    rows = [(i % 200, f"some{i % 200} other " * 25) for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], LABELS)
    taught = []
    monkeypatch.setattr(toxicity, "train", lambda sample: taught.append(sample))
    toxicity.learn(frame, labels)
    toxicity.learn(frame, labels, chars=15_000)
    whole, part = ([len(t) for t in s.texts] for s in taught)
    assert len(whole) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(200))  # repeated rows teach once
    assert 15 < len(part) < 75 and set(part) == set(whole) == {50}  # about 47 whole texts
