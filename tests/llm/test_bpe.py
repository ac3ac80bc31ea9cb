"""Operator 10 against the tiktoken library, and its round trip."""

import gc
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TOOL = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
PIECES, MEMO, TOKEN = bpe.loaded(PATH, PATTERN)


def ids(text):
    return np.frombuffer(bpe.encode_text(text, PIECES, MEMO), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdeé日😀 \n\t.,'st0129ß́"), max_size=60) | st.text(max_size=40))
def test_like_the_library(text):
    assert ids(text) == TOOL.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_state_machine_any_bytes(data, block):
    machine = bpe.Utf8Stream()
    parts = [machine.feed(data[i : i + block]) for i in range(0, len(data), block)]
    if "�" not in data.decode("utf-8", "replace"):
        assert "".join(parts) + machine.close() == data.decode()


def test_small_merge_table():
    """The transducer agrees with plain merging on every short string of a small table."""
    import itertools

    ranks = {bytes([c]): i for i, c in enumerate(b"abc")} | {b"ab": 3, b"bc": 4, b"abc": 5, b"ca": 6, b"aa": 7, b"aab": 8, b"caa": 9}
    machine = bpe.Transducer(ranks)
    for n in range(9):
        for x in itertools.product(b"abc", repeat=n):
            piece = bytes(x)
            assert machine.encode(piece) == (machine.merged(piece) if piece not in ranks else [ranks[piece]]), piece


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 3)
    machine = bpe.Transducer(bpe.read_ranks(PATH))
    for text in ("hello world unbelievable", "a" * 300, "日本語テキスト"):
        assert [i for piece in PIECES.findall(text) for i in machine.encode(piece.encode())] == TOOL.encode_ordinary(text)


def test_digests(docs, texts):
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, PATTERN).collect()}
    for i, text in enumerate(texts):
        want = TOOL.encode_ordinary(text or "")
        row = got[i * 3 + 1]
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_decode_columns(docs, odd, empty):
    for frame in (docs, odd):
        back = bpe.decode(bpe.encode(frame, PATH, PATTERN), PATH, PATTERN)
        assert all((r.text or "") == r.decoded for r in back.collect())
    assert bpe.digests(empty, PATH, PATTERN).count() == 0
    assert bpe.digests(odd, PATH, PATTERN).count() == odd.count()


def test_garbage_collection_comes_back():
    assert gc.isenabled()
    with bpe.without_gc():
        assert not gc.isenabled()
    assert gc.isenabled()
