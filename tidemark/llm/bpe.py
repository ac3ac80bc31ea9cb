"""Byte-level BPE encoding and decoding (operator 10).

Encoding. A rank-ordered merge table is turned, state by state and only as texts need it, into a
deterministic finite-state transducer over bytes. Its base fact: of all tokens that end at a byte
position exactly one can be the last token of that prefix's BPE encoding, namely the one whose pair
with the encoding's previous token survives re-encoding. A state therefore holds only the last token
already emitted and the bytes read after it. A transition reads one byte, finds the last token of the
longer prefix, and emits every token that all still possible continuations share; a continuation is
possible while the bytes behind it begin some token, so the lookahead is bounded by the longest token.

Decoding. Ids are decoded block by block; a UTF-8 state machine keeps the at most three bytes of an
unfinished character between blocks.

Null texts count as empty. Texts of any length run in memory proportional to the text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces whose ids a worker remembers; the memo is emptied beyond that, which only costs time.
MEMO = 800_000
#: States and their transitions that a worker keeps; beyond that the transducer starts afresh.
STATES = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank pairs."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """The lazily determinised transducer of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.begins = {token[:n] for token in ranks for n in range(1, len(token))}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Tokens that merging never makes, so that only a whole piece can be one.
        self.unmade = {rank for rank, token in self.token.items() if len(token) > 1 and not self.makes(token, rank)}
        self.reset()

    def makes(self, token: bytes, rank: int) -> bool:
        """Whether two earlier tokens join into this one, which holds for every token of a merge list."""
        return any(self.ranks.get(token[:i], rank) < rank and self.ranks.get(token[i:], rank) < rank for i in range(1, len(token))) and (
            len(token) < 3 or self.merged(token) == [rank]
        )

    def reset(self) -> None:
        """Forget all states but the initial one."""
        start = (-1, b"", (), (0,))
        self.number = {start: 0}
        self.states = [start]
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a short byte string by repeatedly merging the adjacent pair of least rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether an encoding may hold these two tokens side by side."""
        if left < 0:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
            if len(self.pairs) > 4 * STATES:
                self.pairs = {}
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after one more byte, and the tokens emitted on the way."""
        before, pending, lasts, open_at = self.states[state]
        pending += bytes((byte,))
        n, begins, ends = len(pending), self.begins, [before, *lasts]  # ends[i]: last token of the encoding of i pending bytes
        last = None
        for start in open_at:
            token = self.ranks.get(pending[start:])
            if token is not None and ends[start] is not None and token not in self.unmade and self.follows(ends[start], token):
                last = token
                break
        ends.append(last)
        alive = [i for i in open_at if pending[i:] in begins]
        if last is not None:
            alive.append(n)
        shared: list[int] | None = None
        for i in alive:
            chain = []
            while i:
                chain.append(i)
                i -= len(self.token[ends[i]])
            chain.reverse()
            if shared is None:
                shared = chain
            else:
                k = 0
                while k < len(shared) and k < len(chain) and shared[k] == chain[k]:
                    k += 1
                shared = shared[:k]
            if not shared:
                break
        out: tuple[int, ...] = ()
        if shared:
            out, cut = tuple([ends[i] for i in shared]), shared[-1]
            pending, ends, alive = pending[cut:], ends[cut:], [i - cut for i in alive]
        key = (ends[0] if alive and alive[0] == 0 else -1, pending, tuple(ends[1:]), tuple(alive))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return number, out

    def finish(self, state: int) -> list[int]:
        """The tokens of what is still pending when the input ends."""
        _, pending, lasts, _ = self.states[state]
        out, i = [], len(pending)
        while i:
            out.append(lasts[i - 1])
            i -= len(self.token[out[-1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece of text."""
        if len(self.states) > STATES:
            self.reset()
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out = 0, []
        for byte in piece:
            known = self.steps[state].get(byte)
            if known is None:
                known = self.steps[state][byte] = self.step(state, byte)
            state, emitted = known
            if emitted:
                out += emitted
        out += self.finish(state)
        return out


class Pieces(dict):
    """Memo from a piece of text to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = self[piece] = np.array(self.encode(piece), "<u4").tobytes()
        return ids


class Utf8Stream:
    """Incremental UTF-8 state machine: whole characters go out, an unfinished one waits for its rest."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(4, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue  # inside a character
            need = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            if need > back:
                cut = len(data) - back
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


def decode_stream(ids: np.ndarray, token: list[bytes], block: int = 8192) -> Iterator[str]:
    """The text of ids, in parts that each end at a character's end."""
    machine = Utf8Stream()
    for at in range(0, len(ids), block):
        yield machine.feed(b"".join(map(token.__getitem__, ids[at : at + block].tolist())))
    yield machine.close()


@contextmanager
def without_gc() -> Iterator[None]:
    """No cyclic collection inside: the tables hold no cycles, and walking them takes longer than building them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> tuple[regex.Pattern, Pieces, list[bytes]]:
    """A worker's pattern, memo over the transducer, and tokens by id."""
    machine = Transducer(read_ranks(path))
    token = [b""] * (1 + max(machine.token))
    for rank, data in machine.token.items():
        token[rank] = data
    return regex.compile(pattern), Pieces(lambda piece: machine.encode(piece.encode())), token


def encode_text(text: str | None, pieces: regex.Pattern, memo: Pieces) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    return b"".join(map(memo.__getitem__, pieces.findall(text))) if text else b""


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with a binary column of the ids of each whole text (little-endian unsigned 32-bit); null texts have none."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with without_gc():
            pieces, memo, _ = loaded(path, pattern)
            for batch in batches:
                yield pd.Series([encode_text(t, pieces, memo) for t in batch], dtype=object)

    return docs.withColumn(into, ids(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text of a binary ids column; null ids decode to an empty text."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with without_gc():
            _, _, token = loaded(path, pattern)
            for batch in batches:
                yield pd.Series(["".join(decode_stream(np.frombuffer(x or b"", "<u4"), token)) for x in batch], dtype=object)

    return docs.withColumn(into, texts(F.col(ids)))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded in one pass over it."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with without_gc():
            pieces, memo, token = loaded(path, pattern)
            for batch in batches:
                out = []
                for text in batch["text"]:
                    data = encode_text(text, pieces, memo)
                    back = hashlib.sha256()
                    for part in decode_stream(np.frombuffer(data, "<u4"), token):
                        back.update(part.encode())
                    out.append((len(data) // 4, hashlib.sha256(data).hexdigest(), back.hexdigest()))
                n, ids, back = zip(*out) if out else ((), (), ())
                yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.array(n, "int64"), "ids_sha256": ids, "decoded_sha256": back})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
