"""Repeated passages by suffix arrays (operator 9).

What repeats is cut out byte-exactly: every byte that lies in a string of LENGTH bytes which also starts
earlier, in a smaller doc_id or before in the same text.

Suffixes that can share LENGTH bytes are first brought together. Every window of LENGTH bytes has an
anchor, its GRAM-byte string of least hash; equal windows have equal anchors at equal places. A text is so
cut into segments, each the run of windows with one anchor, and segments whose anchor occurs once in the
corpus cannot repeat. The others travel to the task of their anchor with just the bytes of their windows.

Segments with the same anchor and bytes are collapsed to the first of them, compared byte by byte, within
each portion of texts and then at their anchor; all others repeat it whole. Of the distinct segments of an
anchor a suffix array is built by two-stage sorting: the suffixes smaller than their successor are sorted
directly, all others are induced from these by scanning the buckets once. Neighbours' common prefixes of
LENGTH bytes or more join equal windows, of which only the first start stays.

An anchor with more than GROUP segments is salted by document and text, so that no task holds more than about GROUP
of them, be they of one text or of equal texts. Each task settles its own; the windows that are the first of their kind in their task are then
grouped by their bytes, and all but the first of these repeat it too.

Null texts are empty. Texts shorter than LENGTH never change. A doc_id that repeats with the same text
counts as one text; with different texts it stands for several, of which the one with the lesser 64-bit
hash (xxhash64) counts as earlier. Without a doc_id a text neither changes nor serves as a first occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

LENGTH = 100
GRAM = 32
#: Windows that are cut into segments together.
SECTION = 1 << 16
#: Bytes of text that a task cuts into segments at a time.
PORTION = 8_000_000
#: Bytes of text that a task takes repeated segments from at a time.
TAKEN = 2_000_000
#: Segments of one anchor that a single task sorts, about.
GROUP = 8192
#: A range of bytes is one number: its start and, in the low bits, its length.
SPAN_BITS = 20
SPANS, COPY = "_repeated_spans", "_repeated_copy"
#: Texts go to Python as the bytes that they are for Spark.
BYTES = "CAST(text AS BINARY) AS text"
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on: of its words of eight bytes, then of pairs of these."""
    h = np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), strides=(1,)).astype("uint64")
    h *= _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    span = 8
    while span < GRAM:
        h = h[:-span] * _U(0xBF58476D1CE4E5B9 + 2 * span) + h[span:]
        h ^= h >> _U(29)
        span *= 2
    return mixed(h)


def segments_of(data: np.ndarray, sizes: np.ndarray, hashed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of texts that stand one behind the other: text, anchor, first window in it, number of windows and hash of the bytes.

    `sizes` are the texts' bytes. The hash is zero where it is not asked for. SECTION windows are looked at together, so that
    they stay in a processor's cache; where a segment goes on in the next section it is put together again, so that a text's
    segments depend on nothing but the text.
    """
    ends = np.cumsum(sizes)
    begins, out = ends - sizes, []
    for at in range(0, max(0, len(data) - LENGTH + 1), SECTION):
        h = gram_hashes(data[at : at + SECTION + LENGTH - 1])
        least = (h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype="uint64")  # the leftmost of equals
        span, width = 1, LENGTH - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        new = starts_of(least)
        some = slice(*np.searchsorted(ends, [at, at + len(new) + LENGTH], side="right"))  # the texts that start or end here, and one more
        edges = np.concatenate([begins[some.start : some.stop + 1], np.maximum(begins, ends - LENGTH + 1)[some]]) - at
        new[edges[(edges >= 0) & (edges < len(new))]] = True  # windows do not go on from text to text
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(new)))
        text = np.searchsorted(ends, at + first, side="right")
        whole = at + first + LENGTH <= ends[text]
        first, windows, text = first[whole], windows[whole], text[whole]
        anchor, code = (least[first] & _U(0xFFFFFF)).astype("int64"), np.zeros(len(first), "uint64")
        if hashed:
            code, last = ((anchor - first) * 128 + windows).astype("uint64"), first + windows + LENGTH - 1 - GRAM
            for i in range(0, 2 * LENGTH - GRAM, GRAM):
                code = code * _U(0x9E3779B97F4A7C15) + h[np.minimum(first + i, last)]
            code = mixed(code)
        out.append((text, h[anchor], at + first - begins[text], windows, code, at + anchor))
    if not out:
        return np.empty(0, "int64"), np.empty(0, "uint64"), np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "uint64")
    text, anchor, first, windows, code, place = (np.concatenate(x) for x in zip(*out))
    one = np.flatnonzero(starts_of(place))
    return text[one], anchor[one], first[one], np.add.reduceat(windows, one) if len(one) else windows, code[one]


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash of the bytes, first window and number of windows of each segment of one text's bytes."""
    _, anchor, first, windows, whole = segments_of(data, np.array([len(data)]), hashed=True)
    return anchor, whole, first, windows


def portions(batches: Iterable[pd.DataFrame], size: int = PORTION) -> Iterator[pd.DataFrame]:
    """The same rows with about `size` bytes of text at a time (or one text)."""
    for batch in batches:
        part = batch["text"].str.len().cumsum().to_numpy() // size
        for _, some in batch.groupby(part, sort=False):
            yield some


def joined(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one behind the other, and how many each has."""
    return np.frombuffer(b"".join(texts), "u1"), texts.str.len().to_numpy("int64")


def starts_of(values: np.ndarray) -> np.ndarray:
    """Which of these differ from the one before (the first does)."""
    return np.append(True, values[1:] != values[:-1])[: len(values)]


def anchors(docs: DataFrame) -> DataFrame:
    """anchor and n of the anchors that occur more than once; n is about how many segments of it tasks will send."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in portions(batches):
            _, anchor, _, _, whole = segments_of(*joined(batch["text"]), hashed=True)
            if not len(anchor):
                continue
            order = np.argsort(anchor)
            anchor, whole = anchor[order], whole[order]
            at = np.flatnonzero(starts_of(anchor))
            times = np.diff(np.append(at, len(anchor)))
            n, many = np.minimum(times, 2), times > 2
            if many.any():  # how many of them differ
                some = np.repeat(many, times)
                anchor_, whole_ = anchor[some], whole[some]
                order = np.lexsort((whole_, anchor_))
                anchor_, whole_ = anchor_[order], whole_[order]
                new = starts_of(anchor_)
                n[many] = np.maximum(2, np.add.reduceat((new | starts_of(whole_)).astype("int64"), np.flatnonzero(new)))
            yield pd.DataFrame({"anchor": anchor[at].view("int64"), "n": n})

    return docs.selectExpr(BYTES).mapInPandas(rows, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")


def occurrences(docs: DataFrame) -> DataFrame:
    """The segments of all texts: where each starts and ends, and its anchor."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in portions(batches):
            text, anchor, start, windows, _ = segments_of(*joined(batch["text"]))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy()[text], "copy": batch[COPY].to_numpy()[text],
                "anchor": anchor.view("int64"), "span": (start << SPAN_BITS) + windows + LENGTH - 1,
            })

    return docs.selectExpr("doc_id", COPY, BYTES).mapInPandas(rows, "doc_id long, copy long, anchor long, span long")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a byte string in the order of their first `depth` bytes at least, by two-stage sorting."""
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    ends = np.append(change, n - 1)[: len(change) + (n > 0)]  # of runs of one letter
    smaller = np.repeat(np.append(text[change] < text[change + 1], False)[: len(ends)], np.diff(ends, prepend=-1))
    word, wide = several(eight(text))
    order = np.flatnonzero(smaller)
    order = order[np.argsort(word[order])]
    tied_at, group = np.arange(len(order)), word[order]
    for far in range(wide, depth, wide):  # sort on only what is still equal
        new = starts_of(group)
        lone = new & np.append(new[1:], True)[: len(new)]
        number = np.cumsum(new)[~lone]
        tied_at = tied_at[~lone]
        if not len(tied_at):
            break
        suffix = order[tied_at]
        key = word[np.minimum(suffix + far, n)]
        by = np.lexsort((key, number))
        order[tied_at] = suffix[by]
        key, number = key[by], number[by]
        group = np.cumsum(starts_of(key) | starts_of(number))
    size = np.bincount(text, minlength=256)
    late = np.bincount(text[order], minlength=256)
    start = np.cumsum(size) - size
    out = np.empty(n, "int64")
    out[np.repeat(start + size - late, late) + np.arange(len(order)) - np.repeat(np.cumsum(late) - late, late)] = order
    filled = np.zeros(256, "int64")
    if n:
        out[start[text[-1]]], filled[text[-1]] = n - 1, 1  # it follows from the empty suffix

    def induce(suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[~smaller[before]]
        letters = text[before]
        by = np.argsort(letters, kind="stable")
        counts = np.bincount(letters, minlength=256)
        out[np.repeat(start + filled, counts) + np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)] = before[by]
        np.add(filled, counts, out=filled)

    for letter in range(256):
        done = 0
        while done < filled[letter]:
            end = filled[letter]
            induce(out[start[letter] + done : start[letter] + end])
            done = end
        if late[letter]:
            induce(out[start[letter] + size[letter] - late[letter] : start[letter] + size[letter]])
    return out


def several(word: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers in the order of as many bytes from each place on as the ranks of its eights leave room for, and how many these are."""
    order = np.argsort(word)
    new = starts_of(word[order])
    rank = np.empty(len(word), "uint64")
    rank[order] = np.cumsum(new)
    bits = int(new.sum()).bit_length()
    out, last = rank.copy(), np.arange(len(word))
    for i in range(1, 64 // bits):
        out = (out << _U(bits)) | rank[np.minimum(last + 8 * i, len(word) - 1)]
    return out, 8 * (64 // bits)


def eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros behind the end), and one zero more."""
    word = np.concatenate([text, np.zeros(16, "u1")]).astype("uint64")
    for span in (1, 2, 4):
        word = (word[:-span] << _U(8 * span)) | word[span:]
    return word[: len(text) + 1]


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, most: int) -> np.ndarray:
    """How many bytes each suffix has in common with the one before it, in steps of eight and up to `most`."""
    word = eight(text)
    out = np.zeros(len(suffixes), "int64")
    alive = np.arange(1, len(suffixes))
    for far in [*range(0, most - 8, 8), most - 8]:
        a, b = suffixes[alive] + far, suffixes[alive - 1] + far
        alive = alive[word[np.minimum(a, len(text))] == word[np.minimum(b, len(text))]]
        out[alive] = far + 8
    return out


def sorted_windows(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of these segments, which windows start earlier too, and the segments' starts in the bytes.

    The segments stand in the order of their places, so that of equal windows the one with the least start is first.
    """
    size = part["bytes"].str.len().to_numpy() + 1
    text = np.frombuffer(b"\0".join(part["bytes"]) + b"\0", "u1")
    ends = np.cumsum(size)
    window = np.ones(len(text), bool)
    for back in range(1, LENGTH + 1):
        window[ends - back] = False
    order = suffix_array(text, LENGTH)
    order = order[window[order]]
    prefix = common_prefixes(text, order, LENGTH)
    head = np.flatnonzero(prefix < LENGTH)
    first = np.minimum.reduceat(order, head) if len(order) else order
    again = np.zeros(len(text), bool)
    again[order] = order != np.repeat(first, np.diff(np.append(head, len(order))))
    return text, again, ends - size


def repeated(part: pd.DataFrame) -> pd.DataFrame:
    """doc_id, copy and span of what repeats in these segments (key, salts, doc_id, copy, span, bytes).

    Segments without bytes are known to repeat. A segment with several salts also gives each of its windows
    that nothing here repeats, for its anchor has segments elsewhere.
    """
    found = part["bytes"].notna().to_numpy()
    out = [part[~found]]
    part = part[found].sort_values(["doc_id", "copy", "span"]).drop_duplicates(["doc_id", "copy", "span"])
    same = part.duplicated(["key", "bytes"]).to_numpy()
    out.append(part[same])
    part = part[~same]
    part = part[part.duplicated("key", keep=False) | (part["salts"] > 1)]  # a lone segment has nothing to repeat
    places, windows = [tuple(x[c].to_numpy() for c in ("doc_id", "copy", "span")) for x in out], []
    if len(part):
        text, again, begins = sorted_windows(part)
        doc, copy, start = part["doc_id"].to_numpy(), part["copy"].to_numpy(), part["span"].to_numpy() >> SPAN_BITS

        def placed(at: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row = np.searchsorted(begins, at, side="right") - 1
            return doc[row], copy[row], ((start[row] + at - begins[row]) << SPAN_BITS) + size

        edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype("int8"), [0]])))
        places.append(placed(edge[::2], edge[1::2] - edge[::2] + LENGTH - 1))
        salted = np.flatnonzero(part["salts"].to_numpy() > 1)
        sizes = np.diff(np.append(begins, len(text)))[salted] - LENGTH  # windows of each
        at = np.repeat(begins[salted], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, data = at[~again[at]], text.tobytes()
        places.append(placed(at, LENGTH))
        windows = [data[i : i + LENGTH] for i in at.tolist()]
    doc, copy, span = (np.concatenate(x) for x in zip(*places))
    window = np.full(len(doc), None, object)
    window[len(doc) - len(windows) :] = windows
    return pd.DataFrame({"doc_id": doc, "copy": copy, "span": span, "window": window})


def salted(doc: int, copy: int, salts: int) -> int:
    """The salt of a text's segments: by its doc_id and its bytes, so that neither texts of one doc_id nor equal texts of many have one."""
    return (((doc ^ copy) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) % salts


def merged(doc: np.ndarray, copy: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same ranges with those of a text that overlap joined, in pieces that a span has bits for. Of a text's, one that starts later never ends earlier."""
    order = np.lexsort((span, copy, doc))
    doc, copy, start = doc[order], copy[order], span[order] >> SPAN_BITS
    end = start + (span[order] & ((1 << SPAN_BITS) - 1))
    new = starts_of(doc) | starts_of(copy) | starts_of(start >> (SPAN_BITS - 1))
    new[1:] |= start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return doc[at], copy[at], (start[at] << SPAN_BITS) + end[np.append(at[1:], len(end))[: len(at)] - 1] - start[at]


def taken(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the segments asked for, once for those with equal bytes in a portion of texts; the others' ranges, joined, have null."""
    for batch in portions(batches, TAKEN):
        sizes = [len(x) for x in batch["spans"]]
        span, key, salts = (np.concatenate(batch[c].tolist()) for c in ("spans", "anchors", "salts"))
        doc, copy = np.repeat(batch["doc_id"].to_numpy(), sizes), np.repeat(batch[COPY].to_numpy(), sizes)
        pieces: list[bytes] = []
        for text, spans_ in zip(batch["text"], batch["spans"]):
            start = spans_ >> SPAN_BITS
            pieces += [text[a:b] for a, b in zip(start.tolist(), (start + (spans_ & ((1 << SPAN_BITS) - 1))).tolist())]
        data = np.empty(len(pieces), object)
        data[:] = pieces
        code = pd.factorize(data)[0]  # equal bytes have equal anchors
        order = np.lexsort((span, copy, doc, code))
        sent = order[starts_of(code[order])]
        least = sent[code]
        known = np.flatnonzero((doc != doc[least]) | (copy != copy[least]) | (span != span[least]))  # they repeat, and go anywhere
        salt, many = np.zeros(len(sent), "int32"), np.flatnonzero(salts[sent] > 1)
        salt[many] = [salted(*x) for x in zip(doc[sent[many]].tolist(), copy[sent[many]].tolist(), salts[sent[many]].tolist())]
        yield pd.DataFrame({"key": key[sent], "salt": salt, "salts": salts[sent], "doc_id": doc[sent], "copy": copy[sent], "span": span[sent], "bytes": data[sent]})
        doc, copy, span = merged(doc[known], copy[known], span[known])
        where = mixed((doc ^ copy ^ span).view("uint64")).view("int64")
        yield pd.DataFrame({"key": where, "salt": 0, "salts": 1, "doc_id": doc, "copy": copy, "span": span, "bytes": np.full(len(doc), None, object)})


def compared(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What repeats among segments in the order of key and salt; a group may go on in the next batch."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key, salt = batch["key"].to_numpy(), batch["salt"].to_numpy()
        other = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or (held and (held[0]["key"].iloc[0], held[0]["salt"].iloc[0]) != (key[0], salt[0])):
            yield repeated(pd.concat([*held, batch.iloc[:cut]]))
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield repeated(pd.concat(held))


def spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, copy and spans, the ranges of bytes to remove, of every text with such; docs has doc_id, COPY and text, none null."""
    many = store(anchors(docs))  # stored, so that the join knows its size, and can split the most frequent anchors if it shuffles
    asked = store(
        occurrences(docs).join(many, "anchor").groupBy("doc_id", "copy")
        .agg(F.collect_list(F.struct("span", "anchor", F.ceil(F.col("n") / group).cast("int").alias("salts"))).alias("_asked"))
        .select("doc_id", F.col("copy").alias(COPY), F.col("_asked.span").alias("spans"), F.col("_asked.anchor").alias("anchors"), F.col("_asked.salts").alias("salts"))
    )
    pieces = docs.join(asked, ["doc_id", COPY]).selectExpr("doc_id", COPY, BYTES, "spans", "anchors", "salts").mapInPandas(taken, "key long, salt int, salts int, doc_id long, copy long, span long, bytes binary")
    found = pieces.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInPandas(compared, "doc_id long, copy long, span long, window binary")
    if not many.where(F.col("n") > group).isEmpty():
        found = store(found)
        windows, place = found.where("window is not null"), F.struct("doc_id", "copy", "span")
        first = store(windows.groupBy("window").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
        later = windows.join(first, "window").where(place > F.col("_first"))
        found = found.where("window is null").unionByName(later.select(*found.columns))
    return found.groupBy("doc_id", "copy").agg(F.collect_list("span").alias("spans"))


def covered(size: int, ranges) -> np.ndarray:
    """Which of `size` bytes lie in one of the ranges."""
    out = np.zeros(size + 1, "int32")
    if ranges is not None and len(ranges):
        ranges = np.asarray(ranges, "int64")
        start, length = ranges >> SPAN_BITS, ranges & ((1 << SPAN_BITS) - 1)
        np.add.at(out, np.minimum(start, size), 1)
        np.add.at(out, np.minimum(start + length, size), -1)
    return np.cumsum(out)[:-1] > 0


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with the spans of every document (column SPANS): null where nothing repeats. Null texts are empty."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    known = rows.where("doc_id is not null").withColumn(COPY, F.xxhash64("text"))
    rest = rows.where("doc_id is null").withColumn(SPANS, F.lit(None).cast("array<long>"))
    found = spans(known.select("doc_id", COPY, "text")).select("doc_id", F.col("copy").alias(COPY), F.col("spans").alias(SPANS))
    return known.join(found, ["doc_id", COPY], "left").select(*rest.columns).unionByName(rest)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with texts that lack what repeats; a character goes if all its bytes do, so that texts stay valid."""

    @F.pandas_udf("string")
    def left(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for text, spans_ in zip(texts, ranges):
            if spans_ is not None and len(spans_):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
                leads = np.flatnonzero((data & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(covered(len(data), spans_), leads)
                gone = np.repeat(whole, np.diff(np.append(leads, len(data))))
                text = data[~gone].tobytes().decode("utf-8", "surrogatepass")
            out.append(text)
        return pd.Series(out, dtype=object)

    return with_spans(docs).withColumn("text", F.when(F.col(SPANS).isNull(), F.col("text")).otherwise(left("text", SPANS))).drop(SPANS)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch["text"], batch[SPANS]):
                if ranges is None:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                    continue
                data = np.frombuffer(text, "u1")
                gone = covered(len(data), ranges)
                runs = int((np.diff(np.concatenate([[0], gone.view("int8")])) == 1).sum())
                out.append((len(data), int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            n, removed, runs, digest = zip(*out) if out else ((),) * 4
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": np.array(n, "int64"), "n_removed": np.array(removed, "int64"), "n_spans": np.array(runs, "int64"), "kept_sha256": digest})

    return with_spans(docs.select("doc_id", "text")).selectExpr("doc_id", BYTES, SPANS).mapInPandas(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
