"""Removal of repeated passages: windows of words that occur elsewhere, found by recompression.

A text is a sequence of word names. Rounds shorten it: a run of equal names becomes one name, then
names are split by a bit into left and right ones and every neighbouring left-right pair becomes one name. A name
is a hash of what it stands for, so it is the same in every document and every task without an
exchange; with each name goes the stretch of words that decided about it. A name whose stretch lies in
a window is thus found in every copy of that window, wherever the copy stands.

1. Each window belongs to one name inside it, its anchor: the least hash on the highest level that
   has one. About one word in fifteen begins an anchor. Spark counts the anchors' stretches (keys).
2. Anchors of keys that occur once are done: none of their windows repeats. For the others Spark
   groups key and *span* (all words of all windows of the anchor). A repeated span repeats all its windows.
3. Where a key has several spans, one example of each span gives its windows one by one, and Spark
   counts these. The results return to all anchors of a span as a bit mask, and to the documents.

Hashes are of 64 bits; what decides about a word is always a pair of them (key with span, key with window).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vintara.llm.common import hashed_words, mix, slices, utf8, written

#: Pair rounds after which anchors are looked for, the highest first; the words themselves come last.
LEVELS = (4, 2)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Passages:
    """The words of some texts in one row, a separator of its own before and after each text."""

    def __init__(self, texts: list[bytes], window: int):
        hashed, self.sizes = hashed_words(texts)
        self.window = window
        self.starts = np.cumsum(self.sizes + 1) - self.sizes
        parted = np.concatenate([self.starts - 1, len(hashed) + len(texts) + np.arange(2)])
        self.x = np.empty(len(hashed) + len(parted), np.uint64)
        self.x[parted] = mix(np.arange(len(parted), dtype=np.uint64) + np.uint64(0xABCDEF123))
        self.x[np.arange(len(hashed)) + np.repeat(np.arange(len(texts)) + 1, self.sizes)] = hashed
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.x), BASE)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.x), INVERSE)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.x * powers[:-1])])

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the words lo to hi - 1, wherever they stand."""
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, key, span hash) of every anchor."""
        w = self.window
        counts = np.maximum(self.sizes - w + 1, 0)
        total = int(counts.sum())
        if not total:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
        first = np.repeat(self.starts - (np.cumsum(counts) - counts), counts) + np.arange(total)
        lo, hi, level = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, -1)
        left = np.arange(total)
        for depth, (names, los, his) in self._levels():
            # From the first name that begins in the window to the last that ends in it.
            a, b = _before(los, len(self.x))[first[left]], _before(his, len(self.x))[first[left] + w + 1]
            inside = b > a
            best = _least(mix(names + np.uint64(depth)), a[inside], b[inside])
            at = left[inside]
            lo[at], hi[at], level[at] = los[best], his[best], depth
            left = left[~inside]
            if not len(left):
                break
        cut = np.ones(total, bool)
        cut[1:] = (first[1:] != first[:-1] + 1) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (level[1:] != level[:-1])
        begin = np.flatnonzero(cut)
        many = np.diff(np.append(begin, total))
        lo, hi, first = lo[begin], hi[begin], first[begin]
        key = mix(self.hashes(lo, hi) ^ (hi - lo).astype(np.uint64) ^ (level[begin].astype(np.uint64) << np.uint64(32)))
        span = mix(self.hashes(first, first + many - 1 + w) ^ ((lo - first) << 16 | many).astype(np.uint64))
        return first, many, key, span

    def _levels(self) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Names of a level with the words (lo to hi - 1) that decided about them, both in order."""
        x, n = self.x, len(self.x)
        begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        end = np.append(begin[1:], n)  # a run ends where other words begin, so those decide about it too
        names = mix(x[begin] ^ mix((end - begin).astype(np.uint64)))
        lo, hi = np.maximum(begin - 1, 0), np.minimum(end + 1, n)
        found = {}
        for depth in range(1, max(LEVELS) + 1):
            is_left = mix(names + np.uint64(depth)) >> np.uint64(63) == 0
            pair = np.append(is_left[:-1] & ~is_left[1:], False)
            at = np.flatnonzero(~np.concatenate([[False], pair[:-1]]))
            after, two = np.minimum(at + 1, len(names) - 1), pair[at]
            right = two | is_left[at]  # decided with the name after it; else with the one before it
            joined = mix(mix(names[at]) + names[after])
            lo, hi = np.where(right, lo[at], lo[np.maximum(at - 1, 0)]), np.where(right, hi[after], hi[at])
            names = np.where(two, joined, names[at])
            if depth in LEVELS:
                found[depth] = names, lo, hi
        for depth in LEVELS:
            yield depth, found[depth]
        yield 0, (x, np.arange(n), np.arange(1, n + 1))


def _before(places: np.ndarray, n: int) -> np.ndarray:
    """How many of the places are less than each number from 0 to n + 1."""
    return np.concatenate([[0], np.cumsum(np.bincount(places, minlength=n + 1))])


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the least value from a to b - 1, the first of equals."""
    at = np.arange(len(values))
    reach = np.floor(np.log2(b - a)).astype(np.int64) if len(a) else np.zeros(0, np.int64)
    out = np.zeros(len(a), np.int64)
    last = int(reach.max(initial=0))
    for k in range(last + 1):
        here = reach == k
        i, j = at[a[here]], at[b[here] - (1 << k)]
        out[here] = np.where(values[j] < values[i], j, i)
        if k == last:
            break
        i, j = at[: len(at) - (1 << k)], at[1 << k :]
        at = np.where(values[j] < values[i], j, i)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept_text``, ``kept_sha256``, ``spans``.

    ``kept_text`` is the text without the removed stretches and the white space after them;
    ``kept_sha256`` is of the kept words joined by one space.

    A word goes if a window of ``window`` words around it also starts elsewhere, in the same document or
    another; windows are judged on the input. ``spans`` are the removed stretches as [first, after) word
    numbers. A null text has no words; a text under ``window`` words stays whole. Repeated rows are
    copies, of which all long passages go. Null and repeated ids stay, row by row; other columns are not read.
    Key and span counts are combined in the map stage; the joins back can be split at a hot key.
    """
    if not 8 <= window <= 63:
        raise ValueError("windows of 8 to 63 words are covered")
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    # Two hashes name a row; rows equal in both columns are equal in their result.
    rows = rows.select(F.xxhash64("id", "text").alias("row"), F.xxhash64("text", F.lit(7)).alias("check"), "id", "text")
    keys = rows.select("text").mapInArrow(_keys(window), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    anchors = rows.select("row", "check", "text").mapInArrow(_anchors(window), "key bigint, span bigint, row bigint, check bigint, place bigint")
    shared = written(anchors.join(keys.where("n > 1"), "key"), "anchors")

    # A span that makes up all of its key is the only one; others share the key with different spans.
    spans = shared.groupBy("key", "span").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.min(F.struct("row", "check", "place")).alias("example"))
    open_spans = spans.where("times < n").select("key", "span", F.col("times").alias("n"), "example")
    wanted = open_spans.select("example.row", "example.check", F.struct("key", "span", "n", "example.place").alias("of")).groupBy("row", "check").agg(F.collect_list("of").alias("wanted"))
    windows = rows.join(wanted, ["row", "check"]).mapInArrow(_windows(window), "key bigint, span bigint, n bigint, bit int, window bigint")
    twice = windows.groupBy("key", "window").agg(F.sum("n").alias("times")).where("times > 1").select("key", "window")
    some = windows.join(twice, ["key", "window"]).groupBy("key", "span").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    all_of = spans.where("times = n").select("key", "span", F.lit(-1).cast("bigint").alias("mask"))
    marked = shared.drop("n").join(some.unionByName(all_of), ["key", "span"]).groupBy("row", "check").agg(F.collect_list(F.struct("place", "mask")).alias("marks"))
    joined = rows.join(marked, ["row", "check"], "left")
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string, spans array<array<bigint>>")
    return joined.select("id", "text", "marks").mapInArrow(_removed(window), schema).withColumnRenamed("id", id_col)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = utf8(batch.column(column))
    for lo, hi in slices(texts):
        yield lo, hi, texts[lo:hi]


def _keys(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _slices(batch, 0):
                _, _, key, _ = Passages(texts, window).anchors()
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return run


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _slices(batch, 2):
                found = Passages(texts, window)
                first, many, key, span = found.anchors()
                doc = np.searchsorted(found.starts, first, "right") - 1
                place = (first - found.starts[doc]) << 8 | many  # first window of the document, number of windows
                at = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(place)],
                                                 ["key", "span", "row", "check", "place"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            wanted = batch.column(names.index("wanted"))
            for lo, hi, texts in _slices(batch, names.index("text")):
                found = Passages(texts, window)
                part = wanted.slice(lo, hi - lo)
                of = part.flatten()
                doc = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                key, span, n, place = (of.field(c).to_numpy() for c in ("key", "span", "n", "place"))
                many = place & 255
                bit = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                first = np.repeat(found.starts[doc] + (place >> 8), many) + bit
                yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(c, many)) for c in (key, span, n)], pa.array(bit, pa.int32()), pa.array(found.hashes(first, first + window).view(np.int64))],
                                                 ["key", "span", "n", "bit", "window"])

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in _slices(batch, 1):
                n_words, n_removed, kept_texts, digests, stretches = [], [], [], [], []
                for text, marks in zip(texts, batch.column(2).slice(lo, hi - lo)):
                    words = text.split()
                    n_words.append(len(words))
                    spans = _stretches(marks, len(words), window) if marks.is_valid else []
                    for a, b in reversed(spans):
                        del words[a:b]
                    n_removed.append(sum(b - a for a, b in spans))
                    kept_texts.append(_cut(text, spans))
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    stretches.append(spans)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.binary()).cast(pa.string()),
                     pa.array(digests, pa.string()), pa.array(stretches, pa.list_(pa.list_(pa.int64())))], ["id", "n_words", "n_removed", "kept_text", "kept_sha256", "spans"])

    return run


def _cut(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of the spans and the white space after them."""
    if not spans:
        return text
    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)] + [len(text)]
    edges = [0, *[starts[k] for span in spans for k in span], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _stretches(marks: pa.ListScalar, n: int, window: int) -> list[list[int]]:
    """Removed stretches of one document from (place, mask) of its anchors."""
    place, mask = (marks.values.field(c).to_numpy() for c in ("place", "mask"))
    first, many = place >> 8, place & 255
    bit = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    repeated = np.repeat(mask, many) >> bit & 1 > 0
    at = (np.repeat(first, many) + bit)[repeated]
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    covered = np.concatenate([[0], (np.cumsum(steps[:-1]) > 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(covered))
    return edges.reshape(-1, 2).tolist()
