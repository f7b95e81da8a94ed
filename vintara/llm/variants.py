"""Groups of spelling variants: words one edit apart, found through a reduced alphabet.

Every letter is hashed to one of ``SYMBOLS`` symbols. Two words one edit apart have reduced words at most one edit apart, so
the whole one-edit neighbourhood of a reduced word (itself, all deletions, replacements and
insertions) holds the reduced words of all its near words. Neighbourhoods are generated as 64-bit polynomial
hashes, a few operations each whatever the length, joined with the hashes of the reduced vocabulary, and the pairs are
verified on the original words. A bitmap of 8 MB, made by Spark from the reduced vocabulary, drops neighbours that no word
has before they are shuffled; where a vocabulary fills it, more are shuffled, none are lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vintara.llm.common import bitmap, mix, shipped, utf8, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Of the runs of a document, those whose hash this divides lose a code point.
DAMAGED = 199
#: Fewer symbols make smaller neighbourhoods and more pairs to verify.
SYMBOLS = 8
#: Bits of the bitmap.
BITS = 1 << 26
#: A neighbour carries its word up to this length; a longer word is joined back by its hash.
CARRIED = 64
#: Words that a task counts before it passes them on, and hashes made at once (results don't depend on them).
COUNTED, AT_ONCE = 400_000, 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))


def word_counts(docs: DataFrame, least_letters: int = 6, least_count: int = 5, damaged: int = DAMAGED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, counted over all documents.

    A run whose crc32 of ``<id>:<run>`` is divisible by ``damaged`` has lost the code point at that hash modulo its length
    (0: none is). Words have at least so many code points and occurrences. A null text has no word; a null id is written as nothing.
    """
    shipped(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].cast("string").alias("text")).where("text IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                runs = Counter(RUN.findall(text.lower().decode("utf-8", "replace")))  # bytes.lower knows A-Z only
                start = zlib.crc32(f"{name}:".encode())
                for run, n in runs.items():
                    if damaged and (h := zlib.crc32(run.encode(), start)) % damaged == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least_letters:
                        counts[run] += n
                if len(counts) > COUNTED:
                    yield _counts(counts)
                    counts.clear()
        yield _counts(counts)

    counted = texts.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counts(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """One row per word of (word, n): word, ``form``, ``root``, n, ``n_near``, ``form_n``.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest n, the
    first in code-point order among equals, if that n is at least ``ratio`` times (2 or more) the word's; else null. The root is reached by following forms.
    Equal words are one, of their summed n; null words are left out; no words give no rows; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("a form is at least twice as common as its word, so that forms lead to an end")
    spark = words.sparkSession
    shipped(spark)
    known = written(words.where(words["word"].isNotNull()).groupBy(words["word"].alias("word")).agg(F.sum(words["n"]).cast("bigint").alias("n")), "variants-words")
    best = near_words(known).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("first"))
    counted = known.join(best.hint("merge"), "word", "left")
    led = F.expr(f"-first.col1 >= {ratio} * n")
    groups = written(counted.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(led, F.col("first.near")).alias("form"), F.when(led, F.expr("-first.col1")).alias("form_n")), "variants-forms")
    led_words = groups.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    return groups.join(_roots(led_words).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def near_words(known: DataFrame) -> DataFrame:
    """(word, near, near_n) of every pair of words one edit apart, in both directions, each once.

    Nothing of the vocabulary's size is sent whole: Spark sizes what a task makes of a row by the compressed words alone, so it
    would broadcast all neighbourhoods where those are under its threshold.
    """
    filled = _bitmap(known)
    vocabulary = known.mapInArrow(_reduced, "key bigint, near string, near_n bigint").hint("merge")
    near = F.levenshtein("word", "near", 1) == 1
    short = known.where(F.char_length("word") <= CARRIED).select("word").mapInArrow(_neighbours(filled, True), "word string, key bigint")
    pairs = short.join(vocabulary, "key").where(near).select("word", "near", "near_n")
    # A long word has neighbours in proportion to its length, so they carry its hash.
    longs = known.where(F.char_length("word") > CARRIED).select("word").withColumn("h", F.xxhash64("word"))
    met = longs.mapInArrow(_neighbours(filled, False), "h bigint, key bigint").join(vocabulary, "key").select("h", "near", "near_n")
    return pairs.unionByName(longs.join(met.hint("merge"), "h").where(near).select("word", "near", "near_n"))


def _roots(led: DataFrame) -> DataFrame:
    """The end of every chain of forms. A form is ``ratio`` times as common as its word, so chains are short; each round doubles the step."""
    while True:
        step = led.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = written(led.join(step.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        led = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return led


def _bitmap(known: DataFrame) -> bytes:
    """Which hashes of reduced words there are, modulo ``BITS``."""
    return bitmap(known.mapInArrow(_reduced, "key bigint, near string, near_n bigint").select(F.pmod("key", F.lit(BITS)).alias("place")), BITS)


def symbols(codes: np.ndarray) -> np.ndarray:
    """The symbols that letters are hashed to, as numbers for the polynomial."""
    return _values()[(mix(codes) % np.uint64(SYMBOLS)).astype(np.int64)]


def _values() -> np.ndarray:
    return mix(np.arange(1, SYMBOLS + 1))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of words of one length, their symbols, and the powers of the base, a bounded number of words at once."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        places, step = np.flatnonzero(lengths == length), max(AT_ONCE // (2 * SYMBOLS * (length + 1)), 1)
        powers = np.array([pow(BASE, k, 1 << 64) for k in range(length + 1)], np.uint64)
        for lo in range(0, len(places), step):
            part = places[lo : lo + step]
            codes = np.frombuffer("".join([words[i] for i in part.tolist()]).encode("utf-32-le"), "<u4").reshape(len(part), length)
            yield part, symbols(codes), powers


def _hashes(words: list[str]) -> np.ndarray:
    found = np.zeros(len(words), np.uint64)
    for places, s, powers in _by_length(words):
        found[places] = (s * powers[:-1]).sum(1, dtype=np.uint64)
    return found


def neighbourhoods(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, hash) of the distinct reduced words at most one edit from each word's reduced word."""
    for places, s, powers in _by_length(words):
        before = np.concatenate([np.zeros((len(s), 1), np.uint64), np.cumsum(s * powers[:-1], 1, dtype=np.uint64)], 1)
        whole = before[:, -1:]
        after = whole - before
        deleted = before[:, :-1] + after[:, 1:] * INVERSE
        replaced = [whole + (v - s) * powers[:-1] for v in _values()]  # a symbol by itself: the word as it is
        inserted = [before + v * powers + after * np.uint64(BASE) for v in _values()]
        found = np.concatenate([deleted, *replaced, *inserted], 1)
        found.sort(axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        yield places[np.nonzero(first)[0]], found[first]


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0)
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(words.to_pylist()).view(np.int64)), words, batch.column(1)], ["key", "near", "near_n"])


def _neighbours(filled: bytes, carried: bool):
    """Neighbours that the bitmap knows, with their word or its hash."""
    sent = SparkSession.active().sparkContext.broadcast(filled)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            column = batch.column(0 if carried else 1)
            for places, hashes in neighbourhoods(batch.column(0).to_pylist()):
                at = hashes % np.uint64(BITS)
                known = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                yield pa.RecordBatch.from_arrays([column.take(pa.array(places[known])), pa.array(hashes[known].view(np.int64))], ["word" if carried else "h", "key"])

    return of
