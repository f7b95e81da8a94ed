"""Token counts: every distinct pre-token is counted once and joined to the pre-tokens of the documents.

A tokenizer that cuts at white space before it looks for pieces gives a text the sum of the counts
of its white-space-delimited pre-tokens. Spark makes the table of distinct pre-tokens, combined in the map stage, and has each cut into pieces once.
A document is then its pre-tokens with their frequencies. The most frequent pre-tokens, a bounded table, are sent to
the scan, so that common words are summed where they stand; the frequencies of all others are joined to the table. Token ids are never built for a document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vintara.llm.common import shipped, slices, utf8, written

#: Bytes of distinct pre-tokens that a task counts before it passes them on (results don't depend on it).
TABLE_BYTES = 64 << 20
#: Pre-tokens that are sent to the scan, and the bytes that one may have: 25 MB at most.
FREQUENT, SHORT = 1 << 18, 96


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``tokenizer_path`` is a file of the library ``tokenizers`` whose pre-tokenizer drops white space
    (refused otherwise). Counts are those of ``encode(text, add_special_tokens=False)``; strings of
    special tokens inside a text are handled as the library does by default. A null text counts
    as empty (0 bytes, 0 tokens); null and repeated ids stay, row by row; other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = file.read()
    if not _cuts_at_white_space(vocabulary):
        raise ValueError(f"{tokenizer_path}: tokens of this tokenizer may span or hold white space")
    shipped(docs.sparkSession)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    table = pre_tokens(texts, vocabulary)
    common = _most_frequent(table.where(F.octet_length("word") <= SHORT)).select("word", "pieces").toArrow()
    known = dict(zip(common.column("word").to_pylist(), common.column("pieces").to_pylist()))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, n_bytes bigint, n_common bigint, rare array<struct<word:binary,n:bigint>>"
    rows = written(texts.mapInArrow(_frequencies(docs.sparkSession.sparkContext.broadcast(known)), schema).withColumn("row", F.monotonically_increasing_id()), "token-rows")
    single = rows.where(F.size("rare") > 0).select("row", F.explode("rare").alias("r")).select("row", "r.*")
    summed = single.join(table.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_rare"))
    return rows.join(summed, "row", "left").select(F.col("id").alias(id_col), "n_bytes", (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_tokens"))


def _most_frequent(table: DataFrame) -> DataFrame:
    """The most frequent rows of (word, n), ``FREQUENT`` at most, by a limit of n from counts of counts: no table is sorted."""
    level = F.floor(F.log2("n") * 16)
    sizes = table.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()  # about a thousand rows at most
    least, total = float("inf"), 0
    for r in sorted(sizes, key=lambda r: -r.level):
        total += r.words
        if total > FREQUENT:
            break
        least = r.level
    return table.where(level >= F.lit(least))


def pre_tokens(texts: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n, pieces): the distinct pre-tokens of all texts, their occurrences, and the number of pieces of each."""
    counted = texts.where("text IS NOT NULL").select("text").mapInArrow(_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    sent = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _load(sent.value)
        for batch in batches:
            words = [w.decode() for w in batch.column(0).to_pylist()]
            counts = [len(e) for lo, hi in slices(words) for e in tokenizer.encode_batch_fast(words[lo:hi], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["word", "n", "pieces"])

    return written(counted.mapInArrow(cut, "word binary, n bigint, pieces bigint"), "token-pieces")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    held = 0

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in utf8(batch.column(0)):
            before = len(counts)
            counts.update(text.split())
            held += 100 * (len(counts) - before) + (len(text) if len(text) > TABLE_BYTES // 8 else 0)
            if held > TABLE_BYTES:
                yield found()
                counts.clear()
                held = 0
    yield found()


def _frequencies(sent):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            texts = utf8(batch.column(1))
            for lo, hi in slices(texts):
                common, rare, ends, words = [], [], [0], []
                for text in texts[lo:hi]:
                    counts = Counter(text.split())
                    here = counts.keys() & known.keys()
                    common.append(sum(counts[w] * known[w] for w in here))
                    others = counts.keys() - here
                    words += others
                    rare += map(counts.__getitem__, others)
                    ends.append(len(words))
                pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(rare, pa.int64())], ["word", "n"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array(common, pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["id", "n_bytes", "n_common", "rare"])

    return of


def _load(vocabulary: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _cuts_at_white_space(vocabulary: str) -> bool:
    """Whether tokens of a probe with all kinds of white space are those of its words."""
    tokenizer = _load(vocabulary)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    words = ["It's", "a", "prøbe", "12,345", "!?'s", "日本"]
    return all(ids(space.join(words) + space) == [i for w in words for i in ids(w)] for space in (" ", "  ", "\n", "\t", "\r\n", "\v\f"))
