"""What the operators share: the word definition, folds, slices of a batch, written intermediates."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import vintara
from vintara.session import shared_folder

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"


WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: The first k bytes of 8, and the bytes of a word up to which it is hashed 8 at a time with all others.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 64


def shipped(spark: SparkSession) -> None:
    """Name this package's folder to the Python workers, who may run elsewhere (a cluster also needs ``--py-files`` or a path it shares)."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    root = str(Path(vintara.__file__).resolve().parent.parent)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """Fold of a document: crc32 of its id written as text (a null id as nothing), modulo the number of folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; a null text is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(texts: list, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch into stretches of about ``limit`` bytes, a longer text being one of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def bitmap(places: DataFrame, bits: int) -> bytes:
    """Which of the numbers 0 to ``bits`` - 1 the column ``place`` holds, a bit each: bounded, whatever the rows."""
    part = 32_768  # the bits of a Spark bitmap
    rows = places.groupBy(F.floor(F.col("place") / part).alias("part")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(part))).alias("bits"))
    found = bytearray(-(-bits // part) * part // 8)
    for r in rows.collect():
        found[r.part * part // 8 : r.part * part // 8 + len(r.bits)] = r.bits
    return bytes(found)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[s : s + n]`` of every (s, n), one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): equal in, equal out, well spread."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after the other, and the number of words of each."""
    joined = b"\n".join([b"", *texts, bytes(16)])
    joined += bytes(-len(joined) % 8)
    size = sum(map(len, texts)) + len(texts) + 1
    blank = WHITE[np.frombuffer(joined, np.uint8, size)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    whole = np.frombuffer(joined, "<u8")

    def bytes_at(places: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Up to 8 bytes from each place, out of two aligned numbers."""
        word, bit = places >> 3, (places & 7).astype(np.uint64) << np.uint64(3)
        return (whole[word] >> bit | whole[word + 1] << np.uint64(1) << (np.uint64(63) - bit)) & LOW[np.minimum(many, 8)]

    h = mix(mix(lengths.astype(np.uint64)) ^ bytes_at(starts, lengths))
    left = np.flatnonzero(lengths > 8)
    for k in range(8, LONG, 8):
        h[left] = mix(h[left] ^ bytes_at(starts[left] + k, lengths[left] - k))
        left = left[lengths[left] > k + 8]
    for i in left.tolist():
        h[i] = xxhash.xxh64_intdigest(joined[starts[i] : starts[i] + lengths[i]])
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
    return h, np.diff(ends, prepend=0)
