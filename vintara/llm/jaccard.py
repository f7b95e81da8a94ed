"""Similarity join of documents by the Jaccard similarity of their word n-grams, with Bayesian pruning.

1. Equal texts are one class. Each class has a MinHash signature of ``BANDS * ROWS`` values.
2. Classes that agree in a band share a bucket; buckets with the same members count once. Inside a bucket,
   cut into blocks of ``BLOCK`` classes, pairs are compared ``STEP`` values at a time. After m matches among n, a
   uniform prior makes P(similarity >= t) the binomial distribution function of m among n + 1 at t; a
   pair under ``TOLERANCE`` is dropped. Only the spanning stars of what survives leave a task.
3. The stars' components hold every surviving pair. Their classes meet again, block by block, with their
   n-grams: pairs are pruned in the same way, and the rest is verified exactly and counted.

No step emits the pairs of a group: blocks are at most ``BLOCK`` by ``BLOCK``, and links leave a task as
counts per class and stars. Chance of missing a pair of similarity 0.8: (1 - 0.8 ** ROWS) ** BANDS = 2e-5 for the
buckets and about ``TOLERANCE`` per comparison; it falls fast above.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vintara.llm.common import mix, utf8, written
from vintara.llm.graph import components

BANDS, ROWS, STEP = 28, 5, 20
BLOCK = 256
TOLERANCE = 1e-6
#: Hashed words that a task remembers before it starts afresh.
REMEMBERED = 600_000

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TERMS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


class HashedWords(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; a text of fewer words (but one) is one n-gram."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = mix(h ^ words[k : len(words) - n + 1 + k]) + np.uint64(k)
    return np.unique(h)


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values, folded into 16 bits each."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(least, (_FACTORS[:, None] * x[None, k : k + 2048] + _TERMS[:, None]).min(1), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def least_matches(threshold: float) -> list[tuple[int, int]]:
    """(n, m): after n values a pair needs m matches, or it is dropped."""
    table = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        chance, m = 0.0, -1
        while chance < TOLERANCE:
            m += 1
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        table.append((n, m))
    return table


def surviving(left: np.ndarray, right: np.ndarray | None, table: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two lists of signatures (of one with itself, each pair once) that no comparison drops."""
    n, m = table[0]
    other = left if right is None else right
    alive_a, alive_b = [], []
    for k in range(0, len(left), 64):
        matches = (left[k : k + 64, None, :n] == other[None, :, :n]).sum(2)
        a, b = np.nonzero(matches >= m)
        keep = a + k < b if right is None else slice(None)
        alive_a.append(a[keep] + k), alive_b.append(b[keep])
    a, b = np.concatenate(alive_a), np.concatenate(alive_b)
    for n, m in table[1:]:
        matches = (left[a, :n] == other[b, :n]).sum(1)
        a, b = a[matches >= m], b[matches >= m]
    return a, b


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (the least index) of each of n items under the links a - b."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return np.array([find(i) for i in range(n)], np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: id, ``class_id``, ``copy_id``, ``n_links``.

    ``copy_id`` is the least id among equal texts, ``n_links`` the number of other texts at least ``threshold``
    similar, ``class_id`` the least id that a chain of copies and links reaches. A null text counts as
    empty; empty texts, or texts of white space only, are copies if equal and linked to nothing. A text of
    fewer than ``n`` words is one n-gram. Null ids come last among copies (a class of null ids alone has a null
    class_id); repeated rows stay, row by row; other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.unhex(F.md5("text")))
    copies = written(rows.groupBy("node").agg(F.min("id").alias("copy_id")), "copies")
    signed = written(rows.select("node", "text").mapInArrow(_signed(n), "node binary, signature binary").dropDuplicates(["node"]), "signatures")

    bands = signed.mapInArrow(_bands, "bucket bigint, node binary")
    members = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    buckets = members.where("size > 1").groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    placed = bands.join(buckets, "bucket").join(signed, "node").withColumn("group", F.col("bucket"))
    survivors = _by_block(placed, "signature").mapInArrow(_pruned(threshold), "u binary, v binary")
    groups = components(survivors, "candidates")

    groups = groups.join(groups.groupBy("root").agg(F.count("*").alias("size")), "root")
    # Members grow with the input: they are never broadcast, at no size, and the text moves once.
    texts = rows.join(groups.hint("merge"), "node").dropDuplicates(["node"])
    grams = texts.select("root", "size", "node", "text").mapInArrow(_grams(n), "root binary, size bigint, node binary, grams binary")
    blocked = _by_block(grams.withColumn("group", F.xxhash64("root")), "grams")
    verified = written(blocked.mapInArrow(_verified(threshold), "node binary, links bigint, root binary"), "links")
    links = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")), "classes")
    named = classes.join(copies, "node")
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    of_node = copies.join(links, "node", "left").join(classes.join(least, "root").select("node", "class_id"), "node", "left")
    of_node = of_node.select("node", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return rows.select("id", "node").join(of_node, "node").select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links")


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = HashedWords()
        for batch in batches:
            done: dict[bytes, bytes] = {}
            for node, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if node not in done and len(grams := ngrams(words.of(text), n)):
                    done[node] = signature(grams).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(done.keys(), pa.binary()), pa.array(done.values(), pa.binary())], ["node", "signature"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _matrix(batch.column(1).to_pylist()).reshape(batch.num_rows, BANDS, ROWS)
        keys = mix(np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (batch.num_rows, 1)))
        for k in range(ROWS):
            keys = mix(keys ^ values[:, :, k].astype(np.uint64))
        node = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), node], ["bucket", "node"])


def _matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint16).reshape(len(signatures), -1)


def _by_block(rows: DataFrame, payload: str) -> DataFrame:
    """Rows of (group, size, node, payload), each sent to the pairs of blocks of its group that it is in.

    Partitions are sorted by group and pair of blocks; a group of at most ``BLOCK`` is one pair.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = rows.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    dealt = dealt.select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", payload)
    return dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes]]]:
    """(block of each row or None for a pair i = i, nodes, payloads) of every run of equal (group, i, j)."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = np.stack([table.column(k).to_numpy() for k in range(3)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()] if len(keys) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield _group(table.slice(a, b - a))
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield _group(rest)


def _group(table: pa.Table):
    blocks = table.column(3).to_numpy() if table.column(1)[0] != table.column(2)[0] else None
    return blocks, table.column(4).to_pylist(), table.column(5).to_pylist()


def _pairs(blocks: np.ndarray | None, signatures: np.ndarray, table: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    if blocks is None:
        return surviving(signatures, None, table)
    left, right = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    if len(left) == len(blocks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)  # the other block is empty; these meet elsewhere
    a, b = surviving(signatures[left], signatures[right], table)
    return left[a], right[b]


def _pruned(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, u, v = least_matches(threshold), [], []
        for blocks, nodes, signatures in _groups(batches):
            if len(nodes) > 1:
                a, b = _pairs(blocks, _matrix(signatures), table)
                for i, root in enumerate(stars(len(nodes), a, b).tolist()):
                    if i != root:
                        u.append(nodes[i]), v.append(nodes[root])
            if len(u) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return run


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = HashedWords()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                grams = [ngrams(words.of(t), n).tobytes() for t in utf8(part.column(3))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(grams, pa.binary())], ["root", "size", "node", "grams"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = least_matches(threshold)
        for blocks, nodes, payloads in _groups(batches):
            if len(nodes) < 2:
                continue
            grams = [np.frombuffer(p, np.uint64) for p in payloads]
            a, b = _pairs(blocks, np.stack([signature(g) for g in grams]), table)
            a, b = _exact(grams, a, b, threshold)
            links = np.bincount(np.concatenate([a, b]), minlength=len(nodes))
            root = stars(len(nodes), a, b)
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in linked], pa.binary()), pa.array(links[linked]), pa.array([nodes[root[i]] for i in linked], pa.binary())], ["node", "links", "root"])

    return run


def _exact(grams: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose Jaccard similarity, counted gram by gram, reaches the threshold."""
    keep = np.zeros(len(a), bool)
    used = np.unique(np.concatenate([a, b]))
    if not len(used):
        return a, b
    names, numbers = np.unique(np.concatenate([grams[i] for i in used]), return_inverse=True)
    ends = np.cumsum([len(grams[i]) for i in used])
    own = dict(zip(used.tolist(), np.split(numbers, ends[:-1])))
    mark, current = np.zeros(len(names), bool), -1
    for k in np.argsort(a, kind="stable").tolist():
        i, j = int(a[k]), int(b[k])
        if i != current:
            mark[:] = False
            mark[own[i]] = True
            current = i
        both = int(np.count_nonzero(mark[own[j]]))
        keep[k] = both >= threshold * (len(own[i]) + len(own[j]) - both) - 1e-9
    return a[keep], b[keep]
