"""Ranked lexical search of a stated query set: posting lists in blocks of similar documents, skipped by exact bounds.

The queries are taken in blocks of bounded size; what a block needs of the documents is one forward table
(id, number of terms, the block's terms and their counts), written once. Counts over it give N, L and document frequencies.
A task then reads its part of that table slice by slice. In a slice every term has a posting list; a list
is clustered by the similarity of its documents (random projections of their weighted vectors, nearest of some
documents of the list), and every cluster is a block with a summary: the largest impact of each term that a query
asks together with the list's term. A summary's product with a query bounds the score of every document of the
block, so a block is skipped only if that bound is below the least score that can still be reported, and a
whole list only if all that documents outside the other lists can reach is below it. What is left is scored exactly.

The least reportable score of a query is the k-th best among a bounded sample of the documents, searched first, and then among those that
the task has seen; every bound is on the safe side, so the ranking is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vintara.llm.common import mix, shipped, utf8, written

#: A-Z to a-z, everything of ASCII that is no letter or digit to a space: a term is what ``split`` leaves.
FOLDED = bytes(ord(chr(b).lower()) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))
#: Weights and impacts are integers of this scale (see ``impacts``).
SCALE = 1_000_000_000
#: Queries of a block, and documents searched first for the least reportable score.
QUERIES, SEEDS = 512, 1 << 16
#: Documents times terms, and postings, of a slice.
CELLS, POSTINGS = 1 << 25, 1 << 21
#: Documents a block has on average, centroids a list has at most, dimensions of the projection.
BLOCK, CENTROIDS, DIMENSIONS = 32, 128, 24
#: Parts in which a query's rows are cut down before they meet in one.
PARTS = 256


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case."""
    return text.translate(FOLDED).split()


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a score per unit of its weight: saturating in its count, less in longer documents."""
    m = 100 - 50 + (50 * n.astype(np.int64) * n_docs) // max(n_terms, 1)
    return (SCALE * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, ``rank``, document, ``score``): the ``k`` documents of highest score above 0 for every row of ``items``.

    Equal scores go by ascending document id, null last. Every row of ``docs`` is a document, of repeated ids too; a null or
    empty text has no term, is never found and counts nowhere. Rows of ``items`` that are equal in id and text are one item, rows of one id with other
    texts are items of their own; one without a term has no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    shipped(spark)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    wanted = items.select(items[item_col].alias("item"), items[item_text_col].cast("string").alias("text")).where("text IS NOT NULL").distinct()
    blocks = max(-(-wanted.count() // QUERIES), 1)
    numbered = written(wanted.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "lexical-items")
    found = None
    for block in range(blocks):
        part = _search(texts, numbered.where(F.col("block") == block), k)
        found = part if found is None else found.unionByName(part)
    return found.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search(texts: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The best documents of one block of queries, whose texts the driver holds."""
    spark = texts.sparkSession
    rows = items.select("item", "text").toArrow()
    asked = [sorted(set(terms_of(t))) for t in utf8(rows.column("text"))]
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in asked for t in ts}))}
    queries = [np.array([vocabulary[t] for t in ts], np.int64) for ts in asked]
    id_type = texts.schema["id"].dataType.simpleString()
    forward = written(texts.mapInArrow(_forward(vocabulary), f"id {id_type}, n bigint, terms array<int>, tfs array<int>"), "lexical-forward")
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # the block's terms
        df[r.term] = r.df
    stated = Stated(queries, weights_of(df, n_docs), n_docs, n_terms, k)
    schema = f"query int, id {id_type}, score bigint"
    share = max(-(-n_docs // SEEDS), 1)
    seeds = _best(forward.where(F.pmod(F.xxhash64("id", "n"), F.lit(share)) == 0).mapInArrow(_searched(stated, {}), schema), k)
    least = {r.query: r.score for r in seeds.where(F.col("rank") == k).select("query", "score").collect()}  # one number a query
    found = _best(forward.mapInArrow(_searched(stated, least), schema), k)
    names = spark.createDataFrame(pa.table({"query": pa.array(range(len(queries)), pa.int32()), "item": rows.column("item")}))
    return found.join(names, "query").select("item", "rank", "id", "score")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each query; parts of a query are cut down before they meet."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    cut = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).drop("part")


def _forward(vocabulary: dict[bytes, int]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, terms, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(utf8(batch.column(1))):
                words = terms_of(text)
                if not words:
                    continue
                counts = Counter(words)
                here = counts.keys() & vocabulary.keys() if len(counts) < len(vocabulary) else [t for t in vocabulary if t in counts]
                terms += map(vocabulary.__getitem__, here)
                tfs += map(counts.__getitem__, here)
                ids.append(i)
                ns.append(len(words))
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                                              pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))], ["id", "n", "terms", "tfs"])

    return of


class Stated:
    """A block of queries: their terms, the terms' weights, and which terms are asked together with a term."""

    def __init__(self, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.queries = [q[weights[q] > 0] for q in queries]
        self.weights, self.n_docs, self.n_terms, self.k = weights, n_docs, n_terms, k
        together: dict[int, list[np.ndarray]] = {}
        for q in self.queries:
            for t in q.tolist():
                together.setdefault(t, []).append(q)
        self.together = {t: np.unique(np.concatenate(qs)) for t, qs in together.items()}
        signs = mix(np.arange(len(weights) * DIMENSIONS)).reshape(-1, DIMENSIONS) & np.uint64(1)
        self.signs = signs.astype(np.float32) * 2 - 1


class Slice:
    """The index of some documents: impacts, posting lists, and the blocks of the lists that queries need."""

    def __init__(self, stated: Stated, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        self.stated = stated
        rows = np.repeat(np.arange(len(n)), lengths)
        values = impacts(tfs, n[rows], stated.n_docs, stated.n_terms)
        self.impact = np.zeros((len(n), len(stated.weights)), np.int32)
        self.impact[rows, terms] = values
        weighted = values * stated.weights[terms]
        vectors = np.stack([np.bincount(rows, weighted * stated.signs[terms, d], len(n)) for d in range(DIMENSIONS)], 1)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.vectors = (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)
        order = np.argsort(terms, kind="stable")
        self.docs = rows[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(stated.weights) + 1))
        self.largest = np.zeros(len(stated.weights), np.int64)
        np.maximum.at(self.largest, terms, values)
        self.blocks: dict[int, tuple] = {}

    def blocked(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A list's documents block by block, where the blocks begin, and their summaries."""
        if term not in self.blocks:
            docs = self.docs[self.starts[term] : self.starts[term + 1]]
            starts = np.zeros(1, np.int64)
            centroids = min(-(-len(docs) // BLOCK), CENTROIDS)
            if centroids > 1:
                chosen = docs[np.arange(centroids) * len(docs) // centroids]
                nearest = (self.vectors[docs] @ self.vectors[chosen].T).argmax(1)
                order = np.argsort(nearest, kind="stable")
                docs = docs[order]
                starts = np.flatnonzero(np.append(True, np.diff(nearest[order]) > 0))
            summaries = np.maximum.reduceat(self.impact[np.ix_(docs, self.stated.together[term])], starts, axis=0)
            self.blocks[term] = docs, starts, summaries
        return self.blocks[term]

    def candidates(self, query: np.ndarray, least: int) -> np.ndarray:
        """Documents that may score ``least`` or more: those in blocks whose bound reaches it."""
        query = query[self.starts[query + 1] > self.starts[query]]
        weights = self.stated.weights
        reach = weights[query] * self.largest[query]
        order = np.argsort(reach, kind="stable")
        needed = query[order][np.cumsum(reach[order]) >= least]  # a document in none of these lists stays below
        marked = np.zeros(len(self.impact), bool)
        for term in needed.tolist():
            docs, starts, summaries = self.blocked(term)
            bounds = summaries[:, np.searchsorted(self.stated.together[term], query)].astype(np.int64) @ weights[query]
            marked[docs[np.repeat(bounds >= least, np.diff(np.append(starts, len(docs))))]] = True
        return np.flatnonzero(marked)

    def scores(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.impact[np.ix_(docs, query)].astype(np.int64) @ self.stated.weights[query]


def _searched(stated: Stated, least: dict[int, int]):
    """Best documents of every query among a task's; ``least``: scores under which a document can't be reported."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = {q: least.get(q, 1) for q in range(len(stated.queries))}
        best: list[list[tuple]] = [[] for _ in stated.queries]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            for lo, hi in _cuts(lengths, max(CELLS // max(len(stated.weights), 1), 16)):
                part = batch.slice(lo, hi - lo)
                ids = part.column(0).to_pylist()
                index = Slice(stated, part.column(1).to_numpy(), lengths[lo:hi], part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy())
                for q, query in enumerate(stated.queries):
                    docs = index.candidates(query, floor[q]) if len(query) else ()
                    if not len(docs):
                        continue
                    scores = index.scores(docs, query)
                    kept = scores >= floor[q]
                    best[q] += [(-s, ids[d] is None, ids[d]) for s, d in zip(scores[kept].tolist(), docs[kept].tolist())]
                    if len(best[q]) >= stated.k:
                        best[q] = sorted(best[q], key=lambda x: (x[0], x[1], x[2] if not x[1] else 0))[: stated.k]
                        floor[q] = max(floor[q], -best[q][-1][0]) if len(best[q]) == stated.k else floor[q]
        if kind is not None:
            rows = [(q, i, -s) for q, found in enumerate(best) for s, _, i in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["query", "id", "score"])

    return search


def _cuts(lengths: np.ndarray, docs: int) -> Iterator[tuple[int, int]]:
    """Stretches of at most so many documents and about ``POSTINGS`` postings."""
    lo, so_far = 0, np.cumsum(lengths)
    while lo < len(lengths):
        before = so_far[lo - 1] if lo else 0
        hi = min(max(int(np.searchsorted(so_far, before + POSTINGS, "right")), lo + 1), lo + docs)
        yield lo, hi
        lo = hi
