"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index.

Terms are the letter runs of a text, in lower case. The fit takes at most ``bound`` distinct texts of each label as examples and indexes every term
of theirs. A term's weight is its count times its inverse document frequency over all documents, times its telling: how surely and how much
more common it is among examples of label 1 (likelihood ratio and lift), but ``LEAST`` at least. So neighbours agree first in telling words and in how dense
these are, and texts without any are compared by all their words. The index holds each term's postings block by block with the block's
largest weight; blocks whose bound is under the k-th best cosine are skipped, and the neighbours are exact.
Votes are weighted by cosine and by how many rows of its label an example stands for, which calibrates the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vintara.llm.common import hashed_words, ragged, shipped, slices, utf8, written
from vintara.llm.sample import labelled_sample, sampled_texts

LETTERS = re.compile(r"[^\W\d_]+")
#: ASCII as the terms have it: letters in lower case, all else a space; other bytes stay.
SPACED = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(256))
ASCII = bytes(range(128))
#: The capital sigma, which is lowered by the letters around it.
SIGMA = "\u03a3".encode()
#: Distinct characters beyond ASCII that are no letters, up to which each is replaced in a text at once.
FEW = 32
#: Likelihood ratio (chi-square, one degree) at which a term has half of its full telling.
SURE = 20.0
#: Telling of a term that is no more common under label 1.
LEAST = 0.01
BLOCK = 128
#: Blocks of the first visit.
FIRST = 4
#: Chord distance at which a vote has half the weight of one at distance 0.
HALF = 0.2


def spaced(text: bytes) -> bytes:
    """The matches of ``LETTERS`` in the text in lower case, parted by spaces: what is no letter is replaced."""
    if SIGMA in text:
        return " ".join(LETTERS.findall(text.decode("utf-8", "replace").lower())).encode()
    found = text.translate(SPACED)
    if found.isascii():
        return found
    lowered = found.decode("utf-8", "replace").lower()
    # Broken bytes may meet when ASCII is taken out, so what stands for them is always looked for.
    others = {"\ufffd", *found.translate(None, ASCII).decode("utf-8", "replace").lower()}
    others = [c for c in others if not c.isalnum() or c.isdecimal()]
    if len(others) > FEW:
        return " ".join(LETTERS.findall(lowered)).encode()
    for c in others:
        lowered = lowered.replace(c, " ")
    return lowered.encode()


def terms_of(text: bytes) -> list[str]:
    return spaced(text).decode().split()


def vector_of(text: bytes, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and counts of a whole text's terms that the examples have, in order, and the number of its terms in all."""
    counts = Counter(terms_of(text))
    found = [t for t in counts if t in ids]
    places = np.array([ids[t] for t in found], np.int64)
    order = np.argsort(places)
    return places[order], np.array([counts[t] for t in found], np.float64)[order], len(counts)


class Terms:
    """Places of terms in a list, found by their 64-bit hashes for many texts at once."""

    def __init__(self, terms: list[str]):
        hashes = hashed_words([" ".join(terms).encode()])[0]
        self.size, bits = len(terms), len(terms).bit_length() + 1
        self.places = np.argsort(hashes)
        self.hashes, self.shift = hashes[self.places], np.uint64(64 - bits)
        self.firsts = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def places_of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of the term of each hash, -1 if there is none."""
        of = (hashes >> self.shift).astype(np.int64)
        at, ends, out = self.firsts[of], self.firsts[of + 1], np.full(len(hashes), -1)
        left = np.flatnonzero(at < ends)
        while len(left):
            same = self.hashes[at[left]] == hashes[left]
            out[left[same]] = self.places[at[left[same]]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < ends[left]]
        return out

    def counted(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted numbers text x size + place of the terms in the texts, their counts, and how many terms of any kind each text has."""
        hashes, sizes = hashed_words([spaced(t) for t in texts])
        places = self.places_of(hashes)
        known = places >= 0
        keys, counts = np.unique(np.repeat(np.arange(len(texts)), sizes)[known] * self.size + places[known], return_counts=True)
        return keys, counts, sizes

    def vectors_of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """What ``vector_of`` gives for each text, but the last number counts repeats."""
        keys, counts, sizes = self.counted(texts)
        ends = np.searchsorted(keys, np.arange(len(texts) + 1) * self.size)
        for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            yield keys[lo:hi] - i * self.size, counts[lo:hi].astype(np.float64), int(sizes[i])


def telling(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Telling of terms that stand in ``a`` of the n1 examples of label 1 and in ``b`` of the n0 others."""
    if not n1 or not n0:
        return np.full(len(a), LEAST)

    def part(x: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x * float(n0 + n1) / (total * float(n))), 0.0)

    ratio = 2 * (part(a, a + b, n1) + part(b, a + b, n0) + part(n1 - a, n1 + n0 - a - b, n1) + part(n0 - b, n1 + n0 - a - b, n0))
    lift = (a / n1) / ((b + 0.5) / n0)
    return np.where(lift > 1, np.maximum(ratio / (ratio + SURE) * (1 - 1 / np.maximum(lift, 1)) ** 2, LEAST), LEAST)


class Index:
    """Block-max inverted index of the examples; examples of one vector are one entry."""

    def __init__(self, terms: list[str], df: np.ndarray, n_docs: int, examples: list[tuple[int, int, float, np.ndarray, np.ndarray]], k: int):
        """examples: (number, label, rows it stands for, term ids, counts)."""
        self.terms, self.k = terms, k
        sides = [np.zeros(len(terms)), np.zeros(len(terms))]
        for _, label, _, ids, _ in examples:
            sides[label][ids] += 1
        n1 = sum(e[1] for e in examples)
        self.telling = telling(sides[1], sides[0], n1, len(examples) - n1)
        self.weights = (np.log((1 + n_docs) / (1 + df)) + 1) * self.telling
        self.prior = (sum(e[1] * e[2] for e in examples) + 1) / (sum(e[2] for e in examples) + 2)
        #: Score of a text without a word: nothing in it is toxic, if that could be learned.
        self.without = 0.0 if 0 < n1 < len(examples) else self.prior
        entries: dict[tuple, list] = {}
        for i, label, stands, ids, counts in sorted(examples, key=lambda e: e[0]):
            values = self.scaled(ids, counts)
            if len(ids):
                entry = entries.setdefault((ids.tobytes(), values.tobytes()), [i, 0.0, 0.0, ids, values])
                entry[1] += label * stands
                entry[2] += stands
        # Neighbours in this order share their heaviest term, which keeps the bounds of the blocks tight.
        order = sorted(entries.values(), key=lambda e: (int(e[3][e[4].argmax()]), -float(e[4].max()), e[0]))
        self.ids = np.array([e[0] for e in order], np.int64)
        self.labels = np.array([e[1] / e[2] for e in order])
        self.stands = np.array([e[2] for e in order])
        self.unit = float(np.median([e[2] for e in examples])) if examples else 1.0
        n_blocks = max(-(-len(order) // BLOCK), 1)
        places = np.repeat(np.arange(len(order)), [len(e[3]) for e in order]) if order else np.zeros(0, np.int64)
        flat = np.concatenate([e[3] for e in order]) if order else np.zeros(0, np.int64)
        values = np.concatenate([e[4] for e in order]) if order else np.zeros(0)
        self.block_max = np.zeros((len(terms), n_blocks), np.float32)
        np.maximum.at(self.block_max, (flat, places // BLOCK), np.nextafter(values.astype(np.float32), np.float32(2)))  # rounded up
        by = np.lexsort((places, flat))
        # Of each term the postings of all blocks lie together; row t of ``starts`` says where those of its blocks begin and the last ends.
        bounds = np.searchsorted((flat * n_blocks + places // BLOCK)[by], np.arange(n_blocks * len(terms) + 1))
        self.starts = bounds[n_blocks * np.arange(len(terms))[:, None] + np.arange(n_blocks + 1)]
        self.places, self.values, self.numbers = places[by], values[by], np.arange(len(by))

    def scaled(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = counts * self.weights[ids]
        norm = np.linalg.norm(values)
        return values / norm if norm else values

    def nearest(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest entries with a term in common, ties to the earlier place."""
        places, cosines, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        if not len(ids) or not len(self.ids):
            return places, cosines
        weights = self.scaled(ids, counts)
        bounds = weights @ self.block_max[ids]
        order = np.argsort(-bounds, kind="stable")
        bounds = bounds[order]
        # A few blocks at a time: a visit costs more than the postings of a block, and twice as many each time leave few visits.
        of, done, step = self.starts[ids], 0, FIRST
        while done < len(order):
            here = order[done : done + step][(bounds[done : done + step] > 0) & (bounds[done : done + step] >= kth - 1e-6)]
            if not len(here):
                break
            done, step = done + step, 2 * step
            starts = of[:, here].ravel()
            lengths = of[:, here + 1].ravel() - starts
            held = ragged(self.numbers, starts, lengths)
            scores = np.bincount(self.places[held], np.repeat(weights.repeat(len(here)), lengths) * self.values[held], len(self.ids))
            found = np.flatnonzero(scores > max(kth - 1e-12, 0))
            places, cosines = np.concatenate([places, found]), np.concatenate([cosines, scores[found]])
            best = np.lexsort((places, -np.round(cosines, 12)))[: self.k]
            places, cosines = places[best], cosines[best]
            kth = cosines[-1] if len(best) == self.k else 0.0
        return places, cosines

    def score(self, ids: np.ndarray, counts: np.ndarray, n_terms: int) -> tuple[float, list[int], list[float]]:
        if not n_terms:
            return float(self.without), [], []
        places, cosines = self.nearest(ids, counts)
        distance = np.sqrt(np.maximum(2 - 2 * cosines, 0))
        votes = self.stands[places] / self.unit * HALF / (HALF + distance)
        score = (float(votes @ self.labels[places]) + 0.5 * self.prior) / (float(votes.sum()) + 0.5)
        return min(max(score, 0.0), 1.0), self.ids[places].tolist(), cosines.tolist()


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 bound: int = 600, k: int = 15) -> tuple[Index, list]:
    """Learn from labelled documents where ``learn`` (a column over the labels' rows) holds: the index, and the ids of its examples by number.

    Null labels and texts teach nothing, and a null id joins no label; of several labels of an id the largest holds. ``bound``
    limits the distinct texts of each label, and so the index; a text that has both labels is an example of both. An example's id
    is the least of the learned documents with its text, of any type; document frequencies cover all documents.
    """
    shipped(docs.sparkSession)
    marked = labels.where(learn & labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max((labels[label_col].cast("int") > 0).cast("int")).alias("label"))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    learned = texts.where("text IS NOT NULL").select("id", F.xxhash64("text").alias("h")).join(marked, "id")
    sample = written(labelled_sample(learned.select("h", "label"), "label", bound), "toxicity-sample")
    # At most 2 x ``bound`` hashes, sent to the scan, so that no text moves but the examples'.
    examples = written(sampled_texts(texts.where("text IS NOT NULL").select(F.xxhash64("text").alias("h"), "text"), sample.select("h").distinct(), ["h"]), "toxicity-examples")
    named = learned.join(F.broadcast(sample.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.min("id").alias("id"))
    rows = sample.join(examples, "h").join(named, "h").orderBy("h", "label").select("label", "of", "id", "text").toArrow().to_pylist()
    vocabulary = {t: i for i, t in enumerate(sorted({t for r in rows for t in terms_of(r["text"].encode())}))}
    sizes = Counter(r["label"] for r in rows)
    df = np.zeros(len(vocabulary) + 1)
    for r in texts.select("text").mapInArrow(_frequencies(list(vocabulary)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the examples' terms
        df[r.term] = r.df
    found = [(i, r["label"], r["of"] / sizes[r["label"]], *vector_of(r["text"].encode(), vocabulary)[:2]) for i, r in enumerate(rows)]
    return Index(list(vocabulary), df[:-1], int(df[-1]), found, k), [r["id"] for r in rows]


def score_toxicity(docs: DataFrame, model: tuple[Index, list], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``score`` (0 to 1), ``evidence`` (ids of the nearest examples) and their ``cosines``.

    A null text counts as empty. A text without a word has the score 0 (the prior share where one label or none was
    learned) and no evidence, one without a word of any example the prior share. Null and repeated ids stay, row by row; other columns are not read.
    """
    shipped(docs.sparkSession)
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = sent.value
        terms = Terms(index.terms)
        for batch in batches:
            texts = utf8(batch.column(1))
            found = [index.score(*vector) for lo, hi in slices(texts) for vector in terms.vectors_of(texts[lo:hi])]
            scores, evidence, cosines = zip(*found) if found else ((), (), ())
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([[names[i] for i in e] for e in evidence], pa.list_(kind)), pa.array(cosines, pa.list_(pa.float64()))],
                                             ["id", "score", "evidence", "cosines"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(score, f"id {kind}, score double, evidence array<{kind}>, cosines array<double>").withColumnRenamed("id", id_col)


def _frequencies(vocabulary: list[str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, df, n = Terms(vocabulary), np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            texts = utf8(batch.column(0))
            for lo, hi in slices(texts):
                df[:-1] += np.bincount(terms.counted(texts[lo:hi])[0] % max(terms.size, 1), minlength=terms.size)
            n += len(texts)
        df[-1] = n
        kept = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(df[kept])], ["term", "df"])

    return of
