"""Language identification: nearest of several clustered centroids per language, with rejection by distance.

A text is a vector of its letter n-grams (orders 1 to 3, lower case, word ends marked) hashed into
``2 ** BITS`` features: 1 + log(count), times the inverse document frequency, at length 1. Document
frequencies are counted over all documents that may be learned from. Centroids are the spherical
k-means clusters of a sample of at most ``bound`` distinct texts per language (a documented limit of
the fit, nothing else is limited). A document takes the language of the centroid of highest cosine; it
is rejected if that cosine is under the limit that the sample sets for its number of letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vintara.llm.common import written
from vintara.llm.sample import labelled_sample, sampled_texts

BITS = 12
SIZE = 1 << BITS
#: Code points handled at once; n-grams across the cut of a longer text are counted too.
STRETCH = 1 << 20
#: Bound of the model: so many languages of so many centroids of ``SIZE`` floats are sent to every task.
MAX_LANGUAGES = 256
#: A document this much below the lowest cosine of its length in the sample is rejected.
SLACK = 0.5
LENGTHS = 32


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # idf of the features
    centroids: np.ndarray  # rows of length 1
    of: np.ndarray  # language of each centroid
    limits: np.ndarray  # lowest accepted cosine by log2 of the number of letters


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (cosine, 0 to 1), ``rejected``.

    A null text, a text without a letter, and every text under a model without a language is
    ``und`` with score 0 and rejected. Ties go to the language first in order of name. Null and
    repeated ids stay, row by row; other columns are not read.
    """
    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            names, scores, gone = [], [], []
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                found = [grams(t) for t in texts[lo : lo + 256]]
                vectors = weighted(np.stack([f for f, _ in found]), m.weights)
                cosines = vectors @ m.centroids.T if len(m.languages) else np.zeros((len(found), 1), np.float32)
                best = cosines.argmax(1)
                for (_, letters), k, score in zip(found, best, np.clip(cosines[np.arange(len(best)), best], 0, 1).tolist()):
                    known = letters > 0 and len(m.languages) > 0
                    names.append(m.languages[m.of[k]] if known else "und")
                    scores.append(score if known else 0.0)
                    gone.append(not known or score < m.limits[min(letters.bit_length(), LENGTHS - 1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    schema = f"id {kept.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return kept.mapInArrow(predict, schema).withColumnRenamed("id", id_col)


def fit_language(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", bound: int = 1500, clusters: int = 4) -> LanguageModel:
    """Fit on the rows where ``learn`` holds and language and text are not null.

    Document frequencies cover all those rows; the centroids a sample of at most ``bound`` distinct
    texts per language, whatever the ids. Without such rows the model has no language.
    """
    rows = docs.where(learn & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), F.xxhash64(docs[text_col].cast("string")).alias("h"))
    counted = rows.select("text").mapInArrow(_frequencies, "feature int, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(SIZE + 1)
    for r in counted:  # SIZE + 1 rows at most
        df[r.feature] = r.df
    weights = (np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1).astype(np.float32)
    sample = written(labelled_sample(rows.select("lang", "h"), "lang", bound).select("h", "lang"), "language-sample")
    vectors = sampled_texts(rows, sample, ["h", "lang"]).select("lang", "text").mapInArrow(_vectors(weights), "lang string, letters int, vector binary")
    fitted = vectors.groupBy("lang").applyInArrow(_clustered(clusters), "lang string, centroid binary, lows array<float>").collect()
    languages = sorted({r.lang for r in fitted})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model is bounded for {MAX_LANGUAGES}")
    fitted.sort(key=lambda r: (r.lang, bytes(r.centroid)))
    lows = np.min([np.full(LENGTHS, np.inf), *[np.array(r.lows) for r in fitted]], axis=0)
    lows = np.minimum.accumulate(np.where(np.isfinite(lows), lows, np.inf)[::-1])[::-1]  # shorter texts are never held to more
    lows = np.where(np.isfinite(lows), lows, lows[np.isfinite(lows)].max(initial=0.0))
    return LanguageModel(languages, weights, np.stack([np.frombuffer(r.centroid, np.float32) for r in fitted]) if fitted else np.zeros((0, SIZE), np.float32),
                         np.array([languages.index(r.lang) for r in fitted], int), SLACK * lows)


def grams(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams, and the number of letters."""
    counts, letters = np.zeros(SIZE, np.float32), 0
    for k in range(0, len(text or ""), STRETCH):
        codes = np.frombuffer(text[max(0, k - 2) : k + STRETCH].encode("utf-32-le", "replace"), "<u4")
        c = np.zeros(len(codes) + 2, np.uint32)
        np.take(_letters(), codes, out=c[1:-1])
        letters += int(np.count_nonzero(c)) - (int(np.count_nonzero(c[1:3])) if k else 0)
        one, two = c * np.uint32(2654435761), c * np.uint32(2246822519)
        pairs = one[:-1] + (two[1:] ^ (two[1:] >> np.uint32(13)))
        triples = (pairs[:-1] ^ (pairs[:-1] >> np.uint32(15))) * np.uint32(3266489917) + one[2:]
        inner = c[1:-1] > 0
        for hashes in (one[c > 0], pairs[:-1][inner], triples[inner]):
            hashes = (hashes ^ (hashes >> np.uint32(16))) * np.uint32(668265263)
            counts += np.bincount(hashes >> np.uint32(32 - BITS), minlength=SIZE)
    return counts, letters


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for what is not a letter."""
    return np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * weights
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(SIZE + 1, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            df[:SIZE] += grams(text)[0] > 0
            df[SIZE] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1), pa.int32()), pa.array(df)], ["feature", "df"])


def _vectors(weights: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [grams(t) for t in part.column(1).to_pylist()]
                rows = weighted(np.stack([f for f, _ in found]), weights)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in found], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "letters", "vector"])

    return of


def _clustered(clusters: int):
    def cluster(table: pa.Table) -> pa.Table:
        """Spherical k-means of one language's sample, started from texts far from one another."""
        x = np.frombuffer(b"".join(sorted(table.column("vector").to_pylist())), np.float32).reshape(-1, SIZE)
        lengths = dict(zip(table.column("vector").to_pylist(), table.column("letters").to_pylist()))
        x = x[np.abs(x).sum(1) > 0]
        if not len(x):
            return table.schema.empty_table().select(["lang"]).append_column("centroid", pa.array([], pa.binary())).append_column("lows", pa.array([], pa.list_(pa.float32())))
        mean = x.mean(0)
        chosen = [int((x @ mean).argmax())]
        for _ in range(min(clusters, len(x)) - 1):
            chosen.append(int((x @ x[chosen].T).max(1).argmin()))
        centers = x[chosen]
        for _ in range(12):
            near = (x @ centers.T).argmax(1)
            sums = np.stack([x[near == k].sum(0) if (near == k).any() else centers[k] for k in range(len(centers))])
            centers = sums / np.linalg.norm(sums, axis=1, keepdims=True)
        lows, best = np.full(LENGTHS, np.inf, np.float32), (x @ centers.T).max(1)
        for row, cosine in zip(x, best):
            k = min(lengths[row.tobytes()].bit_length(), LENGTHS - 1)
            lows[k] = min(lows[k], cosine)
        n = len(centers)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * n, pa.string()), "centroid": pa.array([c.astype(np.float32).tobytes() for c in centers], pa.binary()),
                         "lows": pa.array([lows.tolist()] * n, pa.list_(pa.float32()))})

    return cluster
