import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintara.llm import lexical
from vintara.llm.lexical import ranked_search, terms_of

ITEMS = "item_id bigint, text string"


def brute(docs, items, k=50):
    """Every document scored for every item, as the contract words it."""
    texts = [(i, Counter(terms_of((t or "").encode()))) for i, t, *_ in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(n for *_, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    rows = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for i, c, n in texts:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text.encode())) if c[t])
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        rows += [(item, rank, i, score) for rank, (score, i) in enumerate(found[:k], 1)]
    return Counter(rows)


def words(rng, n, kinds):
    return " ".join(f"w{min(int(rng.expovariate(8 / kinds)), kinds)}" for _ in range(n))


def ranked(docs, items, **options):
    return Counter(map(tuple, ranked_search(docs, items, **options).collect()))


@pytest.mark.parametrize("seeds", [1, lexical.SEEDS])
def test_equals_brute_force_over_many_slices_and_blocks(spark, docs_of, monkeypatch, seeds):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 120), 400)) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(70)]  # copies: ties at the last rank
    items = [(i, words(rng, rng.randrange(1, 25), 400)) for i in range(30)]
    monkeypatch.setattr(lexical, "SEEDS", seeds)
    monkeypatch.setattr(lexical, "QUERIES", 7)
    assert ranked(docs_of(rows), spark.createDataFrame(items, ITEMS), k=20) == brute(rows, items, 20)


def test_blocks_are_skipped_and_nothing_is_lost():
    rng = np.random.default_rng(3)
    topics = rng.integers(0, 12, 3000)
    lengths = rng.integers(5, 40, 3000)
    terms = np.concatenate([np.sort(rng.choice(240, n, replace=False, p=np.where(np.arange(240) // 20 == t, 8.0, 1.0) / (220 + 160))) for t, n in zip(topics, lengths)])
    tfs = rng.integers(1, 4, len(terms))
    df = np.bincount(terms, minlength=240)
    queries = [np.sort(rng.choice(np.arange(20 * t, 20 * t + 20), 6, replace=False)) for t in range(12)]
    stated = lexical.Stated(queries, lexical.weights_of(df, 3000), 3000, int(tfs.sum()), 10)
    n = np.add.reduceat(tfs, np.cumsum(lengths) - lengths)
    index = lexical.Slice(stated, n, lengths, terms, tfs)
    for query in stated.queries:
        every = index.scores(np.arange(3000), query)
        least = np.sort(every)[-10]
        candidates = index.candidates(query, int(least))
        assert set(np.flatnonzero(every >= least)) <= set(candidates.tolist())
        touched = (index.impact[:, query] > 0).any(1).sum()
        assert len(candidates) < touched
        docs, starts, summaries = index.blocked(int(query[0]))
        assert len(starts) > 1 and sorted(docs.tolist()) == np.flatnonzero(index.impact[:, query[0]]).tolist()
        for block, part in zip(summaries, np.split(docs, starts[1:])):
            assert (block == index.impact[np.ix_(part, stated.together[int(query[0])])].max(0)).all()


def test_slices_cover_a_batch(monkeypatch):
    monkeypatch.setattr(lexical, "POSTINGS", 10)
    lengths = np.array([3, 4, 50, 0, 0, 2, 2, 2, 2, 2, 2])
    cuts = list(lexical._cuts(lengths, 4))
    assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == len(lengths)
    assert all(b - a <= 4 and (lengths[a:b].sum() <= 10 or b - a == 1) for a, b in cuts)


def test_odd_rows(spark, docs_of):
    long = "alpha " * 60_000 + "omega"
    rows = [(1, None), (2, ""), (3, " .;\n"), (4, "Alpha béta"), (4, "alpha BÉTA"), (None, "alpha beta"), (5, long), (6, "other words"), (6, "other words"), (7, "Ünder"), (8, "x" * 100_000)]
    items = [(1, "ALPHA omega"), (1, "ALPHA omega"), (1, "béta"), (2, None), (3, ""), (None, "other"), (4, "x" * 100_000), (5, "nowhere")]
    docs = docs_of(rows).withColumns({c: F.lit(1) for c in ("id", "rank", "score", "item", "item_id", "query")})
    found = ranked(docs, spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(7)))
    assert found == brute(rows, items)
    assert {r[0] for r in found} == {1, 4, None}


def test_ids_of_text_and_empty_tables(spark, docs_of):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([(9, "one")], ITEMS)
    assert [(r.doc_id, r["rank"]) for r in ranked_search(docs, items, k=2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert not ranked(docs_of([]), items) and not ranked(docs, items.limit(0)) and not ranked(docs_of([(1, None)]), items)
