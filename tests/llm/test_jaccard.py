import random

import numpy as np
from pyspark.sql import functions as F

from vintara.llm.graph import components
from vintara.llm.jaccard import least_matches, near_duplicates


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """(id, class, copy, links) of every row."""
    key = lambda i: (i is None, i)
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    names = list(texts)
    sets = [shingles(t) for t in names]
    copy = [min(texts[t], key=key) for t in names]
    root, links = list(range(len(names))), [0] * len(names)
    for a in range(len(names)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {r: min((copy[k] for k in range(len(names)) if root[k] == r), key=key) for r in set(root)}
    where = {t: k for k, t in enumerate(names)}
    return sorted(((i, least[root[where[t or ""]]], copy[where[t or ""]], links[where[t or ""]]) for i, t in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in df.collect()), key=str)


def varied(seed, base, copies, changes):
    rng = random.Random(seed)
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 9)}"
        out.append(" ".join(words))
    return out


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_duplicates(docs)) == brute(rows)


def test_large_group_and_edge_cases(docs_of):
    base = [f"b{i}" for i in range(120)]
    rows = list(enumerate(varied(1, base, 420, 9)))  # more than a block
    rows += [(1000 + i, t) for i, t in enumerate(varied(2, [f"c{i}" for i in range(70)], 30, 4))]
    rows += [(None, "x y"), (None, rows[0][1]), (2000, None), (2001, ""), (2002, "  \n"), (2003, "x y"), (2003, "x y"), (2004, "one"), (2005, "long " * 100_000), (2006, "long " * 100_001)]
    docs = docs_of(rows).withColumns({"node": F.lit("clash"), "size": F.lit(1), "root": F.lit(2)})
    assert got(near_duplicates(docs)) == brute(rows)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(7, 7)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()} == want


def test_pruning_table_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    matches = rng.random((200_000, 140)) < 0.8
    lost = np.zeros(len(matches), bool)
    for n, m in least_matches(0.8):
        lost |= matches[:, :n].sum(1) < m
    assert lost.mean() < 5e-5
    dropped = np.zeros(len(matches), bool)
    for n, m in least_matches(0.8):
        dropped |= (rng.random((200_000, n)) < 0.4).sum(1) < m
    assert dropped.mean() > 0.999
