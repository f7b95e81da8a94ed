import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintara.llm import toxicity
from vintara.llm.common import fold
from vintara.llm.toxicity import HALF, Index, Terms, fit_toxicity, score_toxicity, terms_of, vector_of

LABELS = "doc_id long, quality int, toxic int"


def test_neighbours_and_votes_equal_brute_force():
    rng = np.random.default_rng(7)
    examples = []
    for i in range(900):
        ids = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        label = int(rng.random() < (0.8 if 3 in ids else 0.2))
        examples.append((i, label, 2.0 if label else 0.5, ids, rng.integers(1, 5, len(ids)).astype(float)))
    index = Index([str(t) for t in range(60)], rng.integers(1, 400, 60).astype(float), 900, examples, 15)
    assert (index.telling >= toxicity.LEAST).all() and index.telling.argmax() == 3
    entries = {}
    for i, label, stands, ids, counts in examples:
        dense = np.zeros(60)
        dense[ids] = index.scaled(ids, counts)
        if len(ids):
            e = entries.setdefault(tuple(np.round(dense, 12)), [i, 0.0, 0.0])
            e[1], e[2] = e[1] + label * stands, e[2] + stands
    matrix = np.array(list(entries))
    facts = list(entries.values())
    for _ in range(80):
        ids = np.sort(rng.choice(60, rng.integers(1, 6), replace=False))
        counts = rng.integers(1, 4, len(ids)).astype(float)
        query = np.zeros(60)
        query[ids] = index.scaled(ids, counts)
        cosines = matrix @ query
        score, evidence, found = index.score(ids, counts, len(ids))
        assert np.allclose(found, np.sort(cosines[cosines > 0])[::-1][:15])
        by_id = {f[0]: (c, f) for c, f in zip(cosines, facts)}
        assert np.allclose([by_id[i][0] for i in evidence], found)
        votes = [f[2] / index.unit * HALF / (HALF + math.sqrt(max(2 - 2 * c, 0))) for c, f in (by_id[i] for i in evidence)]
        shares = [f[1] / f[2] for _, f in (by_id[i] for i in evidence)]
        assert score == pytest.approx((sum(v * s for v, s in zip(votes, shares)) + 0.5 * index.prior) / (sum(votes) + 0.5))


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = fit_toxicity(docs, labels, fold(F.col("doc_id"), 4) != 2)
    held = labels.where(fold(F.col("doc_id"), 4) == 2)
    rows = score_toxicity(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    toxic, clean = np.array([r.score for r in rows if r.toxic == 1]), np.array([r.score for r in rows if r.toxic == 0])
    assert np.mean(toxic[:, None] > clean) + np.mean(toxic[:, None] == clean) / 2 > 0.97  # area under the curve
    assert np.mean(toxic >= 0.3) > 0.8 and np.mean(clean >= 0.3) < 0.01
    worded = [r for r in rows if terms_of((r.text or "").encode())]
    assert np.mean([len(r.evidence) > 0 for r in worded]) > 0.95


def rows_of_insults():
    return [(i, f"plain words number {i}") for i in range(40)] + [(100 + i, f"IDIOT!! plain words {i}") for i in range(40)]


@pytest.mark.parametrize("labelled", [True, False])
def test_edge_cases(spark, docs_of, labelled):
    rows = rows_of_insults()
    odd = [(None, "idiot"), (200, None), (201, ""), (202, "idiot " * 200_000), (100, "IDIOT!! plain words 0"), (203, "you idiot"), (204, "漢字 unseen"), (205, "12 — !")]
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i, _ in rows if i is not None] + [(None, 1, 1), (200, 1, None), (100, 1, 0)] if labelled else [], LABELS)
    docs = docs_of(rows + odd).withColumns({c: F.lit("clash") for c in ("score", "h", "id", "label", "of")})
    model = fit_toxicity(docs, labels, F.lit(True))
    got = score_toxicity(docs, model).collect()
    assert len(got) == len(rows + odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    if labelled:
        assert by[203] > 0.9 and by[202] > 0.9 and by[None] > 0.9 and by[201] == by[200] == by[205] == 0.0 and 0 < by[204] < 1
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, score_toxicity(docs, fit_toxicity(docs, labels, F.lit(True))).collect()), key=str)
    else:
        assert set(by.values()) == {0.5}
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_sample_is_bounded_by_texts_and_not_by_ids(spark, docs_of):
    """One id for a thousand rows: every text is an example once, up to the bound."""
    docs = docs_of([(7, f"IDIOT words {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(1000)] + [(8, "clean words here")] * 50)
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0)], LABELS)
    index, ids = fit_toxicity(docs, labels, F.lit(True), bound=5)
    assert len(ids) == 6 and sorted(set(ids)) == [7, 8] and 0 < len(index.ids) <= 6


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("a", "IDIOT words"), ("b", "clean words"), (None, "an IDIOT")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1, 1), ("b", 1, 0)], "doc_id string, quality int, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, fit_toxicity(docs, labels, F.lit(True))).collect()}
    assert got[None].evidence == ["a"] and got["b"].evidence[0] == "b"


def test_terms_are_whole_runs_of_letters():
    ids, counts, n = vector_of("Idiot! idiot’s ÉTÉ x2y".encode(), {"idiot": 0, "été": 1, "x": 2})
    assert dict(zip(ids.tolist(), counts.tolist())) == {0: 2, 1: 1, 2: 1} and n == 5


def runs_of(text):
    return re.findall(r"[^\W\d_]+", text.decode("utf-8", "replace").lower())


def test_terms_of_odd_characters_equal_the_pattern():
    """Sigma before a point, letters that grow in lower case, digits that count as letters, broken bytes, many kinds of signs."""
    rng = random.Random(9)
    pool = [*"ΣσςİéÉ漢²٣_ .'Ab9\x00\u00a0\u2003\x1cKﬁ\u0307ǅ👍", *map(chr, range(0x2190, 0x21c0))]
    for _ in range(3000):
        text = "".join(rng.choices(pool[: rng.choice([22, len(pool)])], k=rng.choice([12, 120]))).encode()
        text = bytes(b for b in text if rng.random() < 0.9) if rng.random() < 0.5 else text
        assert terms_of(text) == runs_of(text)


def test_vectors_of_many_texts_equal_those_of_each_and_take_less_time():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) + rng.choice(["", ".", "é", "1x", "-y"]) for _ in range(5000)]
    texts = [b"", "12 — !".encode(), *[" ".join(rng.choices(words, k=rng.randint(0, 900))).encode() for _ in range(400)]]
    vocabulary = sorted({t for text in texts[::3] for t in runs_of(text)})
    ids = {t: i for i, t in enumerate(vocabulary)}

    def singly():
        out = []
        for text in texts:
            counts = Counter(runs_of(text))
            out.append((sorted((ids[t], n) for t, n in counts.items() if t in ids), bool(counts)))
        return out

    terms = Terms(vocabulary)
    assert [(list(zip(i.tolist(), c.tolist())), n > 0) for i, c, n in terms.vectors_of(texts)] == singly()

    def seconds(call):
        took = []
        for _ in range(5):
            start = time.process_time()
            call()
            took.append(time.process_time() - start)
        return min(took)

    assert seconds(lambda: list(terms.vectors_of(texts))) < 0.8 * seconds(singly)


def test_no_terms():
    assert [(len(i), len(c), n) for i, c, n in Terms([]).vectors_of([b"", b"a b"])] == [(0, 0, 0), (0, 0, 2)]
