import cProfile
import hashlib
import pstats
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vintara.llm.substrings import _keys, remove_repeats


def brute(rows, window=35):
    texts = [(t or "").encode().split() for _, t in rows]
    count = {}
    for words in texts:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            count[w] = count.get(w, 0) + 1
    out = []
    for (doc, _), words in zip(rows, texts):
        gone = {i + k for i in range(len(words) - window + 1) if count[tuple(words[i : i + window])] > 1 for k in range(window)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(w[2] for w in want) > 1000
    assert got(remove_repeats(docs)) == want


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages_and_edge_cases(docs_of, seed):
    rng = random.Random(seed)
    word = lambda n: f"w{rng.randrange(n)}"
    passages = [[word(500) for _ in range(rng.randint(30, 90))] for _ in range(6)] + [["x", "y"] * 30, ["z"] * 50]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            words += [word(3000) for _ in range(rng.randint(0, 60))] + p[a : a + rng.randint(10, 90)]
        rows.append((i, " ".join(words)))
    rows += [(None, rows[3][1]), (500, None), (501, ""), (502, "\n\t "), (7, rows[7][1]), (7, rows[7][1]), (503, " ".join(["a"] * 5000)), (504, " ".join(str(i % 7) for i in range(3000))),
             (505, "  ".join(f"é{i}" for i in range(34))), (506, "\r\n".join(f"é{i}" for i in range(34)) + " x"), (507, " ".join(f"q{i}" for i in range(60_000)))]
    docs = docs_of(rows).withColumns({"row": F.lit("clash"), "key": F.lit(1), "marks": F.lit(2)})
    assert got(remove_repeats(docs)) == brute(rows)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_spans_and_kept_text(docs_of):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = remove_repeats(docs_of([(1, f"one\n\ntwo {passage} three  \n"), (2, f"{passage}\tfour"), (3, " un\ntouched "), (4, passage)])).collect()
    assert {r.doc_id: (r.kept_text, r.spans) for r in rows} == {1: ("one\n\ntwo three  \n", [[2, 42]]), 2: ("four", [[0, 40]]), 3: (" un\ntouched ", []), 4: ("", [[0, 40]])}


def test_keys_take_no_call_for_each_word():
    """20,000 distinct words, of which every second text is a copy, are hashed together."""
    texts = [" ".join(f"word{k // 2}x{i}" for i in range(500)) for k in range(80)]
    profile = cProfile.Profile()
    found = profile.runcall(list, _keys(35)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    assert len(found) == 1 and found[0].num_rows > 400 and set(found[0].column(1).to_pylist()) == {2}
    assert pstats.Stats(profile).total_calls < 5000
