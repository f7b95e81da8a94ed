import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vintara.llm.spotsigs import ANCHORS, fingerprints, likeness, near_sets, with_signatures


def chains(text):
    """The signatures of a text, as strings (without the chains at hashed words)."""
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    marked, held = [], ""
    for w in words:
        if w in ANCHORS:
            held += w + "^"
        else:
            marked.append((held, w))
            held = ""
    return {(a + w, marked[k + 1][1] if k + 1 < len(marked) else None) for k, (a, w) in enumerate(marked) if a}


def test_signatures_follow_anchors(spark):
    texts = ["The ring of the stone was, under a wall!", "no anchors", "the", "", None, "Der Ring und die Mauer", "the the ring"]
    rows = with_signatures(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "s")
    for r in rows.collect():
        hashes = {h[0] for x in chains(r.t or "") for h in spark.range(1).select(F.hash(F.lit(x[0]), F.lit(x[1]).cast("string"))).collect()}
        assert hashes <= set(r.s) and len(r.s) >= 1 and r.s == sorted(set(r.s))


def neighbours(rows, ties):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, ties[r[1] or ""]), reverse=True)
    return [(r[0], r[1] or "", order[(k + 1) % len(order)][1] or "") for k, r in enumerate(order)]


@pytest.mark.parametrize("n", [1, 2, 300])
def test_edited_texts_and_likeness(spark, docs_of, n):
    rows = [(i * 37 % 1000, f"the text {i} of a document and its words " * (i % 5) + "é🙂" * (i % 3)) for i in range(n)]
    if n > 2:
        rows += [(None, None), (None, "null id"), (5000, ""), (5001, "xy"), (37, rows[1][1]), (37, "another of the same id"), (37, rows[1][1]), (6000, "long text of the " * 50_000)]
    docs = docs_of(rows).withColumns({"range": F.lit("clash"), "ghost": F.lit(7), "id": F.lit(1), "next_text": F.lit(2)})
    ties = {r.text: r.tie for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("tie", F.xxhash64("text")).collect()}
    want = []
    for i, text, following in neighbours(rows, ties):
        k = len(text) // 3
        want.append((i, len(text), hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest()))
    out = fingerprints(docs).withColumn("sha", F.sha2("edited_text", 256)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.sha) for r in out), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) % 8 == 0 and r.fingerprint for r in out)
    assert fingerprints(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = fingerprints(docs).collect()
    long = [r for r in out if r.n_chars > 600]
    assert sum(r.near_edited for r in long) / len(long) > 0.4 and sum(r.near_next for r in long) / len(long) < 0.1
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {}
    for r in out:
        prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_likeness_is_jaccard_of_small_sets(spark):
    a, b = "the red ring and the blue stone of a tall wall", "the red ring and the blue stone of a small door"
    r = with_signatures(with_signatures(spark.createDataFrame([(a, b)], "a string, b string"), "a", "x"), "b", "y").withColumn("l", likeness(F.col("x"), F.col("y"))).first()
    assert r.l == len(set(r.x) & set(r.y)) / len(set(r.x) | set(r.y)) and 0 < r.l < 1


def test_pruned_join_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs, members = near_sets(docs, 0.7)
    sets = {}
    names = {r.id: r.set for r in members.collect()}
    for r in with_signatures(docs.select("doc_id", "text"), "text", "s").collect():
        sets[names[r.doc_id]] = set(r.s)
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert {(r.set_a, r.set_b) for r in pairs.collect()} == want and want


def test_one_signature_of_a_thousand_counts(spark, docs_of):
    words = [f"the word{k}x" for k in range(1000)]
    texts = [" ".join(words), " ".join([*words[:-1], "the other"]), " ".join(words[:800])]
    got = {r.doc_id: r for r in fingerprints(docs_of(list(enumerate(texts)))).collect()}
    sets = [set(r.s) for r in with_signatures(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "t", "s").orderBy("i").collect()]
    assert len({r.fingerprint for r in got.values()}) == 3 and min(map(len, sets)) > 700
    for i, following in ((2, 1), (1, 0), (0, 2)):
        assert got[i].near_next == len(sets[i] & sets[following]) / len(sets[i] | sets[following]) < 1


def test_scripts_without_spaces_are_cut_into_characters(docs_of):
    text = "春になると公園の桜が咲き始めて多くの人が写真を撮りに来ます。夏は海で泳ぐ人が増えて夜には花火も上がります。秋は山が赤く染まり冬は雪が静かに降ります。毎年同じ景色を見ても飽きることはありません。"
    changed = text.replace("夏は海で泳ぐ人が増えて", "梅雨の間は家で本を読み")
    found = {r.doc_id: r for r in fingerprints(docs_of([(3, text), (2, changed), (1, "ภาษาไทยเขียนติดกัน")])).collect()}
    assert 0.3 < found[3].near_next < 1 and found[2].near_next == 0
