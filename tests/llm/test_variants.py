import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vintara.llm import variants
from vintara.llm.variants import near_words, neighbourhoods, variant_groups, word_counts


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    rows = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        form = min(near, key=lambda v: (-counts[v], v), default=None)
        form = form if form is not None and counts[form] >= ratio * n else None
        rows[w] = [w, form, w, n, len(near), counts[form] if form else None]
    for row in rows.values():
        while rows[row[2]][1]:
            row[2] = rows[row[2]][1]
    return sorted(map(tuple, rows.values()))


def counted(rows, damaged=199, letters=6, least=5):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least}


def made(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def test_equals_brute_force(spark):
    rng = random.Random(2)
    letters = "abcdeäÖ"
    stems = [made(rng, letters, rng.randrange(6, 10)) for _ in range(60)]
    counts = {}
    for s in stems:
        for _ in range(8):
            i = rng.randrange(len(s))
            w = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i:], s[:i] + rng.choice(letters) + s[i + 1 :]])
            counts[w] = rng.choice([5, 6, 30, 200, 1200, 1200])
            counts[w[:2] + "xyz"[rng.randrange(3)] + w[3:]] = 7
        counts[s] = 9000
    found = variant_groups(spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)).collect()
    assert sorted(map(tuple, found)) == brute(counts)
    assert any(r.root not in (r.form, r.word) for r in found)


def test_long_words_and_words_around_the_carried_length(spark):
    rng = random.Random(4)
    counts = {}
    for n in (63, 64, 65, 66, 300):
        w = made(rng, "abcdefgh", n)
        for v in (w, w[1:], w[:-1] + "z", w[:7] + "é" + w[7:], w + w[-1], w[:20] + w[22:]):
            counts[v] = rng.choice([5, 50, 500])
    counts["q" * 20_000], counts["q" * 20_001] = 5, 25
    assert sorted(map(tuple, variant_groups(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect())) == brute(counts)


def test_neighbourhoods_hold_every_reduced_word_one_edit_away_once():
    rng = random.Random(6)
    words = [made(rng, "abcdefghijklmnop", rng.randrange(1, 9)) for _ in range(50)]
    symbol = {c: int(variants.symbols(variants.np.array([ord(c)], "<u4"))[0]) for c in "abcdefghijklmnop"}
    by_place = {}
    for places, hashes in neighbourhoods(words):
        for p, h in zip(places.tolist(), hashes.tolist()):
            by_place.setdefault(p, []).append(h)
    for p, w in enumerate(words):
        values, s = variants._values().tolist(), [symbol[c] for c in w]
        edits = [s, *[s[:i] + s[i + 1 :] for i in range(len(s))], *[s[:i] + [v] + s[i + k :] for v in values for k in (0, 1) for i in range(len(s) + 1 - k)]]
        expected = {sum(v * pow(variants.BASE, i, 1 << 64) for i, v in enumerate(e)) % (1 << 64) for e in edits}
        assert len(by_place[p]) == len(set(by_place[p])) and set(by_place[p]) == expected


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    counts = {"letter": 5, "letters": 30, "lettre": 5, "better": 26, "lette": 400}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    expected = sorted(map(tuple, near_words(words).collect()))
    monkeypatch.setattr(variants, "_bitmap", lambda known: b"\xff" * (variants.BITS // 8))
    assert expected == sorted(map(tuple, near_words(words).collect())) and expected


def test_nothing_of_the_vocabulary_is_broadcast(spark):
    """A small vocabulary's neighbourhoods are many times its size, which Spark doesn't see."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([("letter", 5), ("letters", 30), ("x" * 70, 5), ("x" * 71, 50)], "word string, n bigint")
    known = variants.written(words, "known")
    pairs, groups = near_words(known), variant_groups(words)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    assert "SortMergeJoin" in plan(pairs) and "Broadcast" not in plan(pairs)
    assert "SortMergeJoin" in plan(groups) and "Broadcast" not in plan(groups)
    assert {(r.word, r.near) for r in pairs.collect()} == {(a, b) for a in words.toPandas().word for b in words.toPandas().word if one_edit(a, b)}


def test_words_of_whole_texts(spark, docs_of, monkeypatch):
    rng = random.Random(1)
    kinds = [made(rng, "abcÉéßxyz", rng.randrange(3, 12)) for _ in range(200)]
    rows = [(i % 40 if i % 9 else None, " ".join(rng.choice(kinds).upper() if rng.random() < 0.2 else rng.choice(kinds) for _ in range(60)) + rng.choice(["!", "1é", "漢", ""])) for i in range(150)]
    rows += [(7, None), (8, ""), (9, "x" * 200_000), (None, "12 — 漢字")]
    docs = docs_of(rows).withColumns({"word": F.lit(1), "n": F.lit(2), "id": F.lit("z")}).repartition(5)
    for damaged in (199, 2):
        assert {r.word: r.n for r in word_counts(docs, damaged=damaged).collect()} == counted(rows, damaged)
    assert {r.word: r.n for r in word_counts(docs, 1, 1).collect()} == counted(rows, letters=1, least=1)


def test_odd_tables(spark, docs_of):
    assert variant_groups(word_counts(docs_of([]))).collect() == []
    words = spark.createDataFrame([("abcdef", 5), ("abcdef", 6), (None, 9), ("abcde", 60), ("zzz", None), ("", 4)], "word string, n bigint").withColumn("near", F.lit(0)).withColumn("key", F.lit(0))
    rows = {r.word: tuple(r)[1:] for r in variant_groups(words).collect()}
    assert rows == {"abcdef": ("abcde", "abcde", 11, 1, 60), "abcde": (None, "abcde", 60, 1, None), "zzz": (None, "zzz", None, 0, None), "": (None, "", 4, 0, None)}
    with pytest.raises(ValueError):
        variant_groups(words, ratio=1)
