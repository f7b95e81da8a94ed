import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vintara.llm import mixing
from vintara.llm.mixing import mixed, source_weights

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def draw(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def weights_of(sizes, entropy=None, repetition=None, budget=None):
    total = sum(sizes.values())
    share = {s: n / total for s, n in sizes.items() if n}

    def at(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    def fits(a):
        w = at(a)
        ratio = [w[s] / share[s] for s in share]
        if repetition is not None:
            return (max(ratio) <= repetition * min(ratio)) if budget is None else max(ratio) * budget <= repetition * total
        return -sum(x * math.log(x) for x in w.values()) >= entropy * math.log(len(w)) - 1e-12

    grid = [k / 20000 for k in range(20001)]
    good = [a for a in grid if fits(a)]
    a = (min(good) if repetition is not None else max(good)) if good else 1.0
    return a, at(a)


@pytest.mark.parametrize("target", [{"entropy": 0.9}, {"entropy": 1.0}, {"entropy": 0.1}, {"repetition": 2.0}, {"repetition": 1.5, "budget": 1000}, {"repetition": 2, "budget": 5000}, {"repetition": 1000}])
def test_exponent_and_weights(spark, target):
    sizes = {"a": 700, "b": 200, "c": 80, "d": 20, "e": 0}
    rows = source_weights(spark.createDataFrame(list(sizes.items()), "source string, tokens long"), **target).collect()
    a, w = weights_of(sizes, **target)
    assert {r.source for r in rows} == set("abcd") and abs(rows[0].exponent - a) < 1e-4
    assert all(abs(r.weight - w[r.source]) < 1e-4 for r in rows) and abs(sum(r.weight for r in rows) - 1) < 1e-9
    if "budget" not in target:
        assert all(r.budget >= r.tokens for r in rows)


def brute(rows, budgets, blocks, seed=0):
    """Counter of (source, id, epoch)."""
    by = defaultdict(list)
    for r in rows:
        by[r[3] or ""].append((r[0], len(WORD.findall(r[1] or ""))))
    out = Counter()
    for source, docs in by.items():
        total = sum(n for _, n in docs)
        if not total:
            continue
        n_blocks = max(1, math.ceil(len(docs) / blocks))
        whole, rest = divmod(budgets[source], total)
        for epoch in range(whole + 1):
            groups = defaultdict(list)
            for i, n in docs:
                groups[draw(seed, i) % n_blocks].append((i, n))
            left = rest
            for b in sorted(groups, key=lambda b: (draw(seed, "block", epoch, source, b), b)):
                size = sum(n for _, n in groups[b])
                if epoch < whole or (left > 0 and size <= left):
                    out.update((source, i, epoch) for i, _ in groups[b])
                    left -= size
                    continue
                if left > 0:
                    same = defaultdict(list)
                    for i, n in groups[b]:
                        same[draw(seed, "doc", epoch, i)].append((i, n))
                    used = 0
                    for d in sorted(same):
                        used += sum(n for _, n in same[d])
                        if used > left:
                            break
                        out.update((source, i, epoch) for i, _ in same[d])
                break
    return out


@pytest.mark.parametrize("target", [{"repetition": 1.5}, {"repetition": 2.0, "budget": 6000}, {"entropy": 0.98, "budget": 9000}])
def test_rows_equal_brute_force(docs_of, monkeypatch, target):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    rows = [(i, "w " * (1 + i * 7 % 40), "en", "big" if i % 3 == 0 else f"s{i % 5}") for i in range(400)]
    rows += [(None, "null id", "en", "s1"), (None, "null id", "en", "s1"), (900, None, None, "s2"), (901, "", None, None), (902, "no source", None, None), (903, "", None, "silent"), (1, rows[1][1], "en", rows[1][3])]
    docs = docs_of(rows).withColumns({"block": F.lit("clash"), "tokens": F.lit(1), "weight": F.lit(2)})
    out = mixed(docs, **target)
    assert out.columns == [*docs.columns, "mix"]
    got = out.collect()
    budgets = {r.source or "": r.mix.budget for r in got}
    assert Counter(((r.source or ""), r.doc_id, r.mix.epoch) for r in got) == brute(rows, defaultdict(int, budgets), 16)
    spent = Counter()
    for r in got:
        spent[r.source or ""] += r.mix.tokens
    assert all(spent[s] <= budgets[s] for s in budgets)
    assert mixed(docs.limit(0), **target).count() == 0


def test_without_a_budget_every_document_comes(docs_of):
    rows = [(i, "w " * (i % 9 + 1), "en", "a" if i % 4 else "b") for i in range(200)]
    got = mixed(docs_of(rows), repetition=1.25).collect()
    assert {r.doc_id for r in got} == set(range(200)) and max(r.mix.epoch for r in got) <= 1


def test_columns_of_any_name_stay(docs_of):
    names = ["_source", "_block", "_draw", "_own", "_pass", "_upto", "_blocks", "__own", "source_", "epoch", "of", "rank"]
    docs = docs_of([(i, "w " * (i % 9 + 1), "en", "a" if i % 4 else "b") for i in range(60)]).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in [*names, "mix"]})
    out = mixed(docs, repetition=1.25)
    assert out.columns == [*[c for c in docs.columns if c != "mix"], "mix"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names) and {r.doc_id for r in out.collect()} == set(range(60))
