import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vintara.llm import private
from vintara.llm.private import KINDS, base_spans, candidates, luhn, mentions, personal_data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """Base spans as the contract words them."""
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 14 <= len(digits) <= 19 and total % 10 == 0
                    or kind == 3 and 10 <= len(digits) <= 15):
                found.append((m.start(), kind, m.end()))
    return [(k, s, e) for s, k, e in sorted(found)]


def brute(texts, support=3, accept=0.8, rounds=5):
    """Accepted spans of every text, by loops over all mentions."""
    all_mentions = [(i, m) for i, t in enumerate(texts) for m in mentions(t or "", *base_spans(t or ""))]
    words = Counter(w.lower() for t in texts for w in private.WORDS.findall(t or ""))
    patterns = lambda m: [(m["kind"], c, m[c]) for c in ("form", "left", "right") if m[c] is not None]
    known, scores = {(m["kind"], m["instance"]) for _, m in all_mentions if m["status"] == 1}, {}
    for _ in range(rounds):
        instances, hits, seen = defaultdict(set), Counter(), Counter()
        for _, m in all_mentions:
            for p in patterns(m):
                seen[p] += 1
                if m["status"] >= 0 and (m["kind"], m["instance"]) in known:
                    instances[p].add(m["instance"])
                    hits[p] += 1
        share = {p: min(n / (max(words[p[2]] if p[1] != "form" else 0, seen[p]) + 1), 0.999) for p, n in hits.items() if len(instances[p]) >= support}
        scores = {}
        for _, m in all_mentions:
            if m["status"] == 0:
                key = (m["kind"], m["instance"])
                scores[key] = max(scores.get(key, 0), 1 - math.prod(1 - share.get(p, 0) for p in patterns(m)))
        accepted = {k for k, s in scores.items() if s >= accept}
        if accepted <= known:
            break
        known |= accepted
    result = []
    for i in range(len(texts)):
        kept = []
        for m in sorted({(-round(scores[m["kind"], m["instance"]], 9), m["start"] - m["end"], m["start"], m["kind"], m["end"]) for j, m in all_mentions if j == i and m["status"] == 0 and scores[m["kind"], m["instance"]] >= accept}):
            if all(m[4] <= s or e <= m[2] for _, s, e in kept):
                kept.append((m[3], m[2], m[4]))
        result.append(sorted(kept, key=lambda x: (x[1], x[0])))
    return result


def as_tuples(spans):
    return [tuple(s) for s in spans]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for alphabet, n in (("a@.-", 14), ("0123.", 16), ("01234 -", 40), ("+0 (1).-5", 25), ("ab@.+01 -(é", 40)):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))
            found, _ = base_spans(text)
            assert sorted((s, k, e) for k, s, e in found) == [(s, k, e) for k, s, e in plain(text)], text


def test_long_runs_take_time_in_proportion():
    for text in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "+1" * 150_000, "a.b@" * 50_000, "1.2.3." * 50_000, "1 " * 60_000, "(" * 300_000, ":a" * 100_000, " at " * 50_000):
        mentions(text, *base_spans(text))


def test_candidates_do_not_meet_base_spans():
    text = "call +1 (269) 555-3296 4524132264652876 or 10.0.0.1 x y [at] host [dot] org, 555-8768, a@b.cd, root@localhost fe80::1:2:3"
    base, failed = base_spans(text)
    maybe, _ = candidates(text, base, failed)
    assert {text[s:e] for _, s, e in base} == {"10.0.0.1", "a@b.cd"}
    assert {(KINDS[k], text[s:e]) for k, s, e in maybe} == {
        ("phone", "+1 (269) 555-3296"), ("card", "4524132264652876"), ("phone", "555-8768"), ("email", "y [at] host [dot] org"), ("email", "root@localhost"), ("ip", "fe80::1:2:3")}
    assert luhn("4524132264652876") and not luhn("4524132264652877")


def corpus():
    rng = random.Random(9)
    words = [("".join(rng.choice("abcdefgh") for _ in range(4))) for _ in range(60)]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    number = lambda: f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if luhn(body + c))

    texts = [f"{filler(20)} Telephone: +1 {number()} {filler(9)}" for _ in range(70)]
    texts += [f"{filler(9)} telephone {number()} reachable {filler(5)}" for _ in range(14)]  # told by the word before
    texts += [f"{filler(3)} {number()} reachable {filler(5)}" for _ in range(2)]  # told by the word after, in a later round
    texts += [f"{filler(4)} {rng.choice(words)} {number()} {filler(3)}" for _ in range(9)]  # told by nothing
    texts += [f"{filler(8)} {card()} {filler(2)}" for _ in range(30)] + [f"{filler(4)} +1 {number()} {card()} {filler(2)}" for _ in range(3)]
    texts += [f"mail {filler(2)} x{i}@mail.example.org write {filler(3)}" for i in range(5)] + ["write to root@localhost", None, "", "clean words only", texts[13], texts[13]]
    return texts


def test_unseen_identifiers_equal_brute_force(spark, docs_of):
    texts = corpus()
    docs = docs_of(list(enumerate(texts))).withColumns({c: F.lit(1) for c in ("row", "kind", "score", "base", "value", "id")})
    found = {r.doc_id: r for r in personal_data(docs.repartition(4)).collect()}
    expected = brute(texts)
    for i, text in enumerate(texts):
        assert as_tuples(found[i].base_spans) == plain(text) and as_tuples(found[i].added) == expected[i]
        assert as_tuples(found[i].spans) == sorted(plain(text) + expected[i], key=lambda x: (x[1], x[0], x[2]))
        assert [found[i][f"n_{k}"] for k in KINDS] == [sum(x[0] == n for x in plain(text)) for n in range(4)]
    assert all(expected[70:86]) and not any(expected[86:95]) and all(len(x) == 2 for x in expected[125:128])


def test_odd_tables(spark, docs_of):
    assert personal_data(docs_of([])).collect() == []
    rows = [(None, "a@b.cd"), (None, "a@b.cd"), (1, None), (1, ""), (2, "é" * 100_000 + " a@b.cd"), (3, "+" + "9" * 60_000)]
    found = sorted((r.doc_id or 0, as_tuples(r.spans)) for r in personal_data(docs_of(rows)).collect())
    assert found == sorted([(0, [(0, 0, 6)]), (0, [(0, 0, 6)]), (1, []), (1, []), (2, [(0, 100_001, 100_007)]), (3, [])])
    names = personal_data(spark.createDataFrame([("k", "1.2.3.4")], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.n_ip) for r in names] == [("k", 1)]
