"""Personal data: fixed forms, and unseen identifiers found by bootstrapping from their contexts.

The fixed forms (e-mail, IP, card, phone) give the base spans and the seeds. Strings that look like one of the kinds but are none of
its base spans are candidates: numbers glued to others, phone numbers without a country code, addresses without a
domain or with their signs spelled out. Seeds and candidates are instances; the word before, the word after and the form (digits and letters as classes)
are lexical patterns. Spark scores the graph of the two in rounds: a pattern by the share of its occurrences in the corpus that known instances
take, a candidate by the patterns around it; what is sure enough becomes known for the next round. A word's
occurrences are counted over all texts, a form's among all strings that have it, unknown ones and those that cannot be of the kind included.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vintara.llm.common import bitmap, shipped, utf8, written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IPS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARDS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONES = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]+")
#: Candidates: a local number; an address with its signs spelled out; an IP of six or with bracketed dots.
LOCAL_PHONES = re.compile(r"(?<![0-9A-Za-z+(.-])[(0-9](?:[ ().-]{0,2}[0-9])++")
SPELLED = re.compile(r"\s?(?:\[at\]|\(at\)|\{at\}| at )\s?", re.I)
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\s?(?:\[dot\]|\(dot\)|\{dot\})\s?| dot |(?<!\s)\.(?!\s))[A-Za-z0-9-]++)+", re.I)
LABEL = re.compile(r"[A-Za-z][A-Za-z0-9-]*+")
WIDE_IPS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])|(?<![0-9.\]])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9.\[])")
WORDS = re.compile(r"[^\W\d_]+")
BEFORE, AFTER = re.compile(r"([^\W\d_]+)[\W_]{0,4}\Z"), re.compile(r"[\W_]{0,4}([^\W\d_]+)")
#: A longer context word or form is no pattern; so far is looked for one.
LONGEST, REACH = 48, 72
#: Places of the bitmap of context words, 1 MB.
PLACES = 1 << 23
MENTION = "array<struct<kind:int,start:int,end:int,status:int,instance:bigint,form:string,left:string,right:string>>"
SPAN = "array<struct<kind:int,start:int,end:int>>"


def luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (double + sum(int(c) for c in digits[-1::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, looked for from their sign, so that long words cost nothing."""
    end = after = 0
    at = text.find("@")
    while at >= 0:
        lo = max(end, after)
        start = lo + len(text[lo:at].rstrip(LOCAL))
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            end = domain.end()
        after = at + 1
        at = text.find("@", max(after, end))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base matches, and of the matches of cards and phones that fail."""
    found = [(EMAIL, *span) for span in emails(text)]
    failed = []
    if DIGITS.search(text):
        found += [(IP, *m.span()) for m in IPS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARDS.finditer(text):
            number = digits_of(m[0]) if m.end() - m.start() >= 14 else ""
            (found if 14 <= len(number) <= 19 and luhn(number) else failed).append((CARD, *m.span()))
        for m in PHONES.finditer(text):
            (found if 10 <= len(digits_of(m[0])) <= 15 else failed).append((PHONE, *m.span()))
    return found, failed


def candidates(text: str, base: list, failed: list) -> tuple[set, set]:
    """(kind, start, end) of strings that may be of a kind, and of strings of a number's form that cannot; none meets a base span."""
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], []
    for _, e in taken:
        reach.append(max(e, reach[-1] if reach else 0))

    def free(start: int, end: int) -> bool:
        k = bisect(starts, end - 1)
        return not k or reach[k - 1] <= start

    maybe, never = set(), set()
    for kind, start, end in failed:
        if kind == PHONE:  # a number glued to others: its beginnings that end before a space
            so_far = 0
            for k in range(start, end):
                so_far += text[k] in "0123456789"
                if so_far > 15:
                    break
                if so_far >= 10 and k + 1 < end and text[k + 1] == " " and text[k] in "0123456789":
                    maybe.add((PHONE, start, k + 1))
        else:  # runs of whole groups of digits
            groups = [m.span() for m in DIGITS.finditer(text, start, end)]
            for i, (s, _) in enumerate(groups):
                n = 0
                for s2, e in groups[i:]:
                    n += e - s2
                    if n > 19:
                        break
                    if n >= 14:
                        (maybe if luhn(digits_of(text[s:e])) else never).add((CARD, s, e))
    if DIGITS.search(text):
        maybe |= {(PHONE, *m.span()) for m in LOCAL_PHONES.finditer(text) if m.end() - m.start() <= 30 and 7 <= len(digits_of(m[0])) <= 15 and (CARD, *m.span()) not in maybe}
    maybe |= {(IP, *m.span()) for m in WIDE_IPS.finditer(text) if m.end() - m.start() >= 6} if ":" in text or "[.]" in text else set()
    at = text.find("@")
    while at >= 0:
        start = max(at - REACH, 0) + len(text[max(at - REACH, 0) : at].rstrip(LOCAL))
        if start < at and (label := LABEL.match(text, at + 1)):
            maybe.add((EMAIL, start, label.end()))
        at = text.find("@", at + 1)
    for m in SPELLED.finditer(text):
        lo = max(m.start() - REACH, 0)
        start = lo + len(text[lo : m.start()].rstrip(LOCAL))
        if start < m.start() and (domain := SPELLED_DOMAIN.match(text, m.end())) and (m[0].strip() != "at" or " dot " in domain[0]):
            maybe.add((EMAIL, start, domain.end()))
    return {x for x in maybe if free(x[1], x[2])}, {x for x in never if free(x[1], x[2])}


def form_of(kind: int, text: str) -> str | None:
    """Digits as 0 and letters as a; where lengths tell nothing, a run of them once."""
    form = re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", text))
    form = re.sub(r"([a0])\1+", r"\1", re.sub(r"[a0]+", lambda m: "a" if "a" in m[0] else "0", form)) if kind in (EMAIL, IP) else form
    return form if len(form) <= LONGEST else None


def mentions(text: str, base: list, failed: list) -> list[dict]:
    """Seeds (status 1), candidates (0) and strings that cannot be of the kind (-1), with instance, form and context words."""
    maybe, never = candidates(text, base, failed)
    rows = []
    for status, spans in ((1, base), (0, sorted(maybe)), (-1, sorted(never))):
        for kind, start, end in spans:
            surface = text[start:end]
            name = digits_of(surface) if kind in (CARD, PHONE) else surface.lower()
            instance = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big", signed=True)
            left, right = BEFORE.search(text[max(start - REACH, 0) : start]), AFTER.match(text[end : end + REACH])
            word = lambda m: m[1].lower() if m and len(m[1]) <= LONGEST else None
            rows.append({"kind": kind, "start": start, "end": end, "status": status, "instance": instance, "form": form_of(kind, surface), "left": word(left), "right": word(right)})
    return rows


def personal_data(docs: DataFrame, support: int = 3, accept: float = 0.8, rounds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_spans``, ``spans``, ``added`` (the spans of the method alone).

    Counts and ``base_spans`` are of the base spans; spans are structs of kind, start, end (code points), by start, then kind. A pattern
    needs ``support`` known instances; a candidate is accepted at the score ``accept`` (the chance that not all its patterns err),
    wherever it stands. Of accepted candidates that overlap, those of higher score, then of greater length, then the earlier stay. A null text is empty. Null
    and repeated ids stay, row by row; other columns are not read; no rows give no rows.
    """
    shipped(docs.sparkSession)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, base {SPAN}, mentions {MENTION}"
    rows = written(texts.mapInArrow(_scanned, schema).withColumn("row", F.monotonically_increasing_id()), "private-rows")
    single = rows.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    accepted = _bootstrapped(texts, written(single, "private-mentions"), support, accept, rounds)
    added = accepted.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "score")).alias("added"))  # of one document
    joined = rows.select("row", "id", "base").join(added, "row", "left").select("id", "base", "added")
    return joined.select(F.col("id").alias(id_col), *[F.expr(f"size(filter(base, s -> s.kind = {k}))").cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)],
                         _ordered(F.col("base")).alias("base_spans"), "base", "added").mapInArrow(_resolved, f"{id_col} {texts.schema['id'].dataType.simpleString()}, "
                         + ", ".join(f"n_{name} bigint" for name in KINDS) + f", base_spans {SPAN}, spans {SPAN}, added {SPAN}")


def _ordered(spans):
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.struct(s["kind"], s["start"], s["end"]))


def printed(spans):
    """``kind:start:end`` of spans in their order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _bootstrapped(texts: DataFrame, single: DataFrame, support: int, accept: float, rounds: int) -> DataFrame:
    """(row, kind, start, end, score) of the accepted candidates."""
    features = F.filter(F.array(*[F.struct(F.lit(c).alias("type"), F.col(c).alias("value")) for c in ("form", "left", "right")]), lambda f: f["value"].isNotNull())
    linked = single.select("row", "kind", "start", "end", "status", "instance", F.explode(features).alias("f")).select("*", "f.*").drop("f")
    asked = written(linked.where("status = 0").select("row", "kind", "start", "end", "instance", "type", "value"), "private-candidates")
    # An edge per pattern and instance, however often they meet.
    edges = linked.groupBy("kind", "type", "value", "instance").agg(F.count("*").alias("n"), F.max("status").alias("status"))
    edges = written(edges.join(asked.select("kind", "type", "value").distinct(), ["kind", "type", "value"], "left_semi"), "private-edges")
    totals = written(_occurrences(texts, asked), "private-words")
    known = edges.where("status = 1").select("kind", "instance").distinct()
    scored = None
    for _ in range(rounds):
        here = edges.join(known.withColumn("known", F.lit(1)), ["kind", "instance"], "left")
        sure = F.col("known").isNotNull() & (F.col("status") >= 0)
        patterns = here.groupBy("kind", "type", "value").agg(F.sum(F.when(sure, 1)).alias("support"), F.sum(F.when(sure, F.col("n"))).alias("hits"), F.sum("n").alias("mentions"))
        patterns = patterns.where(F.col("support") >= support).join(totals, ["type", "value"], "left")
        share = F.col("hits") / (F.greatest(F.coalesce("total", F.lit(0)), "mentions") + 1)
        trusted = patterns.where((F.col("type") == "form") | F.col("total").isNotNull()).select("kind", "type", "value", F.least(share, F.lit(0.999)).alias("share"))
        chance = asked.join(trusted, ["kind", "type", "value"]).groupBy("row", "kind", "start", "end", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("share"))))).alias("score"))
        scored = written(chance.groupBy("kind", "instance").agg(F.max("score").alias("score")).where(F.col("score") >= accept), "private-accepted")
        before, known = known, written(known.unionByName(scored.select("kind", "instance")).distinct(), "private-known")
        if known.count() == before.count():
            break
    return asked.select("row", "kind", "start", "end", "instance").distinct().join(scored, ["kind", "instance"]).drop("instance")


def _occurrences(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(type, value, total): how often the context words of candidates stand in all texts."""
    words = asked.where("type <> 'form'").select("type", "value").distinct()
    if not words.limit(1).count():
        return words.withColumn("total", F.lit(0).cast("bigint"))
    sent = texts.sparkSession.sparkContext.broadcast(bitmap(words.select(F.pmod(F.crc32(F.encode("value", "UTF-8")), F.lit(PLACES)).alias("place")), PLACES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            counts: Counter = Counter()
            for text in utf8(batch.column(0)):
                counts.update(WORDS.findall(text.decode("utf-8", "replace")))
            kept: Counter = Counter()
            for w, n in counts.items():
                if len(w) <= LONGEST and (low := w.lower()) and bits[(place := zlib.crc32(low.encode()) % PLACES) >> 3] >> (place & 7) & 1:
                    kept[low] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["value", "n"])

    return words.join(texts.select("text").mapInArrow(count, "value string, n bigint").groupBy("value").agg(F.sum("n").alias("total")), "value").select("type", "value", "total")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, found = [], []
        for text in utf8(batch.column(1)):
            text = text.decode("utf-8", "replace")
            spans, failed = base_spans(text)
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            found.append(mentions(text, spans, failed))
        span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        mention = pa.struct([*span, ("status", pa.int32()), ("instance", pa.int64()), ("form", pa.string()), ("left", pa.string()), ("right", pa.string())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(mention))], ["id", "base", "mentions"])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of overlapping accepted candidates one stays; the rest joins the base spans."""
    for batch in batches:
        every, added = [], []
        for base, found in zip(batch.column("base").to_pylist(), batch.column("added").to_pylist()):
            kept: list[tuple[int, int, int]] = []
            for x in sorted(found or [], key=lambda x: (-round(x["score"], 9), x["start"] - x["end"], x["start"], x["kind"])):
                k = bisect(kept, (x["start"], x["end"], -1))
                if (not k or kept[k - 1][1] <= x["start"]) and (k == len(kept) or kept[k][0] >= x["end"]):
                    kept.insert(k, (x["start"], x["end"], x["kind"]))
            kept = [{"kind": k, "start": s, "end": e} for s, e, k in kept]
            added.append(kept)
            every.append(sorted([*base, *kept], key=lambda s: (s["start"], s["kind"], s["end"])))
        spans = batch.schema.field("base_spans").type
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(every, spans), pa.array(added, spans)], [*batch.schema.names[:6], "spans", "added"])
