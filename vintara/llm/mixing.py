"""Mixing sources to target weights: temperature, then budgeted block permutations. Built-in functions only.

The weight of a source is its share of the tokens to the power of an exponent, normalised. The exponent
is found by bisection between 0 (all sources alike) and 1 (as they come): the largest that reaches a
target entropy, or the smallest that keeps the passes over the most repeated source within a limit. A source's
budget is passed out in epochs. In each epoch its blocks of documents stand in a permuted order; whole epochs
take all blocks, the last one blocks in order while they fit, and of the next block the documents that still fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.llm.common import WORD, written

#: Documents of a block, on average. A source of n documents has n / BLOCK_DOCS blocks, so what is ranked is small.
BLOCK_DOCS = 1024
STEPS = 40
#: Sources are a catalogue, not data: more than this is refused, as their shares are bisected as one array.
MAX_SOURCES = 100_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def drawn(seed: int, *parts: Column) -> Column:
    """A number of 60 bits from an MD5 sum: the same in every engine and on every run."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def source_weights(sizes: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None) -> DataFrame:
    """(source, tokens, exponent, weight, budget) of every source with a token, from (source, tokens).

    Exactly one of ``entropy`` (as a part of the largest possible, 0 to 1) and ``repetition`` (passes
    over the most repeated source) is the target. ``budget`` is the number of tokens to give out; None
    takes the least budget under which every source is passed over once. Where the limit cannot be
    kept even by the shares as they are (a budget over ``repetition`` times all tokens), the exponent is 1.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("one target: entropy or repetition")
    some = sizes.where("tokens > 0").agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("all"))
    some = some.withColumn("all", F.when(F.size("all") <= MAX_SOURCES, F.col("all")).otherwise(F.raise_error(F.lit(f"more than {MAX_SOURCES} sources")).cast(some.schema["all"].dataType)))
    total = F.aggregate("all", F.lit(0).cast("bigint"), lambda s, x: s + x["tokens"])
    some = some.withColumn("total", total).withColumn("shares", F.transform("all", lambda x: x["tokens"] / F.col("total")))

    def powers(exponent: Column) -> Column:
        return F.transform("shares", lambda p: F.pow(p, exponent))

    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def fits(exponent: Column) -> Column:
        """Whether the exponent may come down to this value (repetition), or go up to it (entropy)."""
        if repetition is not None:
            ratios = F.transform("shares", lambda p: F.pow(p, exponent - 1))
            if budget is None:
                return F.array_max(ratios) <= F.lit(float(repetition)) * F.array_min(ratios)
            return F.array_max(ratios) * F.lit(float(budget)) <= F.lit(float(repetition)) * F.col("total") * add(powers(exponent))
        z = add(powers(exponent))
        surprise = add(F.transform("shares", lambda p: -F.pow(p, exponent) / z * F.log(F.pow(p, exponent) / z)))
        return surprise >= F.lit(float(entropy)) * F.log(F.size("shares").cast("double")) - F.lit(1e-12)

    step = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    if repetition is not None:  # hi fits or is 1
        halve = lambda s, _: F.when(fits((s["lo"] + s["hi"]) / 2), F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))).otherwise(F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi")))
        found, extreme = (lambda s: s["hi"]), F.when(fits(F.lit(0.0)), F.lit(0.0))
    else:  # lo fits
        halve = lambda s, _: F.when(fits((s["lo"] + s["hi"]) / 2), F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi")))
        found, extreme = (lambda s: s["lo"]), F.when(fits(F.lit(1.0)), F.lit(1.0))
    exponent = F.coalesce(extreme, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), step, halve, found))
    some = some.withColumn("exponent", F.round(exponent, 9)).withColumn("z", add(powers(F.col("exponent"))))
    weight = F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z")
    rows = some.select("total", "exponent", "z", "shares", F.explode("all").alias("of")).select("total", "exponent", "z", "shares", "of.source", "of.tokens").withColumn("weight", F.round(weight, 12))
    # The largest source has the lowest weight for its share: it is passed over once.
    largest = F.array_max("shares")
    whole = F.lit(float(budget)) if budget is not None else F.col("total") * largest / (F.pow(largest, F.col("exponent")) / F.col("z"))
    given = F.floor(F.col("weight") * whole + F.lit(1e-6)) if budget is not None else F.greatest(F.floor(F.col("weight") * whole + F.lit(1e-6)), F.col("tokens"))
    return rows.select("source", "tokens", "exponent", "weight", given.cast("bigint").alias("budget"))


def mixed(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **target) -> DataFrame:
    """Rows of ``docs`` as often as the mixture takes them, all columns, with ``mix``: a struct of the source's
    exponent, weight and budget, the document's tokens, epoch, block (rank in the epoch's permutation) and draw (order in the block).

    A column ``mix`` of the documents is replaced; any other name may be theirs. Sort by epoch, block and draw for the order of training. A source never gets more tokens than its
    budget; it gets less by under one document. A null source counts as ``''``. A document without a word (null
    text too) has no tokens and comes with the blocks and draws of its own place. Rows of the same source and id share
    their draws and come together. An empty table gives no rows. Targets: see ``source_weights``.
    """
    source = F.coalesce(docs[source_col].cast("string"), F.lit(""))
    own = F.struct(source.alias("source"), docs[id_col].cast("string").alias("id"), tokens(docs[text_col].cast("string")).alias("tokens")).alias("own")
    narrow = docs.select(own).select("own.*")
    counts = docs.select(source.alias("source")).groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_DOCS)).alias("blocks"))
    block = lambda i, n: F.pmod(drawn(seed, i), n)
    blocks = written(narrow.join(F.broadcast(counts), "source").groupBy("source", block(F.col("id"), F.col("blocks")).alias("block")).agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    weights = written(source_weights(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), **target), "mix-weights").withColumnRenamed("tokens", "of")

    whole = F.floor(F.col("budget") / F.col("of"))
    passes = blocks.join(F.broadcast(weights), "source").withColumns({"whole": whole, "rest": F.col("budget") - whole * F.col("of")})
    passes = passes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))))
    order = Window.partitionBy("source", "epoch").orderBy(drawn(seed, F.lit("block"), F.col("epoch"), F.col("source"), F.col("block")), "block")
    passes = passes.withColumns({"rank": F.row_number().over(order), "after": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    last = F.col("epoch") == F.col("whole")
    passes = written(passes.where(~last | (F.col("after") - F.col("tokens") < F.col("rest"))).withColumn("cut", last & (F.col("after") > F.col("rest"))), "mix-passes")
    draw = lambda i, e: drawn(seed, F.lit("doc"), e, i)
    # At most one block a source is cut: its documents, in order of draw, while they fit.
    cut = narrow.join(F.broadcast(counts), "source").withColumn("block", block(F.col("id"), F.col("blocks"))).drop("blocks").join(
        F.broadcast(passes.where("cut").select("source", "block", "epoch", (F.col("rest") - F.col("after") + F.col("tokens")).alias("room"))), ["source", "block"])
    cut = cut.withColumn("draw", draw(F.col("id"), F.col("epoch")))
    so_far = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("draw").rangeBetween(Window.unboundedPreceding, 0))
    upto = cut.withColumn("so_far", so_far).where("so_far <= room").groupBy("source").agg(F.max("draw").alias("upto"))
    free = "_"  # begins no column of the documents
    while any(c.startswith(free) for c in docs.columns):
        free += "_"
    at = lambda name: free + name
    table = passes.join(F.broadcast(upto), "source", "left").select(
        F.col("source").alias(at("source")), F.col("block").alias(at("block")), F.struct("exponent", "weight", "budget", "epoch", F.col("rank").alias("block")).alias(at("pass")),
        F.when(F.col("cut"), F.coalesce("upto", F.lit(-1))).alias(at("upto")))
    counts = counts.select(F.col("source").alias(at("source")), F.col("blocks").alias(at("blocks")))
    placed = docs.select(docs["*"], own.alias(at("own"))).withColumn(at("source"), F.col(at("own"))["source"]).join(F.broadcast(counts), at("source"))
    placed = placed.withColumn(at("block"), block(F.col(at("own"))["id"], F.col(at("blocks")))).join(table, [at("source"), at("block")])
    placed = placed.withColumn(at("draw"), draw(F.col(at("own"))["id"], F.col(at("pass"))["epoch"])).where(F.col(at("upto")).isNull() | (F.col(at("draw")) <= F.col(at("upto"))))
    taken = F.col(at("pass"))
    return placed.select(*[placed[c] for c in docs.columns if c != "mix"], F.struct(
        taken["exponent"].alias("exponent"), taken["weight"].alias("weight"), taken["budget"].alias("budget"), F.col(at("own"))["tokens"].alias("tokens"),
        taken["epoch"].alias("epoch"), taken["block"].alias("block"), F.col(at("draw")).alias("draw")).alias("mix"))
