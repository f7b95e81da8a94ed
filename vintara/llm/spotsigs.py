"""Document fingerprints from spot signatures: chains of content words after common-word anchors. Built-in functions only.

A text in lower case is cut into words (letters and digits). A common word is an anchor; it marks the
content word that follows, together with anchors right before it. A signature is such a marked word with
the next ``CHAIN - 1`` content words. Lists and tables have few common words, so a content word whose own hash is a
multiple of ``EVERY`` also begins a chain. A text without any signature has one, of its whole text.
A fingerprint is the SHA-256 of the whole set of the signatures' 32-bit hashes in order; likeness is the Jaccard
similarity of whole sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vintara.llm.common import written

#: Common words of four languages.
ANCHORS = ("a an and are as at be by for from had has have he her his in is it its not of on or she that the they this to was were which with you "
           "au aux ce dans des du elle en est et il je la le les ne nous ou par pas pour qui que se sont sur un une "
           "als auch auf aus bei das dem den der die ein eine es für ich im ist mit nicht sich sie sind und von wird zu "
           "al como con de del el ella los las lo más no para pero por según si sin su sus una y").split()
CHAIN, EVERY = 2, 8
#: Scripts that are written without spaces (Thai to Khmer, kana and Han): each of their characters is a word.
UNSPACED = r"([\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}])"


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the distinct 32-bit hashes of a text's spot signatures, never empty, in order; null is the empty text.

    The steps are columns of their own: functions of arrays work out their arguments as often as they
    name them, and a text should be cut once.
    """
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNSPACED, " $1 ")
    words = F.regexp_replace(apart, r"[^\p{L}\p{N}]+", " ")
    anchored = F.regexp_replace(F.concat(F.lit(" "), F.trim(words), F.lit(" ")), f"(?<= )({'|'.join(dict.fromkeys(ANCHORS))}) ", "$1^")
    following = [F.slice("_bare", k + 1, F.greatest(F.size("_bare") - k, F.lit(0))).alias(f"n{k}") for k in range(1, CHAIN)]
    begins = lambda p: (p["b"] != "") & (F.contains(p["m"], F.lit("^")) | (F.pmod(F.hash(p["b"]), F.lit(EVERY)) == 0))
    chain = lambda p: F.hash(p["m"], *[p[f"n{k}"] for k in range(1, CHAIN)])
    df = df.withColumn("_marked", F.split(F.trim(anchored), " "))
    df = df.withColumn("_bare", F.transform("_marked", lambda w: F.substring_index(w, "^", -1)))
    df = df.withColumn("_pairs", F.arrays_zip(F.col("_marked").alias("m"), F.col("_bare").alias("b"), *following))
    df = df.withColumn("_found", F.array_sort(F.array_distinct(F.transform(F.filter("_pairs", begins), chain))))
    whole = F.array(F.hash(F.coalesce(text, F.lit("")), F.lit(1)))
    return df.withColumn(out, F.when(F.size("_found") > 0, F.col("_found")).otherwise(whole)).drop("_marked", "_bare", "_pairs", "_found")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets, 0 to 1."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def printed(found: Column) -> Column:
    """SHA-256 of a whole set in order: equal where the sets are."""
    return F.sha2(F.array_join(F.transform(found, lambda h: h.cast("string")), ","), 256)


def with_next(docs: DataFrame, add, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ``carried``, ``next_text``, ``next_carried``): the document after this in descending id.

    ``add`` adds the column ``carried`` to a table of texts.

    After the last comes the first; a single document is its own next. Null ids come last, equal
    ids in descending order of their text's hash; a null text is the empty text. Ids are numbers. The order is cut into
    ranges of about equal size by approximate percentiles; a range gets a copy of the first document of the
    range after it, so a range is worked on alone, and the text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    cuts = rows.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    above = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("id"))) if cuts else F.lit(0)
    rows = rows.withColumns({"range": F.when(F.col("id").isNull(), F.lit(-1)).otherwise(above), "tie": F.xxhash64("text")})
    # One row per range: the first document's id and tie, and the range that comes before.
    firsts = rows.select("range", F.struct("id", "tie").alias("first")).groupBy("range").agg(F.max("first").alias("first"))
    order = Window.orderBy(F.desc("range"))
    heads = firsts.select("first.id", "first.tie", F.coalesce(F.lag("range").over(order), F.last("range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    heads = F.broadcast(heads.select(F.col("id").alias("head_id"), F.col("tie").alias("head_tie"), "before"))  # one row per range
    ghosts = rows.join(heads, F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))).dropDuplicates(["before"])
    ghosts = ghosts.select(F.lit(1).alias("ghost"), F.col("before").alias("range"), "id", "tie", "text")
    placed = rows.select(F.lit(0).alias("ghost"), "range", "id", "tie", "text").unionByName(ghosts)
    following = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("id"), F.desc("tie"))
    led = add(placed).withColumns({f"next_{c}": F.lead(c).over(following) for c in ("text", "carried")})
    return led.where("ghost = 0").select("id", "text", "carried", "next_text", "next_carried")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars``, ``edited_text``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text has the last third of the code points (rounded down) replaced by as many, or all, of the
    first of the next document (see ``with_next``). ``near_edited`` and ``near_next`` are exact. Equal texts have equal fingerprints. A null text
    is the empty text. Null and repeated ids stay, row by row; other columns are not read; no rows give no rows.
    """
    rows = with_next(docs, lambda df: with_signatures(df, "text", "carried"), id_col, text_col)
    third = F.floor(F.char_length("text") / 3).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = with_signatures(rows.withColumn("edited_text", edited), "edited_text", "edited")
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_text", printed(F.col("carried")).alias("fingerprint"), printed(F.col("edited")).alias("edited_fingerprint"),
                       likeness(F.col("carried"), F.col("edited")).alias("near_edited"), likeness(F.col("carried"), F.col("next_carried")).alias("near_next"))


def near_sets(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs of different signature sets of Jaccard similarity ``threshold`` or more, and who has which set.

    Returns (set_a, set_b, similarity) with set_a < set_b, and membership (id, set). Documents of equal
    sets are one set, however many. Sets are partitioned by length, so that only equal or neighbouring
    classes meet; inside, two sets meet if they share one of the rarest signatures of their prefixes
    (a set of n and threshold t: the n - ceil(t n) + 1 rarest), which no pair of that similarity lacks.
    """
    found = with_signatures(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), "text", "signatures").drop("text")
    named = written(found.withColumn("set", F.md5(F.concat_ws(",", F.transform("signatures", lambda h: h.cast("string"))))), "spots")
    sets = named.groupBy("set").agg(F.first("signatures").alias("signatures")).withColumn("n", F.size("signatures"))
    single = sets.select("set", "n", F.explode("signatures").alias("h"))
    common = single.groupBy("h").agg(F.count("*").alias("sets"))
    rank = F.row_number().over(Window.partitionBy("set").orderBy("sets", "h"))
    prefix = single.join(common.where("sets > 1"), "h").withColumn("rank", rank + F.col("n") - F.count("*").over(Window.partitionBy("set")))
    prefix = prefix.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - F.lit(1e-9)) + 1)
    lengths = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)) + F.lit(1e-9))
    prefix = prefix.select("set", "n", "h", lengths.alias("length"))
    left = prefix.select(F.col("set").alias("a"), F.col("n").alias("na"), "h", "length")
    right = prefix.select(F.col("set").alias("b"), F.col("n").alias("nb"), "h", F.explode(F.array(F.col("length") - 1, F.col("length"), F.col("length") + 1)).alias("length"))
    close = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - F.lit(1e-9)) & (F.col("a") < F.col("b"))
    pairs = left.join(right, ["h", "length"]).where(close).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("signatures").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("signatures").alias("y")), "b")
    similarity = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return both.select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold), named.select("id", "set")
