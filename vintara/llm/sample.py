"""A bounded sample of labelled rows, chosen by the hash of the text: the same rows on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def labelled_sample(rows: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` distinct texts of every label: (h, label, of) with ``of`` the label's rows.

    ``rows`` has the columns h (hash of the text) and ``label`` (not null); ids play no part. Copies count as one text. The
    hash threshold of a label, set from its distinct texts, leaves about 1.5 times the bound before the exact cut, so a label
    with a third of all rows is never gathered. The counts per label are joined by equality; labels are
    the classes of a model.
    """
    texts = rows.groupBy(label, "h").agg(F.count("*").alias("copies"))
    sizes = texts.groupBy(label).agg(F.sum("copies").alias("of"), F.count("*").alias("texts"))
    share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    few = texts.join(sizes, label).where(share < 1.5 * bound / F.col("texts"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("h"))
    return few.withColumn("rank", rank).where(F.col("rank") <= bound).select("h", label, "of")


def sampled_texts(rows: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sampled text: ``keys`` (h and perhaps the label) and its text, however many rows have it.

    The sample is sent to the scan: it has the bound of ``labelled_sample`` in rows per label.
    """
    return rows.join(F.broadcast(sample), keys, "left_semi").groupBy(*keys).agg(F.min("text").alias("text"))
