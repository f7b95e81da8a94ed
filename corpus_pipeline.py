"""From documents to token ids: language ID, near duplicates, repeated passages, mixing, encoding.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame that is
written as Parquet and read again as the documents of the next. All but the last return the columns of ``documents``.
Stages take null and repeated ids, null texts and languages, and empty tables, as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vintara.llm.common import new_path, table
from vintara.llm.jaccard import near_duplicates
from vintara.llm.language import fit_language, predict_language
from vintara.llm.mixing import mixed
from vintara.llm.pieces import encode
from vintara.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Passes over the most repeated source; every source is passed over once at least.
REPETITION = 1.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or far from every language go; the others carry the predicted language.

    Where no row names a language there is no model, nothing to judge by, and all documents stay.
    """
    model = fit_language(docs, F.lit(True))
    if not model.languages:
        return docs.select(*COLUMNS)
    whole = docs.select("text", F.struct(*COLUMNS).alias("row"))
    kept = predict_language(whole, model, id_col="row").where("NOT rejected")
    return kept.select("row.doc_id", "row.text", F.col("lang_pred").alias("lang"), "row.source", "row.n_chars")


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document of least id stays, once."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text")).alias("key")
    first = near_duplicates(docs.select("text", key), id_col="key").where("key = class_id").select("key").distinct()
    return docs.select(*COLUMNS, key).join(first, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere are cut out; a document of which no word is left goes."""
    cut = remove_repeats(docs.select("text", F.struct("doc_id", "lang", "source", "n_chars").alias("row")), id_col="row").where("n_words > n_removed")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars"))
    return cut.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", n_chars.alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at a temperature under which the smallest is passed over 1.25 times; no document is left out."""
    return mixed(docs.select(*COLUMNS), repetition=REPETITION).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicate_removal), ("substring dedup", substring_removal),
          ("mixing sources to target weights", mixing), ("SentencePiece encoding and decoding", encoding)]
#: The first, second and last stage can't be expressed in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.split()[0].lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
