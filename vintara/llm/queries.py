"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vintara.llm import oracle
from vintara.llm.common import fold, table
from vintara.llm.jaccard import near_duplicates
from vintara.llm.language import fit_language, predict_language
from vintara.llm.lexical import ranked_search
from vintara.llm.mixing import mixed
from vintara.llm.pieces import encode
from vintara.llm.private import personal_data, printed
from vintara.llm.quality import quality
from vintara.llm.spotsigs import fingerprints
from vintara.llm.substrings import remove_repeats
from vintara.llm.token_counts import token_counts
from vintara.llm.toxicity import fit_toxicity, score_toxicity
from vintara.llm.variants import variant_groups, word_counts
from vintara.llm.warc import archived_pages

#: A document of more tokens does not fit a training context.
CONTEXT = 2048


#: Score from which a document counts as toxic.
TOXIC = 0.3


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), repetition=2.0).select("doc_id", "source", "mix.*")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs, fold(F.col("doc_id"), 3) != 1)
    return predict_language(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages")).select(
        "page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "target_uri")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > CONTEXT)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    return score_toxicity(docs, index).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(word_counts(table(spark, sf_dir, "documents")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(printed("base_spans"), 256).alias("base_sha256"), printed("spans").alias("spans"), printed("added").alias("added"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_language_id, op3_quality, op4_ngram_jaccard, op5_pieces, op6_substring_dedup, op7_warc, op8_token_counts, op9_toxicity, op10_spotsigs,
                                   op11_spelling_variants, op12_lexical_search, op13_personal_data)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": oracle.MIXING, "op6_substring_dedup": oracle.SUBSTRINGS, "op7_warc": oracle.WARC, "op11_spelling_variants": oracle.VARIANTS, "op12_lexical_search": oracle.LEXICAL}
