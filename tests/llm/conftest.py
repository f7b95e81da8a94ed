import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, lang[, source]]) tuples; n_chars is null."""
    def make(rows):
        return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)
    return make
