import pytest
from pyspark.sql import functions as F

from vintara.llm.sample import labelled_sample, sampled_texts


@pytest.mark.parametrize("copies", [1, 2000])
def test_copies_do_not_shrink_the_sample(spark, copies):
    rows = spark.range(10 * copies).select((F.col("id") % 10).cast("string").alias("text"), F.lit("en").alias("lang")).withColumn("h", F.xxhash64("text"))
    got = labelled_sample(rows, "lang", 50)
    assert {r.of for r in got.collect()} == {10 * copies}
    assert sorted(r.text for r in sampled_texts(rows, got, ["h", "lang"]).collect()) == [str(k) for k in range(10)]


def test_bound_holds(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"), F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("lang"))
    got = labelled_sample(rows, "lang", 300).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"rare": 200, "common": 300}
