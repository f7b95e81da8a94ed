import numpy as np
from pyspark.sql import functions as F

from vintara.llm.common import fold
from vintara.llm.language import SIZE, fit_language, grams, predict_language, weighted


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_language(docs, fold(F.col("doc_id"), 3) != 1, bound=100)
    got = {r.doc_id: r for r in predict_language(docs, model).collect()}
    held = docs.where(fold(F.col("doc_id"), 3) == 1).collect()
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert not any(r.rejected for r in got.values()) and all(0 <= r.score <= 1 for r in got.values())
    # brute force: nearest centroid of every text on its own
    for r in docs.limit(20).collect():
        cosines = model.centroids @ weighted(grams(r.text)[0][None], model.weights)[0]
        assert model.languages[model.of[cosines.argmax()]] == got[r.doc_id].lang_pred


def test_edge_cases(docs_of):
    rows = [(i, "the of and that with " * 3 + str(i), "en") for i in range(6)] + [(10 + i, "der die und das nicht " * 3, "de") for i in range(6)]
    odd = [(None, None, None), (20, "", "en"), (21, "123 !? \n", "de"), (22, "the of and", None), (23, "日本語" * 400_000, None), (24, "x", None), (22, "the of and", None)]
    docs = docs_of(rows + odd)
    model = fit_language(docs, F.col("doc_id") < 20, bound=3, clusters=8)
    assert model.languages == ["de", "en"]
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in predict_language(docs.withColumn("rejected", F.lit(1)), model).collect()]
    assert len(got) == len(rows + odd) and {(None, "und", True), (20, "und", True), (21, "und", True), (22, "en", False)} <= set(got)
    assert [x for x in got if x[0] == 23][0][2]  # another script is far from every centroid
    empty = fit_language(docs.limit(0), F.lit(True))
    assert empty.languages == [] and {r.lang_pred for r in predict_language(docs, empty).collect()} == {"und"}
    assert predict_language(docs.limit(0), model).count() == 0


def test_ngrams_of_a_long_text_are_those_of_its_stretches():
    counts, letters = grams("ab " * 700_000)
    assert letters == 1_400_000 and counts.shape == (SIZE,)
    assert grams(None)[1] == grams("")[1] == 0


def test_sample_is_bounded_by_texts_and_not_by_ids(docs_of, monkeypatch):
    """One id, or none, for all rows: the model is that of the texts."""
    rows = [(f"the of and that with {i}", "en") for i in range(300)] + [(f"der die und das nicht {i}", "de") for i in range(300)]
    models = [fit_language(docs_of([(name(k), *r) for k, r in enumerate(rows)]), F.lit(True), bound=5) for name in (lambda k: k, lambda k: 7, lambda k: None)]
    assert all(m.languages == ["de", "en"] and np.array_equal(m.centroids, models[0].centroids) for m in models)


def test_letters_in_no_order_and_unlearned_languages_are_rejected(spark, docs_of):
    rng = np.random.default_rng(0)
    model = fit_language(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), F.lit(True))
    noise = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(40))) for i in range(30)]
    unlearned = [(40, "ja pani jest w domu ale nie wiem czy przyjdzie jutro rano z dziećmi bo wszyscy są już bardzo zmęczeni i chcą spać"),
                 (41, "minä olen talossa mutta en tiedä tuleeko hän huomenna aamulla lasten kanssa koska kaikki ovat jo hyvin väsyneitä ja haluavat nukkua"),
                 (42, "ben evdeyim ama yarın sabah çocuklarla gelip gelmeyeceğini bilmiyorum çünkü herkes çok yorgun ve uyumak istiyor artık")]
    assert all(r.rejected for r in predict_language(docs_of(noise + unlearned), model).collect())
