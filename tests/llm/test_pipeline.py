"""Every stage against a brute-force version, on its own input."""

import public_tokenizers
import sentencepiece
from test_jaccard import brute as near_brute
from test_substrings import brute as repeats_brute

import corpus_pipeline


def test_stages_on_given_documents(spark, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    read = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, docs, "").write.parquet(path)
        before, docs = docs.collect(), spark.read.parquet(path)
        read[name] = before, docs.collect()
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = read["language ID"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if any(map(str.isalpha, r.text)))
    before, after = read["n-gram Jaccard join"]
    want = {c for _, c, _, _ in near_brute([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(want) and len(want) < len(before)
    before, after = read["substring dedup"]
    want = {i: n - gone for i, n, gone, _ in repeats_brute([(r.doc_id, r.text) for r in before]) if n > gone}
    assert {r.doc_id: len(r.text.encode().split()) for r in after} == want
    before, after = read["mixing sources to target weights"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before} and len(after) <= 1.3 * len(before)
    before, after = read["SentencePiece encoding and decoding"]
    assert all(r.exact for r in after)
    texts = {r.doc_id: r.text for r in before}
    assert all(r.ids == library.encode(texts[r.doc_id]) for r in after)


def test_odd_rows(docs_of, tmp_path, spark):
    rows = [(i, f"the words of document {i} and that is " * 4, "en", "a") for i in range(12)]
    rows += [(None, None, None, None), (50, "", "en", "b"), (51, "123", "en", "b"), (None, "the words of a null id and that is it", None, None), (3, rows[3][1], "en", "a"), (3, rows[3][1], "en", "a")]
    for name, start in (("odd", docs_of(rows)), ("empty", docs_of(rows).limit(0))):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}{k}"
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)
        ids = [r.doc_id for r in docs.collect()]
        assert (name == "empty") == (not ids) and not {50, 51} & set(ids)
