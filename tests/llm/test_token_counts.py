import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vintara.llm import token_counts as token_counts_module
from vintara.llm.token_counts import token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Plain words, twice: plain words.", "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>", " \t\r\n\v\f ", "it's they'll 3rd 12345 x y \x1c z",
         "é é Σίσυφος ΣΑΣ İ ǅ", "日本語 テスト 🙂🙂", "x" * 5000, "ab " * 30000, "Plain words, twice: plain words."]


def test_counts_equal_the_library(docs_of):
    tokenizer = Tokenizer.from_file(PATH)
    docs = docs_of([(i if i != 3 else None, t) for i, t in enumerate(TEXTS)])
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts(docs, PATH).collect())
    assert got == sorted((len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for t in TEXTS)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(docs, PATH).collect()} == want


def test_empty_table_and_clashing_columns(docs_of):
    docs = docs_of([(1, "one two")])
    assert token_counts(docs.limit(0), PATH).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 AS id", "2 AS n_tokens", "3 AS n_bytes")
    assert token_counts(clash, PATH).columns == ["doc_id", "n_bytes", "n_tokens"]
    assert token_counts(clash, PATH).first().n_tokens == 2


def test_refuses_tokenizers_that_keep_white_space():
    with pytest.raises(ValueError):
        token_counts(None, public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("frequent", [0, 3, 1 << 16])
def test_common_and_joined_pre_tokens_add_up(docs_of, monkeypatch, frequent):
    """With any number of pre-tokens sent to the scan the counts are those of the library; each pre-token is cut once."""
    monkeypatch.setattr(token_counts_module, "FREQUENT", frequent)
    tokenizer = Tokenizer.from_file(PATH)
    texts = [" ".join(f"word{(i * k) % 17}{'!' * (k % 3)}" for k in range(40)) for i in range(30)] + TEXTS
    got = {r.doc_id: r.n_tokens for r in token_counts(docs_of(list(enumerate(texts))).repartition(4), PATH).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    with open(PATH, encoding="utf-8") as file:
        table = token_counts_module.pre_tokens(docs_of(list(enumerate(texts))).repartition(4), file.read()).collect()
    assert len({bytes(r.word) for r in table}) == len(table) == len({w for t in texts for w in (t or "").encode().split()})
