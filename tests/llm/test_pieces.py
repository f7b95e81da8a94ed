import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vintara.llm.pieces import UNIGRAM, Decoder, Forward, Pieces, _encoded, decode, encode, load

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = load(PATH)
FORWARD, DECODER = Forward(PIECES), Decoder(PIECES)


def ids_of(texts):
    ids, ends, exact = _encoded(texts, PIECES, FORWARD, DECODER)
    assert exact == [d == t for d, t in zip(DECODER.decode(ids, ends), texts)]
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("  \n\tabcdehinorst.,!▁éß日한🙂\0"), max_size=60), max_size=5))
def test_ids_equal_the_library(texts):
    assert ids_of(texts) == [LIBRARY.encode(t) for t in texts]


def test_long_runs_and_random_words():
    rng = random.Random(3)
    texts = [" " * n + "word" + " " * n for n in range(60)] + ["a" * 3000, "=" * 500, "ab" * 999]
    texts += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(300)) for _ in range(20)]
    assert ids_of(texts) == [LIBRARY.encode(t) for t in texts]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    want = {r.doc_id: (LIBRARY.encode(r.text), r.text) for r in docs.collect()}
    rows = encode(docs, PATH)
    got = rows.collect()
    assert {r.doc_id: r.ids for r in got} == {k: v for k, (v, _) in want.items()} and all(r.exact and r.n_tokens == len(r.ids) for r in got)
    assert {r.doc_id: r.text for r in decode(rows, PATH).collect()} == {k: t for k, (_, t) in want.items()}


def test_edge_cases(docs_of):
    rows = [(None, "a b"), (1, None), (2, ""), (3, " x  y \n z "), (1, None), (4, "w▁w"), (5, "long text " * 200_000)]
    docs = docs_of(rows).withColumns({"ids": F.lit("clash"), "id": F.lit(1)})
    got = encode(docs, PATH).collect()
    assert sorted((len(r.ids), r.exact) for r in got) == sorted((len(LIBRARY.encode(t or "")), t != "w▁w") for _, t in rows)
    assert encode(docs.limit(0), PATH).count() == 0
    assert [r.text for r in decode(docs.selectExpr("1 AS doc_id", "CAST(NULL AS array<int>) AS ids").limit(1), PATH).collect()] == [""]


@pytest.mark.parametrize("seed", range(4))
def test_unigram_scores_are_maximal(seed):
    rng = random.Random(seed)
    names = ["<unk>"] + sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 3))) for _ in range(25)} | {"a", "b", "▁"})
    names = [n for n in names if "▁" not in n.lstrip("▁")]
    pieces = Pieces(names, [0.0] + [-rng.random() * 5 for _ in names[1:]], [2] + [1] * (len(names) - 1), UNIGRAM, True, False)
    best = {"": 0.0}

    def search(text):
        if text not in best:
            best[text] = max(search(text[: -len(n)]) + pieces.scores[i] for n, i in pieces.ids.items() if text.endswith(n))
        return best[text]

    for _ in range(30):
        text = "".join(rng.choice("ab ") for _ in range(10))
        ids, ends, _ = _encoded([text], pieces, Forward(pieces), Decoder(pieces))
        assert abs(sum(pieces.scores[i] for i in ids) - search("▁" + text.replace(" ", "▁"))) < 1e-9
        assert Decoder(pieces).decode(ids, ends) == [text]
