"""Token counts against the library itself."""

import random

import pytest

from eventloom.llm import tokencount
from eventloom.llm.queries import op12_token_counts, vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts(library):
    rng = random.Random(11)
    pieces = [library.id_to_piece(rng.randrange(259, 32000)).replace("▁", " ") for _ in range(3000)]
    kinds = [
        lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))),
        lambda: "".join(rng.choice("ab \n▁<s>é梦😀\0xyz=-") for _ in range(rng.randint(0, 150))),
        lambda: rng.choice("ab e1=-._ \n▁") * rng.randint(0, 500) + "".join(rng.choice(" aeth") for _ in range(rng.randint(0, 300))),
        lambda: "".join(rng.choice(["the", "un", "ing", "  ", "in", "er", "tion", "=", "==", "\t", "</s>", "<0x0A>"]) for _ in range(rng.randint(0, 300))),
    ]
    texts = [rng.choice(kinds)() for _ in range(3000)]
    assert tokencount.counter(PATH).count(texts) == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000, "=-" * 50_000, "the" * 50_000, "x " * 100_000, "梦" * 20_000, "\n" * 50_000])
def test_long_texts(text, library):
    assert tokencount.counter(PATH).count([text]) == [len(library.encode(text))]


def test_memo_may_be_small(library, monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO", 10)
    monkeypatch.setattr(tokencount, "STRETCH", 50)
    texts = ["one two  three " * 20, "", "seven eight nine" * 30, None] * 5
    assert tokencount.Counter(PATH).count(texts) == [len(library.encode(x or "")) for x in texts]


def test_whole_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = {d.doc_id: len(library.encode(d.text or "")) for d in docs}
    got = op12_token_counts(spark, small).collect()
    assert len(got) == len(docs)
    text = {d.doc_id: d.text or "" for d in docs}
    assert all(r.n_tokens == want[r.doc_id] and r.over_limit == (r.n_tokens > 4096) and r.n_bytes == len(text[r.doc_id].encode()) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, 5, True), (None, "", 5, True), (2, "é " * 5000, 5, True), (2, "é " * 5000, 5, True)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, over_limit boolean")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(d, PATH).collect())
    assert got[0] == (0, 0, 0, False) and got[1] == (1, 0, 0, False) and got[2] == got[3] and got[2][1] == 15_000 and got[2][3]
    assert tokencount.count_tokens(d.limit(0), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    with pytest.raises((OSError, RuntimeError, ValueError)):
        tokencount.Counter(str(tmp_path / "none.model"))
