import pytest

from helpers import TEXTS, documents, nothing
from revlens.llm import tokens

P = pytest.importorskip("public_tokenizers")
ODD = ["a<|endoftext|>b  c\n\n d", "  ", "it's   x\t\ty 12ab!?  ", "<|endoftext|><|endoftext|>", "日本語 テスト x\x1cy\x85z", "ā́ Ⅷ ½ ０１ 　 x", "\U00010400\U0001f600 \U000e0041", "՘ ⃟ don't I'LL we'll"]


@pytest.fixture(scope="module")
def facts():
    return tokens.prepare(P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_as_the_library(facts, chunk, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    count, library = tokens.counter(facts), tokens.counter({"path": facts["path"], "odd": None})
    for text in [t or "" for t in TEXTS] + ODD:
        assert count(text) == library(text)


def test_every_whole_token_is_proved(facts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(facts["path"])
    whole = tokens.WholeTokens(tokenizer)
    assert whole.proved > 45_000
    for text in list(whole)[::97]:
        assert len(tokenizer.encode(text, add_special_tokens=False).ids) == 1


def test_table(spark):
    docs = documents(spark, TEXTS + ODD)
    path = P.path("byte_bpe_50k.json")
    library = tokens.counter({"path": path, "odd": None})
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(docs, path).collect())
    want = [(r["doc_id"] or -1, len((r["text"] or "").encode()), library(r["text"] or "")) for r in docs.collect()]
    assert got == sorted((*w, w[2] > 1024) for w in want)
    assert tokens.token_counts(nothing(spark), path).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_kinds_are_left_to_the_library(spark, name):
    facts = tokens.prepare(P.path(name))
    assert facts["odd"] is None and tokens.counter(facts)("one two") >= 2
