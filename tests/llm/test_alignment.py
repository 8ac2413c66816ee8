import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from helpers import TEXTS, documents, nothing
from revlens.llm import alignment, queries, tokens

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = ["<|endoftext|> in a text", "</s><s> <unk>", " leading", "two  blanks\n\n\tand tab", "▁ low line", "ſ K İ 𝔘 한국어 \U00020bb7", "à﻿​", "\x00\x01", "don't we'll I'm 12345 ½ ²"]


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(texts):
    """One report a text, by loops over the libraries' own tokens."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in tokens._byte_letters().items()}
    a_bytes = {k: bytes(letters[c] for c in t) for t, k in library.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}

    def b_bytes(k):
        p = model.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    rows, pair_docs = [], Counter()
    for text in texts:
        one = {"a": [], "b": [], "links": [], "groups": [], "shared": 0}
        if text:
            a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            pa_, pb = [a_bytes[k] for k in a], [b_bytes(k) for k in b]
            if b"".join(pa_) == b"".join(pb) == (" " + text).encode():
                sa, sb = spans(pa_), spans(pb)
                j0 = 0
                for i, (s, e) in enumerate(sa):
                    while sb[j0][1] <= s:
                        j0 += 1
                    j = j0
                    while j < len(sb) and sb[j][0] < e:
                        one["links"].append((a[i], b[j]))
                        j += 1
                cuts = np.array(sorted({e for _, e in sa} & {e for _, e in sb}))
                ga, gb = defaultdict(list), defaultdict(list)
                for k, (s, _), g in [(k, x, ga) for k, x in zip(a, sa)] + [(k, x, gb) for k, x in zip(b, sb)]:
                    g[int(np.searchsorted(cuts, s, "right"))].append(k)
                one |= {"a": a, "b": b, "groups": [(ga[k], gb[k]) for k in range(len(cuts))]}
                one["shared"] = sum(len(x) * len(y) for x, y in one["groups"])
                pair_docs.update(set(one["links"]))
        rows.append(one)
    top = {}
    for (a, _), n in pair_docs.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for one in rows:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in one["groups"])
        counts = [pair_docs[p] for p in one["links"]]
        best = sum(n == top[p[0]] for p, n in zip(one["links"], counts))
        out.append((len(one["a"]), len(one["b"]), len(one["groups"]), len(one["links"]), one["shared"], best, sum(counts), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return out


def compared(got, ids, texts):
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted([(i, *p) for i, p in zip(ids, plain(texts))], key=key)


def test_odd_texts(spark):
    docs = documents(spark, TEXTS + MORE)
    rows = docs.collect()
    compared(alignment.report(docs, A, B), [r["doc_id"] for r in rows], [r["text"] for r in rows])


def test_given_rows(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    compared(queries.op13_token_alignment(spark, SF), [r["doc_id"] for r in rows], [r["text"] for r in rows])


@pytest.mark.parametrize("expand", [3, 1 << 22])
def test_product_against_dense(expand, monkeypatch):
    monkeypatch.setattr(alignment, "EXPAND", expand)
    rng = np.random.default_rng(1)
    x, y = (rng.random((7, 9)) < 0.4).astype(int), (rng.random((9, 5)) < 0.4).astype(int)
    csr = lambda m: alignment.Csr(np.append(0, np.cumsum(m.sum(1))), np.nonzero(m)[1], m.shape[1])
    got = np.zeros((7, 5), int)
    for i, j, v in alignment.product(csr(x), csr(y)):
        got[i, j] = v
    assert (got == x @ y).all()
    back = csr(x).transposed()
    assert [back.indices[s:e].tolist() for s, e in zip(back.indptr, back.indptr[1:])] == [np.flatnonzero(c).tolist() for c in x.T]


def test_words_give_the_pieces_of_the_text(monkeypatch):
    """Word by word as from the library, whether words are remembered or not; bytes that no token end separates are one column."""
    assert alignment.cut_by_words(B) and not alignment.cut_by_words(A)
    monkeypatch.setattr(alignment, "REMEMBERED", 6)
    tokenizer, a = alignment.Tokenizer(B), alignment.Tokenizer(A)
    words = alignment.Words(tokenizer)
    for text in [t for t in TEXTS + MORE + ["wörter und <0x41> mehr", "ends blank ", " ", "a\n b"] if t] * 2:
        ids = tokenizer.ids(text)
        spelt = b"".join(tokenizer.pieces[k] for k in ids) == b" " + text.encode()
        assert words(text) == (np.array(ids, np.uint16).tobytes() if spelt else None)
    assert words.known
    text = "international tokenizers " * 50
    cols = [pa.array([np.array(x, np.uint16).tobytes()], pa.binary()) for x in (a.ids(" " + text), tokenizer.ids(text))]
    [(_, block)] = alignment._blocks(pa.RecordBatch.from_arrays(cols, names=["a", "b"]), (a.lengths, tokenizer.lengths))
    assert block.matrices[0].width == block.matrices[1].width <= len(block.ids[0]) + len(block.ids[1]) < len(text)


def test_links(spark):
    docs = spark.createDataFrame([(1, "hello token world"), (2, None)], "doc_id bigint, text string")
    report = alignment.report(docs, A, B).filter("doc_id = 1").first()
    rows = alignment.links(docs, A, B).collect()
    assert len(rows) == report["n_links"] and {r["doc_id"] for r in rows} == {1}
    assert {r["a_place"] for r in rows} == set(range(report["n_a"])) and {r["b_place"] for r in rows} == set(range(report["n_b"]))
    assert alignment.links(docs, A, B, by="group").count() == report["n_group_links"]


def test_counts_handed_over_early(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    texts = alignment.encoded(docs, A, B)
    whole = {tuple(r) for r in alignment.pair_counts(texts, A, B).collect()}
    monkeypatch.setattr(alignment, "HELD", 10)
    assert {tuple(r) for r in alignment.pair_counts(texts, A, B).collect()} == whole


def test_empty(spark):
    assert alignment.report(nothing(spark), A, B).collect() == []
