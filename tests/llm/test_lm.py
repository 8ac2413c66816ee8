import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import TEXTS, ascii_lower, documents, nothing, words
from revlens.llm import lm
from revlens.llm.elias_fano import Sequence, encode
from revlens.llm.words import Hasher, text_bytes
import revlens.llm.words as word_module


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=200), st.integers(0, 1 << 42))
def test_sequence(values, extra):
    v = np.sort(np.array(values, np.int64))
    universe = int(v[-1]) + 1 + extra if len(v) else 1 + extra
    if len(v):
        assert Sequence(encode(v, universe, False)).get(np.arange(len(v))).astype(np.int64).tolist() == v.tolist()
    ask = np.append(v, [0, universe - 1])
    s = Sequence(encode(v, universe, True))
    got = s.find(ask, np.zeros(len(ask), np.int64), np.full(len(ask), len(v)))
    for q, at in zip(ask.tolist(), got.tolist()):
        assert (at >= 0) == (q in values) and (at < 0 or v[at] == q)
    assert (s.find(ask, np.zeros(len(ask), np.int64), np.zeros(len(ask), np.int64)) == -1).all()


def test_word_digests_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = [t for t in TEXTS if len(t or "") < 3000] + ["z" * 100, " lead", "trail ", "a" * 40 + " b"]
    data, at = text_bytes(pa.array(texts, pa.string()))
    whole, sizes = Hasher()(data, at)
    assert sizes.tolist() == [len(words(t)) for t in texts]
    names = [ascii_lower(w) for t in texts for w in words(t)]
    assert len(set(names)) == len(set(whole.tolist())) == len(set(zip(names, whole.tolist())))
    for piece in (7, 16):
        monkeypatch.setattr(word_module, "PIECE", piece)
        h, n = Hasher()(data, at)
        assert h.tolist() == whole.tolist() and n.tolist() == sizes.tolist()


def plain_scores(rows, order):
    tokens = lambda t: [*words(ascii_lower(t or "")), "</s>"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [tokens(t) for i, t in rows if not held(i)]
    one = Counter(w for s in train for w in s)
    total, kinds = sum(one.values()), len(one)
    counts = {k: Counter() for k in range(2, order + 1)}
    for s in train:
        full = ["<s>", *s]
        for k in counts:
            counts[k].update(tuple(full[i:i + k]) for i in range(len(full) - k + 1))
    off, after = {}, {}
    for k, c in counts.items():
        seen = Counter(c.values())
        off[k] = [0.0, *lm.discounts([seen[j] for j in (1, 2, 3, 4)])]
        after[k] = defaultdict(list)
        for g, n in c.items():
            after[k][g[:-1]].append(n)

    def p(w, context):
        if not context:
            return (one[w] + 1) / (total + kinds + 1)
        k, lower = len(context) + 1, p(w, context[1:])
        found = after[k].get(context)
        if not found:
            return lower
        n = counts[k][(*context, w)]
        d = off[k]
        return (n - d[min(n, 3)]) / sum(found) + sum(d[min(x, 3)] for x in found) / sum(found) * lower

    out = []
    for i, t in rows:
        s = tokens(t)
        full = ["<s>", *s]
        score = sum(math.log10(p(w, tuple(full[max(0, j + 1 - order + 1):j + 1]))) for j, w in enumerate(s))
        base = sum(math.log10((one[w] + 1) / (total + kinds + 1)) for w in s)
        out.append((held(i), len(s), sum(one[w] > 0 for w in s), total, base, score))
    return out


@pytest.mark.parametrize("order,shard", [(2, 1 << 19), (3, 200), (4, 50)])
def test_against_plain_model(spark, order, shard):
    texts = [t for t in TEXTS if len(t or "") < 3000] + ["the cat sat on a mat", "a dog ran over the hill and the cat sat", "one two one two one", "the hill"] * 3
    docs = documents(spark, texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    from pyspark.sql import functions as F

    bucket = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    model = lm.train(docs.filter(bucket != 2), order=order, shard_size=shard)
    if shard == 50:
        assert len(model.shards) > 3
    got = model.score(docs.withColumn("held_out", bucket == 2), ["held_out", "doc_id"]).collect()
    got = sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["score"]) for r in got)
    want = sorted((*x[:4], round(x[4], 6), x[5]) for x in plain_scores(rows, order))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) <= 0.0005 * g[1]  # 16-bit logarithms


def test_empty(spark):
    assert lm.scores(nothing(spark)).collect() == []
    held = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string")
    for r in lm.scores(held).collect():  # nothing to train on
        assert (r["n_known"], r["train_tokens"], r["score"]) == (0, 0, 0.0)


def test_better_than_single_words_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.scores(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert rows["s"] > rows["b"]
