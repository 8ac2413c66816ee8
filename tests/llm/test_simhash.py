import numpy as np
import pytest
import xxhash

from helpers import TEXTS, ascii_lower, documents, nothing, words
from revlens.llm import components, simhash


def plain_fingerprint(text):
    w = words(ascii_lower(text or ""))
    shingles = [" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(prints, distance=4):
    fp = np.array(prints, np.uint64)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance)
    return components.local_roots(len(fp), a, b)


@pytest.mark.parametrize("text", [t for t in TEXTS if len(t or "") < 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{k}" for k in range(1000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) % (1 << 64) == plain_fingerprint(text)


def test_every_near_pair_meets_at_a_home():
    rng = np.random.default_rng(3)
    for parts in (2, 3):
        for _ in range(30):
            x = int(rng.integers(0, 1 << 63))
            y = x
            for bit in rng.choice(64, 4, replace=False):
                y ^= 1 << int(bit)
            fp = np.array([x, y], np.uint64)
            cells = [(int(a), int(i), bool(h)) for an, at, ho in simhash._replicas(fp, parts, 4) for a, i, h in zip(an, at, ho)]
            homes = {a for a, i, h in cells if h and i == 0}
            assert homes & {a for a, i, _ in cells if i == 1}


def clustered(n=400):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 20).astype(np.uint64)
    out = []
    for k in range(n):
        x = int(base[k % 20])
        for bit in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            x ^= 1 << int(bit)
        out.append(x)
    return out


@pytest.mark.parametrize("tile", [4096, 4])
def test_classes_match_all_pairs(spark, tile):
    prints = clustered()
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp bigint")
    got = {r["fp"] % (1 << 64): r["root"] for r in simhash.classes(df, tile=tile).collect()}
    root = plain_components(prints)
    for i, p in enumerate(prints):
        for j in range(i):
            assert (got[p] == got[prints[j]]) == (root[i] == root[j])


def test_documents(spark):
    docs = documents(spark)
    rows = docs.collect()
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(r["text"]) if len(r["text"] or "") < 5000 else simhash.fingerprint(r["text"]) % (1 << 64) for r in rows]
    root = plain_components(prints)
    least = {}
    for r, c in zip(rows, root):
        if r["doc_id"] is not None:
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, root))
    assert sorted((g["doc_id"] is None, g["doc_id"] or 0, g["fingerprint"], g["component_id"]) for g in got) == want


def test_one_stays(spark):
    docs = documents(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    ids = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(i for i in ids if i is not None)


def test_empty(spark):
    assert simhash.near_duplicates(nothing(spark)).collect() == []
    assert simhash.one_of_each(nothing(spark)).collect() == []


def test_long_chain_is_one_component(spark):
    links = spark.range(500).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in components.connected(links).collect()} == {0}
