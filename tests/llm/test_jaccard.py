import random

import numpy as np
import pytest

from helpers import ascii_lower, documents, nothing, words
from revlens.llm import components, jaccard, queries

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = words(ascii_lower(text or ""))
    return {" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def plain(rows):
    """(doc_id, n_shingles, component_id) by all pairs that share a shingle; rows: (doc_id, text)."""
    sets, holders = [shingles(t) for _, t in rows], {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    pairs = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = components.local_roots(len(rows), *np.array(pairs or np.empty((0, 2)), np.int64).reshape(-1, 2).T)
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, root)]


def compared(df, rows):
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([tuple(r) for r in df.collect()], key=key) == sorted(plain(rows), key=key)


def test_odd_rows(spark):
    docs = documents(spark)
    compared(jaccard.near_duplicates(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_given_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    compared(queries.op11_jaccard_join(spark, SF), rows)


def near_texts(n=240, seed=3):
    """Texts of 5 to 200 words in families around the threshold, with a passage many share."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    out = []
    for family in range(n // 8):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 200))] + passage * (family % 3 == 0)
        for _ in range(8):
            w = list(base)
            for at in rng.sample(range(len(w)), min(len(w), round(len(w) * rng.uniform(0, 0.05)))):
                w[at] = f"z{rng.randrange(3000)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small, slab", [(32, 1 << 14), (1, 1 << 14), (2, 3)])
def test_families_around_the_threshold(spark, small, slab):
    rows = list(enumerate(near_texts()))
    rng = random.Random(1)
    rng.shuffle(rows)
    compared(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), small=small, slab=slab), rows)


def test_second_round_finds_what_the_first_leaves(spark, monkeypatch):
    """Without the first round's links the second must find all of them."""
    rows = list(enumerate(near_texts(120, 7)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = jaccard.sets_of(docs)
    own = jaccard.confirmed

    def none_at_first(pairs, some, name):
        return own(pairs.limit(0) if name == "first" else pairs, some, name)

    monkeypatch.setattr(jaccard, "confirmed", none_at_first)
    got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in jaccard.links(docs.selectExpr('xxhash64(text) as print', 'text'), sets, small=1).collect()}
    node = {r["doc_id"]: bytes(r["node"]) for r in sets.collect()}
    texts = [shingles(t) for _, t in rows]
    want = {frozenset((node[a], node[b])) for a in range(len(rows)) for b in range(a) if node[a] != node[b] and 100 * len(texts[a] & texts[b]) >= 85 * len(texts[a] | texts[b])}
    assert got == want and len(want) > 20


def test_large_group_and_hot_shingles(spark):
    """A hub with many copies that are not linked with each other, among texts that all share a passage."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        w = list(base)
        for at in rng.sample(range(120), 2):
            w[at] = f"z{rng.random()}"
        rows.append((k, " ".join(w)))
    rows += [(k, " ".join([f"v{rng.randrange(10 ** 6)}" for _ in range(8)] + base[:60])) for k in range(400, 600)]
    compared(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), rows)


@pytest.mark.parametrize("small", [1, 32])
def test_only_sets_of_bounded_pairs_are_fetched(spark, monkeypatch, small):
    """Texts that share a passage meet in large slabs, but most of their pairs stay below the bound."""
    rows = list(enumerate(near_texts(160, 5)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets, own, seen = jaccard.sets_of(docs), jaccard.confirmed, []

    def noted(pairs, some, name):
        ends = {h for r in pairs.collect() for h in (r["a"], r["b"])}
        seen.append((name, ends, {r["half"] for r in some.collect()}))
        return own(pairs, some, name)

    monkeypatch.setattr(jaccard, "confirmed", noted)
    jaccard.links(docs.selectExpr("xxhash64(text) as print", "text"), sets, small=small).collect()
    assert [name for name, _, _ in seen] == ["first", "second"] and seen[0][1]
    assert all(fetched == ends for _, ends, fetched in seen)


def test_tree_join_against_all_pairs():
    rng = np.random.default_rng(2)
    start, low, high, size = [0], [], [], []
    for n in (1, 2, 17, 300, 0, 40):
        count = (rng.integers(0, 40, (1, 16)) + rng.integers(0, 9, (n, 16))).astype(np.uint8)
        low.append(count[:, :8].copy().view(np.int64).ravel())
        high.append(count[:, 8:].copy().view(np.int64).ravel())
        size.append(count.sum(1).astype(np.int64))
        if n:
            start.append(start[-1] + n)
    low, high, size = (np.concatenate(x) for x in (low, high, size))
    points = jaccard.Points(size << 8, low, high)
    label = rng.integers(0, 100, len(size))
    got = sorted((int(a), int(b)) for i, j in jaccard.tree_join(np.array(start), points, label) for a, b in zip(i, j))
    want = [
        (a, b) for s, e in zip(start, start[1:]) for a in range(s, e) for b in range(a + 1, e)
        if label[a] != label[b] and np.minimum(points.count[a], points.count[b]).sum() >= jaccard.needed(size[a], size[b])
    ]
    assert got == want and want


def test_point_bounds_every_overlap():
    rng = np.random.default_rng(3)
    for n in (1, 300, 5000, 80_000):
        own = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        count, shift = jaccard.point(own, 16)
        assert (count.astype(int) << shift >= np.bincount((own >> np.uint64(60)).astype(int), minlength=16)).all() and count.sum() << shift < 1.1 * len(own) + 16


def test_empty(spark):
    assert jaccard.near_duplicates(nothing(spark)).collect() == []
