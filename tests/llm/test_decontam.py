import random
import re

import numpy as np

from helpers import TEXTS, documents, nothing
from revlens.functions.lcs import common_words
from revlens.llm import decontam

CLEAN = "quiet rivers carry {} stones past the mill while farmers count {} sheep near an old bridge of wood and iron in the rain"


def item_words(text):
    return re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", text.lower())


def corpus(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    clean = [CLEAN.format(f"n{k}", f"m{k * k}") * 3 for k in range(40)]
    rows, want = [], set()
    for k, (item, text) in enumerate(items):
        w = text.split()
        kind = k % 4
        if kind == 0:  # copy
            leak = text
        elif kind == 1:  # other case and punctuation
            leak = " -- ".join(x.upper() for x in w)
        elif kind == 2:  # every tenth word replaced
            leak = " ".join("zz" if j % 10 == 5 else x for j, x in enumerate(w))
        else:  # half of it is no leak
            leak = " ".join(w[: len(w) // 3])
        rows.append((1000 + k, f"{clean[k % 40]} {leak} {clean[(k + 1) % 40]}"))
        if kind != 3:
            want.add((1000 + k, item))
    return items, rows + [(k, t) for k, t in enumerate(clean)], want


def test_planted_passages(spark):
    items, rows, want = corpus(spark)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert len(want - got) <= 0.1 * len(want) and not got - want
    left = {r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()}
    assert left == {r[0] for r in rows} - {d for d, _ in got}


def test_paraphrase_needs_the_answer(spark):
    item = "the old clock maker of lund wound every spring twice before noon. Its bell rang seven times"
    near = "the old clock fixer of lund wound each spring once before noon today"
    rows = [(1, f"{CLEAN} {near} its bell rang seven times {CLEAN}"), (2, f"{CLEAN} {near} {CLEAN}"), (3, CLEAN)]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()] == [(1, 7)]


def test_odd_rows(spark):
    docs = documents(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, TEXTS[10]), (5, TEXTS[10]), (None, TEXTS[9])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert {(10, 4), (10, 5), (11, 4), (12, 4), (9, None)} <= got
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and not {9, 10, 11, 12} & {r["doc_id"] for r in kept.collect()}
    assert decontam.leaks(docs, bench.limit(0)).collect() == [] and decontam.leaks(nothing(spark), bench).collect() == []
    assert decontam.without_leaks(docs, bench.limit(0)).count() == docs.count()


def test_common_against_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 90))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 120))]
        b = [w for w in b if w in a]
        assert decontam.common(a, b) == common_words(a, b)


def test_recall_on_given_rows(spark):
    """Against a plain search for shared five-word runs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    runs, size = {}, {}
    for r in bench.collect():
        w = item_words(r["text"])
        size[r["item_id"]] = max(1, len(w) - 4)
        for k in range(len(w) - 4):
            runs.setdefault(tuple(w[k:k + 5]), set()).add(r["item_id"])
    want = set()
    for r in docs.collect():
        seen, w = {}, item_words(r["text"] or "")
        for run in {tuple(w[k:k + 5]) for k in range(len(w) - 4)}:
            for i in runs.get(run, ()):
                seen[i] = seen.get(i, 0) + 1
        want |= {(r["doc_id"], i) for i, n in seen.items() if n >= 0.7 * size[i]}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert want and len(want & got) >= 0.9 * len(want) and not got - want


def test_recall_on_planted_paraphrases(spark):
    """Paraphrases with 0.6 to 0.7 of the words and the answer, against the common subsequence of all pairs."""
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    other = [w for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(400).collect() for w in item_words(r["text"] or "")]
    filler = lambda n: " ".join(rng.choice(other) for _ in range(n))
    own, rows = decontam.Items(items), []
    for k, (_, text) in enumerate(items):
        answer = decontam._answer(text)
        head, size = text[: len(text.strip()) - len(answer)].split(), len(text.split())
        swap = min(len(head), int(size * (1 - rng.uniform(0.61, 0.65))))
        for at in rng.sample(range(len(head)), swap):
            head[at] = rng.choice(other)
        rows.append((k, f"{filler(40)} {' '.join(head)} . {answer} {filler(40)}"))
    want = set()
    for k, h in enumerate(decontam._digests([t for _, t in rows])):
        for name, w, answer in zip(own.ids, own.words, own.answers):
            share = common_words(w.tolist(), h.tolist()) / len(w)
            if share >= decontam.COPY or (share >= decontam.PARAPHRASE and np.isin(answer, h).mean() >= decontam.ANSWER):
                want.add((k, name))
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert len(want) >= 0.6 * len(items) and len(want & got) >= 0.9 * len(want) and not got - want, (len(want), len(want & got), len(got))


def test_latent_space_comes_from_all_rows(spark, monkeypatch):
    """Counts and singular vectors against the same steps on the whole matrix, which more documents make than a sample of 4,000 had."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=7))) for k in range(30)]
    rows = [(k, " ".join(rng.choices(words + ["out", "side"], weights=[1 + (j * 7 + k // 1000) % 13 for j in range(62)], k=rng.randrange(0, 40)))) for k in range(9_000)]
    own = decontam.Items(items)
    n, length = len(own.vocabulary), max(own.lengths, key=lambda k: len(own.lengths[k]))
    matrix, total = [], 0
    for h in decontam._digests([t for _, t in rows]):
        place, total = own.places(h), total + len(h)
        for k in range(0, len(place), length):
            some = place[k:k + length]
            matrix.append(np.bincount(some[some >= 0], minlength=n))
    matrix = np.array(matrix)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for cells in (decontam.CELLS, 20 * n):  # at once, and in rounds of rows
        monkeypatch.setattr(decontam, "CELLS", cells)
        monkeypatch.setattr(decontam, "SLICE", 7 * n)
        count, n_words, pairs = decontam.counted(decontam.placed(docs, own), own)
        assert n_words == total and count.tolist() == matrix.sum(0).tolist()
        weights = decontam.idf(count, n_words)
        space = decontam.latent_space(pairs, count, own, weights, rank=10)
        a = np.vstack([matrix, [np.bincount(f, minlength=n) for f in own.features]]) * weights
        basis = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((n, 10 + decontam.OVERSAMPLING)))[0]
        basis = np.linalg.qr(a.T @ (a @ basis))[0]
        best = (np.linalg.svd(a @ basis, compute_uv=False)[:10] ** 2).sum()
        assert space.shape == (n, 10) and abs(np.linalg.norm(a @ space) ** 2 / best - 1) < 1e-5


def test_regions_lose_none(spark):
    """The test on rare words passes over no region that holds enough of an item."""
    rng = np.random.default_rng(5)
    items = [(k, " ".join(f"w{int(w)}" for w in rng.zipf(1.3, 12 + k) % 300)) for k in range(40)]
    own = decontam.Items(items)
    n = len(own.vocabulary)
    texts = [" ".join(f"w{int(w)}" for w in rng.zipf(1.3, 150) % 400) + " " + items[k % 40][1] for k in range(200)]
    h = decontam._digests(texts)
    place, size = own.places(np.concatenate(h)), np.array([len(x) for x in h])
    count = np.bincount(place[place >= 0], minlength=n)
    search = decontam.Search(own, rng.standard_normal((n + 1, 4)).astype(np.float32), np.append(np.ones(n), 0), count)
    begin = np.cumsum(size) - size
    for length, *tile in search.tiles:
        want = set()
        for r, (b, m) in enumerate(zip(begin, size)):
            for first in range(0, max(1, -(-m // length) - decontam.REGION + 1) * length, length):
                there = place[b + first:b + min(m, first + decontam.REGION * length)]
                want |= {(r, first, int(i)) for i in tile[0] if np.isin(own.features[i], there).mean() >= decontam.PARAPHRASE}
        assert set(search.regions(length, *tile, place, size)) == want
