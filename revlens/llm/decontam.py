"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are a stated query set; their words are the features. Passages of documents
become TF-IDF vectors over these words, a randomised SVD over all of them (pairs of words in a
passage are counted and its products summed over partitions by Spark) gives the latent space, and every passage of every document is compared
with the items by the cosine there, once it is known to lie in a region that holds enough of an
item's words to be a leak. Passages come in the lengths of the items, with a step of a quarter;
one with little IDF mass for the item is passed over. Both gates lie well below the confirm
bound, as a paraphrase may keep only the common words of an item; they can still lose a few.
The rest is confirmed by the longest common subsequence of words, and paraphrases by the
item's answer, its last sentence, too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from revlens.llm.shared import free, fresh, map_arrays, write_arrays
from revlens.llm.words import Hasher, groups, text_bytes
from revlens.session import scratch_path, written_table

RANK = 128
OVERSAMPLING = 32
#: Cells of the matrix of pairs that a task counts at once, and those of one row of its table.
CELLS, SLICE = 1 << 24, 1 << 16
COSINE = 0.4
MASS = 0.25
#: Share of an item's words in common order that is a copy, and that is a paraphrase if the answer is there.
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
CHUNK = 1 << 22
#: Regions in one matrix product, items in one, and lengths of an item in a region.
BLOCK, TILE, REGION = 2048, 256, 4
#: Share of an item's words that a region must hold among the item's rarest.
RARE = 0.1
GROWTH = 1.25


def _digests(texts: list[str | None]) -> list[np.ndarray]:
    data, at = text_bytes(pa.array(texts, pa.string()))
    h, size = Hasher(plain=False)(data, at)
    return np.split(h, np.cumsum(size)[:-1]) if texts else []


def _answer(text: str) -> str:
    """The last sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if re.search(r"\w", p)]
    return parts[-1] if parts else ""


class Items:
    """The benchmark as word digests, with its vocabulary; items without words can match nothing and are left out."""

    def __init__(self, rows: list[tuple]):
        words, answers = _digests([r[1] for r in rows]), _digests([_answer(r[1] or "") for r in rows])
        some = [k for k, w in enumerate(words) if len(w)]
        self.ids, self.words, self.answers = [rows[k][0] for k in some], [words[k] for k in some], [answers[k] for k in some]
        self.vocabulary = np.unique(np.concatenate(self.words + self.answers)) if some else np.empty(0, np.uint64)
        self.features = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.ends = [np.searchsorted(self.vocabulary, w) for w in self.answers]
        self.lengths: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            self.lengths.setdefault(max(1, round(GROWTH ** round(np.log(len(w)) / np.log(GROWTH)))), []).append(k)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Feature of each word, -1 for a word of no item."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)


def _kind(n: int) -> np.dtype:
    """Type of a feature in a table of places."""
    return np.dtype(np.int16 if n < 1 << 15 else np.int32)


def placed(texts: DataFrame, items: Items) -> DataFrame:
    """(doc_id, places): the feature of each word of a text in order, -1 for a word of no item; written once, read by all that follows."""
    kind = _kind(len(items.vocabulary))
    key = to_arrow_type(texts.schema["doc_id"].dataType)

    def run(batches):
        hasher = Hasher(plain=False)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for k, stop in groups(offsets, CHUNK):
                h, size = hasher(data, offsets[k:stop + 1])
                place = items.places(h).astype(kind)
                at = np.append(0, np.cumsum(size)).astype(np.int32) * kind.itemsize
                held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(place)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, stop - k).cast(key), held], names=["doc_id", "places"])

    return written_table(texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, places binary"), "places")


def _places(batches, kind: np.dtype):
    """(rows, features, words of each row), a quarter of CHUNK words at once."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("places"))
        for k, stop in groups(offsets, CHUNK // 4 * kind.itemsize):
            at = offsets[k:stop + 1]
            yield batch.slice(k, stop - k), np.frombuffer(data[at[0]:at[-1]].tobytes(), kind), np.diff(at) // kind.itemsize


def _pairs(place: np.ndarray, size: np.ndarray, length: int):
    """Pairs of features that stand in this order in one passage of so many words, for one distance after the other."""
    begin = np.cumsum(size) - size
    count = -(-size // length)
    row = np.repeat(np.arange(len(size)), size)
    passage = (np.cumsum(count) - count)[row] + (np.arange(len(place)) - begin[row]) // length
    known = place >= 0
    f, passage = place[known].astype(np.int64), passage[known]
    for d in range(1, length):
        same = np.flatnonzero(passage[d:] == passage[:-d])
        if not len(same):
            return
        yield f[same], f[same + d]


def _narrow(values: np.ndarray) -> bytes:
    top = int(values.max(initial=0))
    return values.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _wide(part: bytes, cells: int) -> np.ndarray:
    return np.frombuffer(part, f"u{len(part) // cells}").astype(np.int64)


def counted(table: DataFrame, items: Items) -> tuple[np.ndarray, int, DataFrame]:
    """Occurrences of every feature, words in all, and (first, part): how often one feature stands before another in a passage.

    All passages of all texts count. The passage has the commonest length of an item. A part holds some rows
    of the matrix of features x features, whose size is set by the benchmark; one that passes CELLS is counted
    in rounds of rows, so a task holds no more. There are as many partial sums as cores, however large the table.
    """
    spark = table.sparkSession
    n, kind = len(items.vocabulary), _kind(len(items.vocabulary))
    length = max(items.lengths, key=lambda k: len(items.lengths[k]))
    step = max(1, SLICE // n)
    rows = max(step, CELLS // n // step * step)
    few = table.coalesce(spark.sparkContext.defaultParallelism)
    schema = "first int, part binary"

    def add(parts: pa.Table) -> pa.Table:
        first = parts.column("first")[0].as_py()
        cells = n + 1 if first < 0 else (min(first + step, n) - first) * n
        total = np.zeros(cells, np.int64)
        for p in parts.column("part"):
            total += _wide(p.as_py(), cells)
        return pa.table({"first": pa.array([first], pa.int32()), "part": pa.array([_narrow(total)], pa.binary())})

    found = None
    for low in range(0, n, rows):
        high = min(low + rows, n)

        def run(batches, low=low, high=high):
            total, one = np.zeros((high - low) * n, np.int64), np.zeros(n + 1, np.int64)
            for _, place, size in _places(batches, kind):
                one += np.append(np.bincount(place[place >= 0], minlength=n), len(place))
                for a, b in _pairs(place, size, length):
                    if high - low < n:
                        here = (a >= low) & (a < high)
                        a, b = a[here], b[here]
                    np.add.at(total, (a - low) * n + b, 1)
            if low == 0:
                yield pa.RecordBatch.from_pydict({"first": pa.array([-1], pa.int32()), "part": pa.array([_narrow(one)], pa.binary())})
            for k in range(low, high, step):
                part = total[(k - low) * n:(min(k + step, high) - low) * n]
                yield pa.RecordBatch.from_pydict({"first": pa.array([k], pa.int32()), "part": pa.array([_narrow(part)], pa.binary())})

        sums = few.mapInArrow(run, schema).groupBy("first").applyInArrow(add, schema)
        found = sums if found is None else found.unionByName(sums)
    found = written_table(found, "pairs")
    one = np.zeros(n + 1, np.int64)
    for r in found.filter("first < 0").collect():
        one += _wide(r["part"], n + 1)
    return one[:-1], int(one[-1]), found.filter("first >= 0")


def idf(count: np.ndarray, words: int) -> np.ndarray:
    """Inverse frequency of every feature, from its occurrences in all texts."""
    return np.log((words + len(count) + 1) / (count + 1)).astype(np.float32)


def _summed(rows: DataFrame, product, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows (first, part) of product(first, part), a matrix of fixed shape, added in slices of rows."""
    step = 256

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            for first, part in zip(batch.column("first").to_pylist(), batch.column("part").to_pylist()):
                product(first, part, total)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(0, shape[0], step), pa.int32()), "part": [total[s:s + step].tobytes() for s in range(0, shape[0], step)]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py()) for p in table.column("part"))
        return pa.table({"slice": table.column("slice")[:1], "part": [total.tobytes()]})

    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    parts = rows.mapInArrow(run, "slice int, part binary").groupBy("slice").applyInArrow(add, "slice int, part binary").collect()
    out = np.zeros(shape)
    for r in parts:
        out[r["slice"]:r["slice"] + step] = np.frombuffer(r["part"]).reshape(-1, shape[1])
    return out


def latent_space(pairs: DataFrame, count: np.ndarray, items: Items, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Features x rank: the leading right singular vectors of all passages of all texts and of all items.

    Randomised SVD with one power step. A passage's counts times the weights are a row of A; A' A is
    the matrix of pairs, its transpose and the occurrences on the diagonal, each weighted on both
    sides, so its products need the sums of ``counted`` only. Matrices of features x
    (rank + OVERSAMPLING) reach the driver.
    """
    n = len(weights)
    width, step = min(n, rank + OVERSAMPLING), max(1, SLICE // n)
    own = [np.unique(f, return_counts=True) for f in items.features]
    own = [(f, c * weights[f]) for f, c in own]

    def twice(basis):
        """A' A basis."""
        scaled = weights[:, None] * basis

        def product(first, part, out):
            stop = min(first + step, n)
            some = _wide(part, (stop - first) * n).reshape(-1, n).astype(np.float64)
            out[first:stop] += some @ scaled
            out += some.T @ scaled[first:stop]

        out = weights[:, None] * (_summed(pairs, product, basis.shape) + count[:, None] * scaled)
        for f, v in own:
            out[f] += v[:, None] * (v @ basis[f])
        return out

    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((n, width)))[0]
    basis = np.linalg.qr(twice(basis))[0]
    image = twice(basis)
    inner = basis.T @ image
    _, vectors = np.linalg.eigh((inner + inner.T) / 2)
    return (basis @ vectors[:, ::-1][:, :rank]).astype(np.float32)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, common, answered, leaked): candidate pairs of a document and an item.

    cosine is the highest of the document's passages, common the share of the item's words found
    in the same order in one of them, answered whether ANSWER of the last sentence's words are in
    it. leaked: common is COPY or more, or PARAPHRASE or more and answered. Null and empty texts
    and items match nothing; repeated rows each come out; items with equal text all match.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    kinds = dict(texts.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, common double, answered boolean, leaked boolean"
    items = Items([tuple(r) for r in benchmark.select("item_id", "text").collect()])  # the stated query set
    if not items.ids:
        return spark.createDataFrame([], schema)
    table = placed(texts, items)
    count, words, pairs = counted(table, items)
    weights = idf(count, words)
    space = latent_space(pairs, count, items, weights)
    vectors = np.vstack([space * weights[:, None], np.zeros((1, space.shape[1]), np.float32)])
    path = fresh(scratch_path(spark, "space"), "space")
    write_arrays(path, {"vectors": vectors.ravel(), "mass": np.append(weights.astype(np.float64) ** 2, 0), "count": count})
    ids = pa.array(items.ids, to_arrow_type(benchmark.schema["item_id"].dataType))

    def run(batches):
        arrays = map_arrays(path)
        search = Search(items, arrays["vectors"].reshape(len(weights) + 1, -1), arrays["mass"], arrays["count"])
        for batch, place, size in _places(batches, _kind(len(weights))):
            found = search(place, size)
            keys = sorted(found)
            values = [found[k] for k in keys]
            cols = [pa.array([v[c] for v in values], t) for c, t in enumerate((pa.float64(), pa.float64(), pa.bool_(), pa.bool_()))]
            rows = batch.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64()))
            names = ids.take(pa.array([k[1] for k in keys], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, names, *cols], names=["doc_id", "item_id", "cosine", "common", "answered", "leaked"])

    return table.mapInArrow(run, schema)


class Search:
    """Candidates in a block of texts, cheapest test first; none of them loses what the next would keep, but for the two gates.

    Texts are cut into regions of REGION lengths of an item, a length apart. Of an item's words a region must
    hold PARAPHRASE, so some of the item's rarest ones: regions without them are passed over. One matrix
    product gives how many of an item's words each other region holds, which bounds what is common. In the
    regions left, the windows of the item's length pass by their mass and their cosine with the item; the
    words around those that pass are compared once by the common subsequence.
    """

    def __init__(self, items: Items, vectors: np.ndarray, mass: np.ndarray, count: np.ndarray):
        self.items, self.vectors, self.mass = items, vectors, mass
        self.goal = np.stack([vectors[f].sum(0) for f in items.features])
        self.goal /= np.maximum(np.linalg.norm(self.goal, axis=1, keepdims=True), 1e-9)
        self.least = np.array([MASS * mass[f].sum() for f in items.features])
        self.tiles = []
        for length, some in items.lengths.items():
            for k in range(0, len(some), TILE):
                part = np.array(some[k:k + TILE])
                own = np.unique(np.concatenate([items.features[i] for i in part]))
                at = np.full(len(mass), -1, np.int32)
                at[own] = np.arange(len(own))
                share = np.zeros((len(own), len(part)), np.float32)
                for c, i in enumerate(part):
                    np.add.at(share[:, c], at[items.features[i]], np.float32(1 / len(items.features[i])))
                self.tiles.append((length, part, at, share, *self.rarest(part, count)))

    def rarest(self, part: np.ndarray, count: np.ndarray):
        """(where a feature's entries begin, their items, their numbers of words, words that a region needs) over the rarest words of the items."""
        entries, need = [], np.zeros(len(part), np.int64)
        for c, i in enumerate(part):
            f, n = np.unique(self.items.features[i], return_counts=True)
            order = np.lexsort((f, count[f]))
            f, n = f[order], n[order]
            size = int(n.sum())
            spare = size - int(np.ceil((PARAPHRASE - 1e-3) * size))  # so many words may be missing
            stop = int(np.searchsorted(np.cumsum(n), min(size, spare + 1 + int(RARE * size)))) + 1
            need[c] = int(n[:stop].sum()) - spare
            entries += [(a, c, b) for a, b in zip(f[:stop].tolist(), n[:stop].tolist())]
        feature, item, words = np.array(sorted(entries), np.int64).reshape(-1, 3).T
        return np.searchsorted(feature, np.arange(len(self.mass) + 1)), item, words, need

    def regions(self, length, part, at, share, entry, item, words, need, place: np.ndarray, size: np.ndarray):
        """(row, first word in the row, item) of the regions that hold enough of the item's words."""
        count = np.maximum(1, -(-size // length) - REGION + 1) * (size > 0)
        begin, base = np.cumsum(size) - size, np.cumsum(count) - count
        hit = np.flatnonzero(np.diff(entry)[place] > 0)  # the last feature, that of other words, has no entries
        if not len(hit):
            return
        times = np.diff(entry)[place[hit]]
        row = np.searchsorted(begin, hit, "right") - 1
        segment = (hit - begin[row]) // length
        low, high = np.maximum(0, segment - REGION + 1), np.minimum(segment, count[row] - 1)
        take = np.repeat(np.arange(len(hit)), times)
        where = entry[place[hit]][take] + np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)
        key, n = [], []
        for d in range(REGION):
            inside = np.flatnonzero((low + d <= high)[take])
            key.append((base[row] + low + d)[take[inside]] * len(part) + item[where[inside]])
            n.append(words[where[inside]])
        key, n = np.concatenate(key), np.concatenate(n)
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, n = key[start], np.add.reduceat(n[order], start)
        region = np.unique(key[n >= need[key % len(part)]] // len(part))
        row = np.searchsorted(np.cumsum(count), region, "right")
        first = (region - base[row]) * length
        begin, stop = begin[row] + first, np.minimum(begin[row] + first + REGION * length, (begin + size)[row])
        own = np.append(at[place], -1)
        for s in range(0, len(row), BLOCK):
            there = np.zeros((min(BLOCK, len(row) - s), len(share) + 1), np.float32)
            n = stop[s:s + BLOCK] - begin[s:s + BLOCK]
            region = np.repeat(np.arange(len(n)), n)
            there[region, own[np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[s:s + BLOCK], n)]] = 1
            for i, j in zip(*np.nonzero(there[:, :-1] @ share >= PARAPHRASE - 1e-4)):
                yield int(row[s + i]), int(first[s + i]), int(part[j])

    def __call__(self, place: np.ndarray, size: np.ndarray) -> dict[tuple[int, int], tuple]:
        """{(row, item): (cosine, common, answered, leaked)}"""
        found: dict[tuple[int, int], tuple] = {}
        begin = np.cumsum(size) - size
        for length, *tile in self.tiles:
            step, last = max(1, length // 4), None
            for r, first, item in self.regions(length, *tile, place, size):
                if (r, first) != last:
                    last, until = (r, first), min(int(size[r]), first + REGION * length)
                    words = place[begin[r] + first:begin[r] + min(int(size[r]), until + length)]
                    mass, upto = np.append(0.0, np.cumsum(self.mass[words])), None
                start = np.arange(-(-first // step) * step, until, step) - first
                stop = np.minimum(start + length, len(words))
                full = mass[stop] - mass[start] >= self.least[item]
                start, stop = start[full], stop[full]
                if not len(start):
                    continue
                if upto is None:
                    upto = np.vstack([np.zeros((1, self.vectors.shape[1])), np.cumsum(self.vectors[words], axis=0, dtype=np.float64)])
                v = upto[stop] - upto[start]
                cosine = v @ self.goal[item] / np.maximum(np.linalg.norm(v, axis=1), 1e-9)
                good = np.flatnonzero(cosine >= COSINE)
                if not len(good):
                    continue
                margin, top = len(self.items.words[item]), float(cosine[good].max())
                now = self.confirm(words[max(0, start[good[0]] - margin):min(until - first, stop[good[-1]] + margin)], item)
                seen = found.get((r, item))
                if now and (seen is None or (now[2], now[0]) > (seen[3], seen[1])):
                    found[r, item] = (max(top, seen[0] if seen else 0.0), *now)
                elif seen:
                    found[r, item] = (max(top, seen[0]), *seen[1:])
        return found

    def confirm(self, near: np.ndarray, item: int) -> tuple[float, bool, bool] | None:
        words, answer = self.items.features[item], self.items.ends[item]
        if np.isin(words, near).mean() < PARAPHRASE:
            return None
        share = common(words.tolist(), near[np.isin(near, words)].tolist()) / len(words)
        answered = len(answer) > 0 and float(np.isin(answer, near).mean()) >= ANSWER
        return share, answered, share >= COPY or (share >= PARAPHRASE and answered)


def common(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence; bit k of the state stays set while the length does not grow at word k of the item."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    whole = (1 << len(item)) - 1
    state = whole
    for w in text:
        met = state & places[w]
        state = (state + met | state - met) & whole
    return len(item) - state.bit_count()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, common, answered) of the pairs that are leaks."""
    return matches(docs, benchmark, id_col, text_col).filter("leaked").drop("leaked")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no leak, with their own columns; equal (id, text) share one verdict."""
    one, two, digest = free(docs, "_id", "_leaked", "_digest")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    bad = leaks(docs.select(key.alias("id"), F.col(text_col).alias("text")), benchmark, "id", "text")
    bad = written_table(bad.select(F.col("doc_id.id").alias(one), F.col("doc_id.digest").alias(two)).distinct(), "leaks")
    marked = docs.withColumn(digest, F.xxhash64(text_col))
    same = marked[id_col].eqNullSafe(bad[one]) & (marked[digest] == bad[two])
    return marked.join(bad, same, "left_anti").select(*docs.columns)
