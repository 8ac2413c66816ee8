"""Word n-gram language model in a trie of Elias-Fano levels.

Training counts words (digest, count), numbers them in the order of their digests, and deals
n-grams to shards by ranges of the first word, so that every subtree lies in one shard. A
shard holds, for each level, the keys (place of the parent, last word) as one ascending
Elias-Fano sequence, the begin of each parent's successors as another, and 16-bit logarithms
of the discounted probability and of the weight left to the shorter context. Shards are
files in the shared work folder, mapped by the tasks that score.

Smoothing is interpolated absolute discounting with three discounts a level, estimated from
the counts of counts; single words are smoothed by adding one, an unseen word counts as one
more word. p(w | u, v) = a(u, v, w) + b(u, v) p(w | v), where b is 1 for an unseen context.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.elias_fano import Sequence, encode
from revlens.llm.shared import fresh, map_arrays, remove, source, sink, write_arrays
from revlens.llm.words import Hasher, groups, text_bytes
from revlens.session import scratch_path, written_table

ORDER = 3
#: Bytes of text handled by one array operation.
CHUNK = 1 << 22
#: Different words a counting task holds before it hands them on.
KEPT = 1 << 20
#: n-grams of a shard, before equal ones are merged.
SHARD = 1 << 19
#: Quantisation: steps of 1/STEP in the binary logarithm.
STEP = 1000.0
END = 0


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, digests of their tokens, tokens of each row), CHUNK bytes at once; a longer text is a group of its own."""
    hasher = Hasher()
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        for k, stop in groups(offsets, CHUNK):
            h, size = hasher(data, offsets[k:stop + 1])
            whole = np.full(len(h) + len(size), END, np.int64)
            whole[np.arange(len(h)) + np.repeat(np.arange(len(size)), size)] = h.view(np.int64)
            yield batch.slice(k, stop - k), whole, size + 1


def _codes(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log2(np.maximum(x, 1e-19)) * STEP), 65535).astype(np.uint16)


def _values(codes: np.ndarray) -> np.ndarray:
    return np.exp2(codes * (-1.0 / STEP))


def vocabulary(texts: DataFrame, folder: str) -> list[tuple]:
    """Write the words of texts (text), sorted by digest; one (first digest, words, tokens, path) for each file, in order."""

    def count(batches):
        held, size = [], 0

        def out():
            h, n = (np.concatenate(x) for x in zip(*held))
            key, group = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(group, n).astype(np.int64))], names=["h", "n"])

        for _, h, _ in _chunks(batches, "text"):
            held.append(np.unique(h, return_counts=True))
            size += len(held[-1][0])
            if size > KEPT:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def write(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if parts:
            h, n = (np.concatenate(x) for x in zip(*parts))
            path = fresh(folder, "words")
            write_arrays(path, {"h": h, "n": n})
            yield pa.RecordBatch.from_pydict({"first": [int(h[0])], "words": [len(h)], "tokens": [int(n.sum())], "path": [path]})

    counts = texts.select("text").mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    counts = written_table(counts, "words")
    files = counts.repartitionByRange("h").sortWithinPartitions("h").mapInArrow(write, "first bigint, words bigint, tokens bigint, path string")
    return [tuple(r) for r in written_table(files, "vocabulary").orderBy("first").collect()]


class Lexicon:
    """Numbers and counts of words, looked up in the mapped vocabulary; ``size`` and two more stand for an unseen word, a begin and a filler."""

    def __init__(self, files: list[tuple]):
        self.first = np.array([f[0] for f in files], np.int64)
        self.base = np.cumsum([0, *[f[1] for f in files]])
        self.size, self.tokens = int(self.base[-1]), sum(f[2] for f in files)
        self.paths, self.files = [f[3] for f in files], {}

    def read(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the words with these digests."""
        h, group = np.unique(h, return_inverse=True)
        file = np.searchsorted(self.first, h, "right") - 1
        ids, counts = np.full(len(h), self.size), np.zeros(len(h), np.int64)
        cut = np.flatnonzero(np.append(True, file[1:] != file[:-1])).tolist() if len(h) else []
        for s, e in zip(cut, [*cut[1:], len(h)]):
            f = int(file[s])
            if f < 0:
                continue
            if f not in self.files:
                self.files[f] = map_arrays(self.paths[f])
            words = self.files[f]["h"]
            place = np.minimum(np.searchsorted(words, h[s:e]), len(words) - 1)
            hit = np.flatnonzero(words[place] == h[s:e])
            ids[s + hit] = self.base[f] + place[hit]
            counts[s + hit] = self.files[f]["n"][place[hit]]
        return ids[group], counts[group]

    def boundaries(self, shards: int) -> np.ndarray:
        """First word of each shard, so that the tokens of the words in a shard are about as many; ascending, from 0."""
        cut, before = [0], 0
        for f, path in enumerate(self.paths):
            n = map_arrays(path)["n"]
            upto = before + np.cumsum(n)
            for k in range(len(cut), shards):
                goal = self.tokens * k / shards
                if goal > upto[-1]:
                    break
                cut.append(int(self.base[f] + np.searchsorted(upto, goal)))
            before = int(upto[-1])
        return np.unique(cut)


def _windows(ids: np.ndarray, size: np.ndarray, order: int, begin: int, filler: int) -> list[np.ndarray]:
    """The columns of all n-grams: a begin before each text, fillers after it, no window across two texts."""
    fill = order - 2
    wide = size + 1 + fill
    start = np.cumsum(wide) - wide
    seq = np.full(int(wide.sum()), filler, np.int64)
    seq[start] = begin
    seq[np.arange(len(ids)) + np.repeat(np.arange(len(size)) * (1 + fill) + 1, size)] = ids
    at = np.arange(len(ids)) + np.repeat(np.arange(len(size)) * (1 + fill), size)
    return [seq[at + k] for k in range(order)]


def _levels(cols: list[np.ndarray], weight: np.ndarray | None, filler: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Level by level: (keys (parent place, word) in order, counts); rows end at the filler."""
    parent, cols = cols[0], list(cols[1:])
    while cols:
        if filler is not None:
            real = cols[0] != filler
            parent, weight, cols = parent[real], weight[real], [c[real] for c in cols]
        key, parent = np.unique(parent.astype(np.uint64) << np.uint64(32) | cols.pop(0).astype(np.uint64), return_inverse=True)
        yield key, np.bincount(parent, weight, len(key)).astype(np.int64)


def _pack(cols: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([c.astype(np.uint32) for c in cols]).tobytes())


def _unpack(blob: bytes, order: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32).reshape(order + 1, -1).astype(np.int64)


def count_ngrams(texts: DataFrame, files: list[tuple], edges: np.ndarray, order: int) -> DataFrame:
    """(shard, n-grams with counts) of texts (text), merged within every chunk of a task before they move."""

    def run(batches):
        lexicon = Lexicon(files)
        for _, h, size in _chunks(batches, "text"):
            ids, _ = lexicon.read(h)
            cols = _windows(ids, size, order, lexicon.size + 1, lexicon.size + 2)
            levels = list(_levels(cols, None))
            key, n = levels[-1]
            out = []
            for above, _ in reversed([(None, None), *levels[:-1]]):
                out.append((key & np.uint64(0xFFFFFFFF)).astype(np.int64))
                key = key >> np.uint64(32)
                key = above[key.astype(np.int64)] if above is not None else key
            cols = [key.astype(np.int64), *reversed(out), n]
            cut = [*np.searchsorted(cols[0], edges).tolist(), len(n)]
            some = [k for k in range(len(edges)) if cut[k] < cut[k + 1]]
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array(some, pa.int32()), "grams": pa.array([_pack([c[cut[k]:cut[k + 1]] for c in cols]) for k in some], pa.binary())}
            )

    return texts.select("text").mapInArrow(run, "shard int, grams binary")


def build_shards(grams: DataFrame, edges: np.ndarray, words: int, order: int, folder: str) -> list[dict]:
    """Write the levels of every shard; what the rows say: shard, paths, counts of counts of each level."""
    filler, universe = words + 2, words + 3

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        cols, most = [], 1 << 21
        for blob in table.column("grams"):
            cols.append(_unpack(blob.as_py(), order))
            if sum(c.shape[1] for c in cols) > most:
                cols = [_merged(np.concatenate(cols, 1))]
                most = max(most, 2 * cols[0].shape[1])
        *cols, weight = np.concatenate(cols, 1)
        low = int(edges[shard])
        parents = (int(edges[shard + 1]) if shard + 1 < len(edges) else universe) - low
        cols[0] = cols[0] - low
        arrays, counts, seen = {}, {}, []
        for level, (key, n) in enumerate(_levels(cols, weight, filler), 2):
            parent, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            seen.append([int((n == k).sum()) for k in (1, 2, 3, 4)])
            begin = np.searchsorted(parent, np.arange(parents + 1))
            arrays |= {f"key{level}.{k}": v for k, v in encode(parent * universe + word, parents * universe, True).items()}
            arrays |= {f"begin{level}.{k}": v for k, v in encode(begin, len(key) + 1, False).items()}
            counts[f"n{level}"], counts[f"begin{level}"] = n, begin
            parents = len(key)
        levels, raw = fresh(folder, "levels"), fresh(folder, "counts")
        write_arrays(levels, arrays)
        with sink(raw) as out:
            out.write(zstandard.ZstdCompressor(level=3).compress(b"".join(counts[k].astype(np.int64).tobytes() for k in counts)))
        sizes = [len(counts[k]) for k in counts]
        return pa.table({"shard": pa.array([shard], pa.int32()), "levels": [levels], "raw": [raw], "sizes": pa.array([sizes], pa.list_(pa.int64())), "seen": pa.array([seen], pa.list_(pa.list_(pa.int64())))})

    schema = "shard int, levels string, raw string, sizes array<bigint>, seen array<array<bigint>>"
    return [r.asDict() for r in written_table(grams.groupBy("shard").applyInArrow(run, schema), "levels").orderBy("shard").collect()]


def _merged(cols: np.ndarray) -> np.ndarray:
    *keys, weight = cols
    order = np.lexsort(keys[::-1])
    keys, weight = [k[order] for k in keys], weight[order]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    at = np.flatnonzero(new)
    return np.stack([*[k[at] for k in keys], np.add.reduceat(weight, at)])


def discounts(seen: list[int]) -> list[float]:
    """What is taken off counts of one, two, and three or more, from how often one to four occur."""
    n1, n2, n3, n4 = (max(1, x) for x in seen)
    y = n1 / (n1 + 2 * n2)
    rough = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(rough)]


def smooth_shards(spark, shards: list[dict], order: int, folder: str) -> list[tuple]:
    """Quantised probabilities and weights of every shard; (shard, levels path, weights path)."""
    off = [discounts([sum(s["seen"][k][i] for s in shards) for i in range(4)]) for k in range(order - 1)]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with source(row["raw"]) as f:
                    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read()), np.int64)
                parts = np.split(flat, np.cumsum(row["sizes"])[:-1])
                arrays = {}
                for level, (n, begin) in enumerate(zip(parts[::2], parts[1::2]), 2):
                    d = off[level - 2]
                    each = np.array([0.0, *d])[np.minimum(n, 3)]
                    upto, taken = np.append(0, np.cumsum(n)), np.append(0.0, np.cumsum(each))
                    total, left = upto[begin[1:]] - upto[begin[:-1]], taken[begin[1:]] - taken[begin[:-1]]
                    context = np.repeat(np.arange(len(total)), np.diff(begin))
                    arrays[f"a{level}"] = _codes((n - each) / total[context])
                    arrays[f"b{level}"] = _codes(np.where(total > 0, left / np.maximum(total, 1), 1.0))
                path = fresh(folder, "weights")
                write_arrays(path, arrays)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]], pa.int32()), "levels": [row["levels"]], "weights": [path]})

    rows = spark.createDataFrame([(s["shard"], s["levels"], s["raw"], s["sizes"]) for s in shards], "shard int, levels string, raw string, sizes array<bigint>")
    done = written_table(rows.repartition(max(1, len(shards) // 4), "shard").mapInArrow(run, "shard int, levels string, weights string"), "weights")
    out = [tuple(r) for r in done.orderBy("shard").collect()]
    for s in shards:
        remove(s["raw"])
    return out


class Trie:
    """The mapped shards, asked for whole arrays of n-grams."""

    def __init__(self, edges: np.ndarray, shards: list[tuple], universe: int, order: int):
        self.edges, self.universe, self.order = edges, universe, order
        self.paths, self.open = {s: (levels, weights) for s, levels, weights in shards}, {}

    def shard(self, k: int) -> dict | None:
        if k not in self.open and k in self.paths:
            levels, arrays = (map_arrays(p) for p in self.paths[k])
            for name in ("key", "begin"):
                for level in range(2, self.order + 1):
                    arrays[f"{name}{level}"] = Sequence({x: levels[f"{name}{level}.{x}"] for x in ("low", "high", "table", "shape")})
            self.open[k] = arrays
        return self.open.get(k)

    def step(self, level: int, shard: np.ndarray, parent: np.ndarray, word: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the n-gram or -1, probability); shard ascends, parent is -1 for an unseen context."""
        place, p = np.full(len(word), -1, np.int64), shorter.copy()
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() if len(shard) else []
        for s, e in zip(cut, [*cut[1:], len(shard)]):
            arrays = self.shard(int(shard[s]))
            if arrays is None:
                continue
            at = s + np.flatnonzero(parent[s:e] >= 0)
            if not len(at):
                continue
            above, back = np.unique(parent[at], return_inverse=True)
            pointers = arrays[f"begin{level}"]
            begin, end = pointers.get(above).astype(np.int64)[back], pointers.get(above + 1).astype(np.int64)[back]
            found = arrays[f"key{level}"].find(parent[at] * self.universe + word[at], begin, end)
            place[at] = found
            p[at] = _values(arrays[f"b{level}"][parent[at]]) * shorter[at]
            hit = np.flatnonzero(found >= 0)
            p[at[hit]] += _values(arrays[f"a{level}"][found[hit]])
        return place, p

    def probabilities(self, ids: np.ndarray, size: np.ndarray, single: np.ndarray, begin: int) -> np.ndarray:
        """Probability of every token after the tokens before it in its text; single: without context."""
        start = np.cumsum(size) - size
        before = np.append(begin, ids[:-1])
        before[start] = begin
        key, first, group = np.unique(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64), return_index=True, return_inverse=True)
        word = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        parent = (key >> np.uint64(32)).astype(np.int64)
        shard = np.searchsorted(self.edges, parent, "right") - 1
        parent = np.where(parent == self.universe - 3, -1, parent - self.edges[shard])
        place, p = self.step(2, shard, parent, word, single[first])
        p = p[group]
        for level in range(3, self.order + 1):  # group: the shorter n-gram that ends at a token; the context is the one that ends before it
            inside = np.ones(len(ids), bool)
            inside[start] = False
            for back in range(1, level - 2):
                inside[start[size > back] + back] = False
            at = np.flatnonzero(inside)
            key, one, same = np.unique(group[at - 1].astype(np.uint64) << np.uint64(32) | ids[at].astype(np.uint64), return_index=True, return_inverse=True)
            above = (key >> np.uint64(32)).astype(np.int64)
            n_place, longer = self.step(level, shard[above], place[above], (key & np.uint64(0xFFFFFFFF)).astype(np.int64), p[at[one]])
            p[at] = longer[same]
            group = np.full(len(ids), len(key), np.int64)
            group[at] = same
            place, shard = np.append(n_place, -1), np.append(shard[above], shard[-1:] if len(shard) else 0)
        return p


class Model:
    """A trained model: addresses of its files and what is needed to read them."""

    def __init__(self, files: list[tuple], edges: np.ndarray, shards: list[tuple], order: int):
        self.files, self.edges, self.shards, self.order = files, edges, shards, order

    def score(self, docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """Columns ``keep`` of docs with n_tokens, n_known, train_tokens, base_score, score (base-10 logarithms)."""
        files, edges, shards, order = self.files, self.edges, self.shards, self.order
        rows = docs.select(*keep, F.col(text_col).alias("text"))

        def run(batches):
            lexicon = Lexicon(files)
            trie = Trie(edges, shards, lexicon.size + 3, order)
            total, words = lexicon.tokens, lexicon.size
            for batch, h, size in _chunks(batches, "text"):
                ids, count = lexicon.read(h)
                start = np.cumsum(size) - size
                base = np.log10(count + 1.0) - np.log10(float(total + words + 1))
                p = trie.probabilities(ids, size, (count + 1.0) / (total + words + 1.0), words + 1) if total else (count + 1.0) / (total + words + 1.0)
                sums = [np.add.reduceat(x, start) for x in (base, np.log10(p))]
                known = np.add.reduceat((count > 0).astype(np.int64), start)
                cols = [pa.array(size), pa.array(known), pa.array(np.full(len(size), total)), *map(pa.array, sums)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(keep))], *cols], names=out.names)

        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
        schema = ", ".join([*kinds, "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"])
        out = pa.schema([(c, pa.null()) for c in [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"]])
        return rows.mapInArrow(run, schema)


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER, shard_size: int = SHARD) -> Model:
    """Learn from every text of the table; null and blank texts have the end token alone, no rows give an empty model."""
    spark = texts.sparkSession
    folder = scratch_path(spark, "lm")
    rows = texts.select(F.col(text_col).alias("text"))
    files = vocabulary(rows, folder)
    if not files:
        return Model([], np.array([0]), [], order)
    lexicon = Lexicon(files)
    edges = lexicon.boundaries(max(1, -(-lexicon.tokens // shard_size)))
    shards = build_shards(count_ngrams(rows, files, edges, order), edges, lexicon.size, order, folder)
    return Model(files, edges, smooth_shards(spark, shards, order, folder), order)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32 of the id as text leaves ``held`` modulo ``parts`` are held out of training
    (a null id counts as empty text). Repeated rows count each and come out each.
    """
    bucket = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts
    model = train(docs.filter(bucket != held), text_col, order)
    marked = docs.select(F.col(id_col).alias("doc_id"), (bucket == held).alias("held_out"), F.col(text_col).alias("text"))
    return model.score(marked, ["doc_id", "held_out"])
