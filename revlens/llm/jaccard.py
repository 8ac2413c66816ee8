"""N-gram Jaccard join by R-trees over count vectors.

A text is the set of its word shingles. Shingles are hashed into GROUPS groups; the counts by
group are a point, and the sum of the coordinates' minima of two points bounds the overlap of
their sets. The points are entered in slabs of the space of single shingles: in a fixed order of
the shingles, frequent ones last, two linked sets share one of the first of each, as those
before the first shared one are lost to the overlap. A slab is joined with itself by an R-tree
that is packed by size: pairs of boxes, then of points, whose summed minima stay below the
overlap that their sizes ask for are left out. Pairs that survive are verified on the sets.

Equal sets are one point. Small slabs are joined at once. In large ones, as near copies make them,
not all pairs are made: a first round verifies neighbours only and joins what is linked; the
second, which is complete, skips pairs that are joined already. Candidates are bounded again by
points of more groups before the sets themselves are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.components import connected
from revlens.llm.simhash import _starts, _whole_groups
from revlens.llm.shared import fresh, map_arrays, write_arrays
from revlens.llm.words import Hasher, groups, mix, text_bytes
from revlens.session import scratch_path, written_table

SHINGLE = 4
#: Linked if PERCENT of the union or more is shared.
PERCENT = 85
GROUPS = 16
#: Groups of the finer points that candidates are bounded by before their sets are fetched.
FINE = 512
#: Children of a box.
FAN = 16
#: Buckets of the frequency table that gives shingles their order.
BUCKETS = 1 << 16
CHUNK = 1 << 22
#: Pairs of boxes or points looked at in one array operation.
PAIRS = 1 << 20
#: Points of a slab up to which all its pairs are made at once, and beyond which it is dealt out to several tasks.
SMALL, SLAB = 32, 1 << 14
#: Points in the middle of a slab that the first round pairs with the others.
CENTRES = 2
_ENTRY = ("slab", "half", "size", "low", "high")
#: Odd, and another one for each word of a shingle.
_STEP = 0x9E3779B97F4A7C15


def shingle_sets(words: np.ndarray, size: np.ndarray, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit digests of the shingles of every text; words: digests of its words, size: how many."""
    end = np.cumsum(size).tolist()
    factors = [np.uint64(_STEP * (2 * k + 1) % (1 << 64)) for k in range(shingle)]
    for e, n in zip(end, size.tolist()):
        own, k = words[e - n:e], min(n, shingle)
        if not n:
            yield np.empty(0, np.uint64)
            continue
        total = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            total = (total ^ total >> np.uint64(29)) * factors[j] + own[j:n - k + 1 + j]
        yield np.unique(mix(total))


def needed(a, b):
    """The least overlap that sets of these sizes must have to be linked."""
    return -(-(a + b) * PERCENT // (100 + PERCENT))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets that are not empty are linked."""
    if len(a) > len(b):
        a, b = b, a
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[place] == a).sum()) >= needed(len(a), len(b))


def _shingled(batches, shingle: int):
    """(rows, set of each row), CHUNK bytes of text at once."""
    hasher = Hasher()
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for k, stop in groups(offsets, CHUNK):
            yield batch.slice(k, stop - k), shingle_sets(*hasher(data, offsets[k:stop + 1]), shingle)


def _halves(nodes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(nodes), ">i8")[::2].astype(np.int64)


def sets_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print, node, half, size): digest of the text; digest of its set, the first half of that, the size of the set."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _shingled(batches, shingle):
            node, size = [], []
            for own in sets:
                node.append(xxhash.xxh3_128_digest(own.tobytes()))
                size.append(len(own))
            cols = [batch.column("doc_id"), batch.column("print"), pa.array(node, pa.binary()), pa.array(_halves(node)), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "print", "node", "half", "size"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, print bigint, node binary, half bigint, size bigint")


def bucket_order(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Rank of every bucket of shingles by how many texts hold one of it; BUCKETS numbers at any size of input."""
    def run(batches):
        count = np.zeros(BUCKETS, np.int64)
        for _, sets in _shingled(batches, shingle):
            parts = list(sets)
            count += np.bincount((np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(BUCKETS)), "n": pa.array(count)})

    rows = texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(BUCKETS, np.int64)
    for r in rows:
        count[r["bucket"]] = r["n"]
    rank = np.empty(BUCKETS, np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(BUCKETS)
    return rank


def point(own: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Counts by group, for so many groups (a power of two), rounded up to whole steps of 2^shift so that each fits a byte, and the shift."""
    count = np.bincount((own >> np.uint64(65 - size.bit_length())).astype(np.int64), minlength=size)
    shift = max(0, int(count.max()).bit_length() - 8)
    count = (count + (1 << shift) - 1) >> shift
    if count.max() > 255:
        shift, count = shift + 1, (count + 1) >> 1
    return count.astype(np.uint8), shift


def entries(texts: DataFrame, rank: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """(slab, half, size, low, high): each set in the slabs of its first shingles, with its point in two numbers.

    Of n shingles the last needed ones for an overlap of PERCENT of n cannot all be lost, so
    the first n - ceil(PERCENT * n / 100) + 1 hold the first shared one. size carries the
    shift of the counts in its low byte. A task enters equal sets once.
    """
    def run(batches):
        seen = set()
        for _, sets in _shingled(batches, shingle):
            slab, n, row = [], [], []
            for own in sets:
                node = xxhash.xxh3_128_digest(own.tobytes())
                if node in seen or not len(own):
                    continue
                seen.add(node)
                first = len(own) - -(-PERCENT * len(own) // 100) + 1
                order = rank[(own & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | own >> np.uint64(16)
                slab.append(own[np.argpartition(order, first - 1)[:first]] if first < len(own) else own)
                n.append(len(slab[-1]))
                count, shift = point(own, GROUPS)
                row.append((int(_halves([node])[0]), len(own) << 8 | shift, *count.view(np.int64).tolist()))
            if not row:
                continue
            n, row = np.array(n), np.array(row, np.int64)
            cols = [np.concatenate(slab).view(np.int64), *[np.repeat(row[:, c], n) for c in range(4)]]
            for s in range(0, len(cols[0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[s:s + (1 << 18)]) for c in cols], names=list(_ENTRY))

    return texts.mapInArrow(run, "slab bigint, half bigint, size bigint, low bigint, high bigint")


class Points:
    """Points sorted by slab; size and counts of each, counts as rows of GROUPS numbers."""

    def __init__(self, size: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.size = size >> 8
        self.count = np.stack([low, high], 1).view(np.uint8).astype(np.int32) << (size & 255).astype(np.int32)[:, None]

    def reach(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the summed minima of the points reach the overlap that they need."""
        return np.minimum(self.count[i], self.count[j]).sum(1) >= needed(self.size[i], self.size[j])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... n[k] numbers for each k."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def tree_join(start: np.ndarray, points: Points, label: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of points of one slab with different labels whose bound reaches the overlap they need.

    start: first point of each slab, and the end. The trees of all slabs are packed together, FAN
    children to a box; a box has the largest counts, the least size and the label if it has one only.
    side, where given, is 0 or 1: only pairs of a 0 and a 1 count.
    """
    n = len(points.size)
    levels = [(start, points.count, points.size, label, None)]
    while (np.diff(levels[-1][0]) > 1).any():
        begin, high, size, own, _ = levels[-1]
        width = np.diff(begin)
        boxes = -(-width // FAN)
        cut = np.repeat(begin[:-1], boxes) + FAN * _ranges(np.zeros(len(boxes), np.int64), boxes)
        same = np.minimum.reduceat(own, cut) == np.maximum.reduceat(own, cut)
        levels.append((np.append(0, np.cumsum(boxes)), np.maximum.reduceat(high, cut), np.minimum.reduceat(size, cut), np.where(same & (own[cut] >= 0), own[cut], -1 - np.arange(len(cut))), np.append(cut, len(size))))
    i = j = np.arange(len(start) - 1)
    stack = [(len(levels) - 1, i, j)]
    while stack:
        depth, i, j = stack.pop()
        if len(i) > PAIRS:
            half = len(i) // 2
            stack += [(depth, i[:half], j[:half]), (depth, i[half:], j[half:])]
            continue
        _, high, size, own, _ = levels[depth]
        good = (own[i] != own[j]) | ((i == j) & (own[i] < 0))
        i, j = i[good], j[good]
        good = np.minimum(high[i], high[j]).sum(1) >= needed(size[i], size[j])
        i, j = i[good], j[good]
        if depth == 0:
            if side is not None:
                good = side[i] != side[j]
                i, j = i[good], j[good]
            if len(i):
                yield i, j
            continue
        cut = levels[depth][4]
        wide = np.diff(cut)
        for s in range(0, len(i), PAIRS // (FAN * FAN)):
            x, y = i[s:s + PAIRS // (FAN * FAN)], j[s:s + PAIRS // (FAN * FAN)]
            left = _ranges(cut[x], wide[x])
            other = np.repeat(y, wide[x])
            right = _ranges(cut[other], wide[other])
            left = np.repeat(left, wide[other])
            keep = left <= right if depth > 1 else left < right
            stack.append((depth - 1, left[keep], right[keep]))


def crowded(dealt: DataFrame, small: int = SMALL) -> DataFrame:
    """Pairs (a, b) without slab, and the entries of large slabs, for entries sorted by slab.

    Slabs of up to ``small`` points give all pairs that their bound lets through. Of larger ones
    the entries come back for the second round, with the pairs of neighbours and, for the rows in one
    batch, of those in the middle with the others. Only a batch is held, and a small slab or the
    last row of a large one from before.
    """
    def run(batches):
        held, large = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in _ENTRY]
            if held is not None:
                cols = [np.append(x, c) for x, c in zip(held, cols)]
            slab, half = cols[:2]
            new = np.append(True, (slab[1:] != slab[:-1]) | (half[1:] != half[:-1]))
            cols = [c[new] for c in cols]
            start = _starts([cols[0]])
            big = np.diff(start) > small
            big[0] |= large
            tail = int(start[-2])
            at = np.repeat(big, np.diff(start))
            if large:
                at[0] = False  # came back with the batch before
            yield rows([c[at] for c in cols])
            at[0] |= large
            yield from near(cols, at)
            if big[-1]:
                yield from complete([c[:tail] for c in cols], ~at[:tail])
                held, large = [c[-1:] for c in cols], True
            else:
                yield from complete([c[:tail] for c in cols], ~at[:tail])
                held, large = [c[tail:] for c in cols], False
        if held is not None and not large:
            yield from complete(held, np.ones(len(held[0]), bool))

    def complete(cols, at):
        slab, half, size, low, high = (c[at] for c in cols)
        if len(slab):
            for i, j in tree_join(_starts([slab]), Points(size, low, high), np.arange(len(slab))):
                yield rows(None, half[i], half[j])

    def near(cols, at):
        slab, half, size, low, high = (c[at] for c in cols)
        if len(slab):
            left = np.flatnonzero(slab[1:] == slab[:-1])
            right = left + 1
            points, start = Points(size, low, high), _starts([slab])
            n = np.diff(start)
            run_of = np.repeat(np.arange(len(n)), n)
            mean = np.add.reduceat(points.count, start[:-1]) / n[:, None]
            order = np.lexsort((np.abs(points.count - mean[run_of]).sum(1), run_of))
            for k in range(CENTRES):
                large = np.flatnonzero(n > k + 2)
                left = np.append(left, np.repeat(order[start[large] + k], n[large]))
                right = np.append(right, _ranges(start[large], n[large]))
            good = (half[left] != half[right]) & points.reach(left, right)
            yield rows(None, half[left[good]], half[right[good]])

    def rows(entry, a=None, b=None):
        n, none = len(a if entry is None else entry[0]), pa.int64()
        cols = [pa.nulls(n, none)] * 5 if entry is None else [pa.array(c) for c in entry]
        cols += [pa.nulls(n, none)] * 2 if a is None else [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
        return pa.RecordBatch.from_arrays(cols, names=[*_ENTRY, "a", "b"])

    return dealt.mapInArrow(run, "slab bigint, half bigint, size bigint, low bigint, high bigint, a bigint, b bigint")


class FinePoints:
    """The finer points of sets, by half, in sorted files of the shared folder."""

    def __init__(self, some: DataFrame):
        folder = scratch_path(some.sparkSession, "fine")

        def run(batches):
            parts = [b for b in batches if b.num_rows]
            if parts:
                half = np.concatenate([b.column("half").to_numpy() for b in parts])
                fine = b"".join(x.as_py() for b in parts for x in b.column("fine"))
                path = fresh(folder, "fine")
                write_arrays(path, {"half": half, "fine": np.frombuffer(fine, np.uint8)})
                yield pa.RecordBatch.from_pydict({"first": pa.array([int(half[0])], pa.int64()), "path": [path]})

        files = some.select("half", "fine").repartitionByRange("half").sortWithinPartitions("half").mapInArrow(run, "first bigint, path string")
        self.files = [tuple(r) for r in written_table(files, "fine-files").orderBy("first").collect()]

    def of(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes with shifts, counts) of sorted halves."""
        cuts = [*np.searchsorted(halves, [f for f, _ in self.files]), len(halves)]
        found = np.empty((len(halves), FINE + 8), np.uint8)
        for (_, path), s, e in zip(self.files, cuts, cuts[1:]):
            if e > s:
                part = map_arrays(path)
                found[s:e] = part["fine"].reshape(-1, FINE + 8)[np.searchsorted(part["half"], halves[s:e])]
        return found[:, :8].copy().view(np.int64).ravel(), found[:, 8:]


def second_pairs(dealt: DataFrame, fine: FinePoints) -> DataFrame:
    """All pairs (a, b) of rows (slab, i, j, half, size, low, high, label) with different labels that both bounds let through."""
    def reach_of(half):
        names, place = np.unique(half, return_inverse=True)
        size, count = fine.of(names)
        shift, size = (size & 255).astype(np.int64), size >> 8

        def reach(i, j):
            good = []
            for s in range(0, len(i), 1 << 12):
                x, y = place[i[s:s + (1 << 12)]], place[j[s:s + (1 << 12)]]
                if shift[x].any() or shift[y].any():
                    total = np.minimum(count[x].astype(np.int64) << shift[x][:, None], count[y].astype(np.int64) << shift[y][:, None]).sum(1)
                else:
                    total = np.minimum(count[x], count[y]).sum(1, dtype=np.int64)
                good.append(total >= needed(size[x], size[y]))
            return np.concatenate(good)

        return reach

    def run(batches):
        for keys, half, size, low, high, label, side in _whole_groups(batches, ["slab", "i", "j"], ("half", *_ENTRY[2:], "label", "side")):
            half = half.view(np.int64)
            _, own = np.unique(label, return_inverse=True)
            start = _starts(keys)
            mixed = keys[1] != keys[2]
            for some, with_side in ((~mixed, False), (mixed, True)):
                at = np.flatnonzero(some)
                if len(at):
                    begin, reach = _starts([k[at] for k in keys]), reach_of(half[at])
                    for i, j in tree_join(begin, Points(size[at], low[at], high[at]), own[at], side[at] if with_side else None):
                        good = reach(i, j)
                        a, b = half[at[i[good]]], half[at[j[good]]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _array_files(numbers: DataFrame, name: str) -> list[tuple[int, str]]:
    """(first number, address) of files of the sorted numbers (column n) in the shared folder."""
    folder = scratch_path(numbers.sparkSession, name)

    def run(batches):
        parts = [b.column("n").to_numpy() for b in batches if b.num_rows]
        if parts:
            all_, path = np.concatenate(parts), fresh(folder, name)
            write_arrays(path, {"n": all_})
            yield pa.RecordBatch.from_pydict({"first": pa.array([int(all_[0])], pa.int64()), "path": [path]})

    files = numbers.distinct().repartitionByRange("n").sortWithinPartitions("n").mapInArrow(run, "first bigint, path string")
    return [tuple(r) for r in written_table(files, f"{name}-files").orderBy("first").collect()]


def finer(own: np.ndarray) -> bytes:
    """The point of FINE groups of a set, behind its size and shift."""
    count, shift = point(own, FINE)
    return np.array([len(own) << 8 | shift]).tobytes() + count.tobytes()


def candidates(texts: DataFrame, sets: DataFrame, ends: DataFrame, name: str, column: str, shingle: int = SHINGLE) -> DataFrame:
    """(half, node, column) of the sets whose half is among ends; column: ``fine``, the finer point, or ``members``, the set.

    One text of each set is shingled again. Which ones, every task looks up in sorted files that
    it maps, so that no other text moves. Sets are some twenty times as long as points, so only
    those of pairs that the points leave are asked for.
    """
    prints = sets.join(ends, "half", "left_semi").groupBy("node").agg(F.min("print").alias("n")).select("n")
    files = _array_files(prints, f"{name}-{column}")

    def run(batches):
        arrays, seen = [(f, map_arrays(path)["n"]) for f, path in files], set()

        def wanted():
            for batch in batches:
                own = batch.column("print").to_numpy()
                hit = np.zeros(len(own), bool)
                for _, numbers in arrays:
                    hit |= numbers[np.minimum(np.searchsorted(numbers, own), len(numbers) - 1)] == own
                for k, p in enumerate(own.tolist()):
                    hit[k] &= p not in seen
                    if hit[k]:
                        seen.add(p)
                if hit.any():
                    yield batch.filter(pa.array(hit))

        for _, some in _shingled(wanted(), shingle):
            node, value = [], []
            for own in some:
                if len(own):
                    node.append(xxhash.xxh3_128_digest(own.tobytes()))
                    value.append(finer(own) if column == "fine" else own.tobytes())
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(_halves(node)), pa.array(node, pa.binary()), pa.array(value, pa.binary())], names=["half", "node", column])

    found = texts.mapInArrow(run, f"half bigint, node binary, {column} binary")
    return written_table(found.groupBy("half", "node").agg(F.first(column).alias(column)), f"{name}-{column}")


def _tested(test):
    """For mapInArrow: the rows, sorted by a, whose a_value and b_value pass the test."""
    def run(batches):
        last, one = None, None
        for batch in batches:
            good = []
            for k, (x, y) in enumerate(zip(batch.column("a_value"), batch.column("b_value"))):
                x = x.as_buffer()
                if last is None or x != last:
                    last, one = x, x
                if test(one, y.as_buffer()):
                    good.append(k)
            yield batch.select(["a", "b", "a_node", "b_node"]).take(pa.array(good, pa.int64()))

    return run


_PAIR = "a bigint, b bigint, a_node binary, b_node binary"


def _end(some: DataFrame, k: str, column: str) -> DataFrame:
    return some.select(F.col("half").alias(k), F.col("node").alias(f"{k}_node"), F.col(column).alias(f"{k}_value"))


def bounded(pairs: DataFrame, fine: DataFrame, name: str) -> DataFrame:
    """(a, b, a_node, b_node) of the nodes whose halves are paired and whose finer points reach the overlap they need."""

    def reach(x, y):
        (a, b), (p, q) = (np.frombuffer(v, np.int64, 1) for v in (x, y)), (np.frombuffer(v, np.uint8, FINE, 8).astype(np.int64) for v in (x, y))
        return int(np.minimum(p << (a & 255), q << (b & 255)).sum()) >= needed(int(a[0]) >> 8, int(b[0]) >> 8)

    near = pairs.join(_end(fine, "b", "fine"), "b").join(_end(fine, "a", "fine"), "a")
    return written_table(near.mapInArrow(_tested(reach), _PAIR), f"{name}-near")


def ends_of(pairs: DataFrame, name: str) -> DataFrame:
    """(half) of both ends of pairs (a, b)."""
    return written_table(pairs.select(F.explode(F.array("a", "b")).alias("half")).distinct(), f"{name}-ends")


def confirmed(near: DataFrame, some: DataFrame, name: str) -> DataFrame:
    """Links (a, b, a_half, b_half) of the bounded pairs whose sets (of candidates) are linked."""

    def equal_enough(x, y):
        return linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))

    done = near.join(_end(some, "b", "members"), ["b", "b_node"]).join(_end(some, "a", "members"), ["a", "a_node"]).mapInArrow(_tested(equal_enough), _PAIR)
    return written_table(done.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a").alias("a_half"), F.col("b").alias("b_half")), f"{name}-links")


def links(texts: DataFrame, sets: DataFrame, small: int = SMALL, slab: int = SLAB) -> DataFrame:
    """Links (a, b) of nodes that connect exactly the different sets which chains of links connect.

    texts: (print, text). A slab with more than ``slab`` points of several components is dealt out
    in parts, and every two parts meet in one task.
    """
    dealt = entries(texts.select("text"), bucket_order(texts.select("text"))).repartition("slab").sortWithinPartitions("slab", "size", "low", "high", "half")
    rows = written_table(crowded(dealt, small), "crowded")
    pairs = written_table(rows.filter("slab is null").select("a", "b").distinct(), "first-pairs")
    near = bounded(pairs, candidates(texts, sets, ends_of(pairs, "first"), "first", "fine"), "first")
    first = confirmed(near, candidates(texts, sets, ends_of(near, "first-near"), "first", "members"), "first")
    roots = connected(first.select("a", "b"))
    ends = first.select(F.col("a").alias("node"), F.col("a_half").alias("half")).unionByName(first.select(F.col("b").alias("node"), F.col("b_half").alias("half")))
    labels = written_table(ends.distinct().join(roots, "node").select("half", F.xxhash64("root").alias("label")), "labels")
    own = rows.filter("slab is not null").select(*_ENTRY).join(labels, "half", "left").withColumn("label", F.coalesce("label", "half"))
    own = written_table(own, "labelled")
    mixed = own.groupBy("slab").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).filter("least < most")
    mixed = mixed.select("slab", F.ceil(F.col("n") / slab).cast("long").alias("parts"))
    part = F.pmod("half", "parts")
    own = written_table(own.join(mixed, "slab"), "mixed")
    fine = candidates(texts, sets, own.select("half").distinct(), "second", "fine")
    dealt = own.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select(*_ENTRY, "label", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    dealt = dealt.repartition("slab", "i", "j").sortWithinPartitions("slab", "i", "j", "label", "size", "low", "high")
    pairs = written_table(second_pairs(dealt, FinePoints(fine)).distinct(), "second-pairs")
    near = bounded(pairs, fine, "second")
    second = confirmed(near, candidates(texts, sets, ends_of(near, "second-near"), "second", "members"), "second")
    return first.unionByName(second).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, slab: int = SLAB) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id: the smallest id reachable by links, its own included.

    Null texts and texts without words have no shingles and are linked with nothing, so each is its
    own component; shorter texts than a shingle are one. Repeated rows each come out. Rows without
    id get the smallest id of their component, or null. An empty table gives no rows; other
    columns are left out. Shingles are compared as 64-bit digests, sets are named by 128 bits.
    """
    texts = docs.select(F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    sets = written_table(sets_of(docs, id_col, text_col), "sets")
    roots = written_table(connected(links(texts, sets, small, slab)), "roots")
    least = sets.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = written_table(least, "least")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    names = least.join(ids, "root").select("node", "component_id")
    joined = sets.select("doc_id", "node", "size").join(names, "node", "left")
    return joined.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
