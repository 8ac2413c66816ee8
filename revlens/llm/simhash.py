"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint is cut into ``parts`` blocks. If two fingerprints differ in at most
``distance`` bits, then in some block they differ in at most t = distance // parts. Each
block has a covering code: a Hamming code on the first 2^r - 1 bits, every pattern on the
rest, so that no block value is further than one bit from its nearest anchor, its home. A
fingerprint is copied to all anchors within 1 + t bits in each block; it then meets every
near fingerprint at that one's home. Fingerprints are compared per anchor, whole.

Three blocks make about 48 copies of a fingerprint over 2^17 and more anchors a block; two
blocks make about 340 copies over 2^27, which pays from some 10^9 different fingerprints on.
The result is the same for any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.components import connected, local_roots
from revlens.llm.shared import SEED, free
from revlens.session import written_table

SHINGLE = 4
DISTANCE = 4
PARTS = 3
#: Fingerprints of one anchor beyond which its comparison is cut into tiles for other tasks.
TILE = 4096
#: Shingles and pairs handled by one array operation.
CHUNK = 1 << 18
PAIRS = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a text; a null or blank text gives zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    n = max(1, len(words) - shingle + 1)
    begin, end = begin[:n].tolist(), end[len(words) - n:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(begin[k:k + CHUNK], end[k:k + CHUNK])], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, whatever its id; other columns are left out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp, pa.int64())], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp bigint")


def _blocks(parts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the blocks of a 64-bit value."""
    cut = [64 * k // parts for k in range(parts + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cut, cut[1:])]


def _masks(bits: int, reach: int) -> list[np.ndarray]:
    """For each syndrome the bit patterns that lead to the anchors within reach; the first one leads home."""
    coded = (1 << (bits + 1).bit_length() - 1) - 1
    found: dict[int, list[int]] = {}
    for weight in range(reach + 1):
        for at in combinations(range(bits), weight):
            syndrome = 0
            for k in at:
                syndrome ^= k + 1 if k < coded else 0
            found.setdefault(syndrome, []).append(sum(1 << k for k in at))
    return [np.array(found[s], np.uint64) for s in range(coded + 1)]


def _syndrome(value: np.ndarray, bits: int) -> np.ndarray:
    coded = (1 << (bits + 1).bit_length() - 1) - 1
    out = np.zeros(len(value), np.int64)
    for k in range(coded):
        out ^= np.where(value >> np.uint64(k) & np.uint64(1), k + 1, 0)
    return out


def _replicas(fp: np.ndarray, parts: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, index into fp, whether it is the home anchor), block by block and syndrome by syndrome."""
    for number, (lo, bits) in enumerate(_blocks(parts)):
        value = fp >> np.uint64(lo) & np.uint64((1 << bits) - 1)
        masks = _masks(bits, 1 + distance // parts)
        syndrome = _syndrome(value, bits)
        for s, mask in enumerate(masks):
            at = np.flatnonzero(syndrome == s)
            anchor = (value[at][:, None] ^ mask) | np.uint64(number << 56)
            home = np.zeros(anchor.shape, bool)
            home[:, 0] = True
            yield anchor.ravel(), np.repeat(at, len(mask)), home.ravel()


def _starts(key: list[np.ndarray]) -> np.ndarray:
    """First row of each run of equal keys, and the number of rows."""
    new = np.any([k[1:] != k[:-1] for k in key], axis=0)
    return np.append(np.flatnonzero(np.append(True, new)), len(key[0]))


def _forest(start: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near within each group; start: first row of each group, and the end."""
    size = np.diff(start)
    homes = np.flatnonzero(home)
    group = np.repeat(np.arange(len(size)), size)[homes]
    meets = size[group]
    a, b, k = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    until = np.cumsum(meets)
    while k < len(homes):
        stop = max(k + 1, int(np.searchsorted(until, (until[k - 1] if k else 0) + PAIRS, "right")))
        n = meets[k:stop]
        left = np.repeat(homes[k:stop], n)
        right = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[k:stop]], n)
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= distance) & (left != right)
        a.append(left[near])
        b.append(right[near])
        k = stop
    root = local_roots(len(fp), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def links(prints: DataFrame, distance: int = DISTANCE, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (fp) which chains of near ones connect.

    Per anchor only a spanning forest leaves the task, never its pairs. An anchor with more than
    ``tile`` fingerprints is compared in a second step, tile by tile in other tasks. Repeated
    and null fingerprints are allowed and add nothing.
    """
    distinct = prints.select("fp").filter("fp is not null").distinct()

    def copies(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(fp), CHUNK):
                part = fp[s:s + CHUNK]
                for anchor, at, home in _replicas(part, parts, distance):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor.view(np.int64)), pa.array(part[at].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"]
                    )

    def batch_of(a, b, anchor=None, i=None, j=None, home=None):
        n, none = len(a), None
        cols = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
        cols += [pa.array(x) if x is not none else pa.nulls(n, t) for x, t in ((anchor, pa.int64()), (i, pa.int32()), (j, pa.int32()), (home, pa.bool_()))]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "anchor", "i", "j", "home"])

    def per_anchor(batches):
        """Rows come sorted by anchor; a group is compared when its last row is in."""
        for key, fp, home in _whole_groups(batches, ["anchor"]):
            start = _starts(key)
            large = np.flatnonzero(np.diff(start) > tile)
            keep = np.ones(len(fp), bool)
            for g in large:
                s, e = start[g], start[g + 1]
                keep[s:e] = False
                yield from _tiles(key[0][s], fp[s:e], home[s:e])
            if keep.any():
                a, b = _forest(_starts([key[0][keep]]), fp[keep], home[keep], distance)
                yield batch_of(a, b)

    def _tiles(anchor, fp, home):
        slices = -(-len(fp) // (tile // 2))
        own = (np.arange(len(fp)) % slices).astype(np.int32)
        for k in range(slices):  # the homes of slice k meet the copies of every slice
            for is_home, at in ((True, np.flatnonzero((own == k) & home)), (False, np.flatnonzero(own == k))):
                other = np.tile(np.arange(slices, dtype=np.int32), len(at))
                mine, f = np.full(len(other), k, np.int32), np.repeat(fp[at], slices)
                i, j = (mine, other) if is_home else (other, mine)
                yield batch_of(f, f, np.full(len(f), anchor, np.int64), i, j, np.full(len(f), is_home))

    def per_tile(batches):
        for key, fp, home in _whole_groups(batches, ["anchor", "i", "j"]):
            a, b = _forest(_starts(key), fp, home, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    placed = distinct.mapInArrow(copies, "anchor bigint, fp bigint, home boolean")
    first = written_table(
        placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(per_anchor, "a bigint, b bigint, anchor bigint, i int, j int, home boolean"), "anchors"
    )
    tiles = first.filter("anchor is not null").select("anchor", "i", "j", F.col("a").alias("fp"), "home")
    late = tiles.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(per_tile, "a bigint, b bigint")
    return first.filter("anchor is null").select("a", "b").unionByName(late)


def _whole_groups(batches, keys, rest=("fp", "home")):
    """(key columns, fp, home, other columns of rest) of rows sorted by key, cut at group borders only."""
    held: list[list[np.ndarray]] = []

    def joined(parts):
        cols = [np.concatenate(x) for x in zip(*parts)]
        return cols[:len(keys)], cols[len(keys)].view(np.uint64), *cols[len(keys) + 1:]

    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in [*keys, *rest]]
        if not len(cols[0]):
            continue
        last = np.all([c == c[-1] for c in cols[:len(keys)]], axis=0)
        tail = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if tail:
            held.append([c[:tail] for c in cols])
            yield joined(held)
            held = [[c[tail:] for c in cols]]
        elif held and any(h[-1] != c[0] for h, c in zip(held[-1][:len(keys)], cols)):
            yield joined(held)
            held = [cols]
        else:
            held.append(cols)
    if held:
        yield joined(held)


def classes(prints: DataFrame, distance: int = DISTANCE, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(fp, root) of every different fingerprint: equal roots are joined by a chain of near ones."""
    distinct = prints.select("fp").distinct()
    roots = connected(links(prints, distance, parts, tile)).select(F.col("node").alias("fp"), "root")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    component_id is the smallest id reachable over links of at most ``distance`` bits, the
    document's own included. Null and blank texts have fingerprint zero and link like others;
    a text below four words is one shingle. Repeated rows each come out. Rows without id get
    the smallest id of their component, or null if it has none. An empty table gives no rows.
    """
    prints = written_table(fingerprints(docs, id_col, text_col), "fingerprints")
    roots = written_table(classes(prints, distance, parts), "classes")
    least = prints.groupBy("fp").agg(F.min("id").alias("least")).join(roots, "fp")
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    names = roots.join(ids, "root").select("fp", "component_id")
    return prints.join(names, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, parts: int = PARTS) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest id stays.

    A row without id stays only in a component without ids; there, and among repeated ids, the
    smallest text digest decides, and equal rows count as one. Columns are those of ``docs``.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"))
    prints = written_table(fingerprints(docs.select(key.alias("id"), F.col(text_col).alias("text")), "id", "text"), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min("id").alias("id")).join(classes(prints, distance, parts), "fp").groupBy("root").agg(F.min("id").alias("id"))
    return kept_firsts(docs, firsts, id_col, text_col)


def kept_firsts(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each row of firsts (id: struct of none, id, digest of the text)."""
    own_id, digest, number = free(docs, "_id", "_digest", "_number")
    marked = docs.withColumns({own_id: F.col(id_col), digest: F.xxhash64(F.col(text_col))})
    keep = written_table(firsts.select(F.col("id.id").alias(own_id), F.col("id.digest").alias(digest)).distinct(), "kept")
    same = marked[own_id].eqNullSafe(keep[own_id]) & (marked[digest] == keep[digest])
    order = Window.partitionBy(own_id, digest).orderBy(F.lit(1))
    kept = marked.join(keep, same, "left_semi").withColumn(number, F.row_number().over(order))
    return kept.filter(F.col(number) == 1).select(*docs.columns)
