"""Alignment of two tokenizers over the bytes of a text, by sparse incidence matrices.

Both tokenizers cut the same bytes. A matrix of tokens by bytes, in CSR form, is built for each;
bytes that no token end separates have equal columns and share one. The product A times B transposed, row by row after Gustavson, has an entry for each pair of
tokens that share bytes. Offsets where tokens of both end cut the bytes into groups; the product
of the matrices of tokens by groups links tokens of one group. A batch of texts is one block
diagonal matrix. How many texts hold a pair of ids linked is counted per task first and
summed by Spark; the table of counts, which the two vocabularies bound, lies in sorted files
that tasks map into memory.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.shared import fresh, map_arrays, write_arrays
from revlens.llm.tokens import PATTERN, TESTED, _byte_letters
from revlens.session import scratch_path, written_table

#: Bytes of ids in one block of matrices, and pairs a task counts before it hands them over.
CHUNK, HELD = 1 << 17, 1 << 19
#: Texts that go from one task to the next at a time.
TEXTS = 512
#: Words whose pieces a worker remembers, and the most characters of one.
REMEMBERED, WORD_CHARS = 1 << 17, 40
#: Entries a product may expand to at once.
EXPAND = 1 << 22


@dataclass
class Csr:
    """A sparse matrix by rows: the columns of row i are indices[indptr[i]:indptr[i + 1]]; every entry is one."""

    indptr: np.ndarray
    indices: np.ndarray
    width: int

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(len(self.indptr) - 1, dtype=np.int32), np.diff(self.indptr))
        if (self.indices[1:] < self.indices[:-1]).any():
            row = row[np.argsort(self.indices, kind="stable")]
        size = np.bincount(self.indices, minlength=self.width)
        return Csr(np.append(0, np.cumsum(size)), row, len(self.indptr) - 1)


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by columns, for tokens that follow each other and have so many columns each."""
    indptr = np.append(0, np.cumsum(lengths))
    return Csr(indptr, np.arange(indptr[-1], dtype=np.int32), int(indptr[-1]))


def product(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of the entries of a times b, sorted, in slices of rows of at most EXPAND steps or one row."""
    steps = np.diff(b.indptr)[a.indices]
    upto = np.append(0, np.cumsum(steps))[a.indptr]
    row, rows = 0, len(a.indptr) - 1
    while row < rows:
        stop = min(rows, max(row + 1, int(np.searchsorted(upto, upto[row] + EXPAND, "right")) - 1))
        s, e = a.indptr[row], a.indptr[stop]
        n = steps[s:e]
        own = np.repeat(np.arange(row, stop), np.diff(a.indptr[row:stop + 1]))
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b.indptr[a.indices[s:e]], n)
        key = np.repeat(own, n) * b.width + b.indices[place]
        if len(key) and (key[1:] < key[:-1]).any():
            key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        yield key[first] // b.width, key[first] % b.width, np.diff(np.append(first, len(key)))
        row = stop


class Tokenizer:
    """Ids of texts, and the bytes of every id."""

    def __init__(self, path: str, odd: str | None = None):
        self.sentence = path.endswith(".model")
        if self.sentence:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
            self.ids = model.encode
        else:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            names = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
            pieces = [""] * (max(names.values()) + 1)
            for name, k in names.items():
                pieces[k] = name
            letters = {c: b for b, c in _byte_letters().items()}
            self.path, self._library = path, None
            self.fast = _ranked(spec, letters)
            if self.fast and odd is not None:
                left = re.compile(f"[{re.escape(odd)}{chr(TESTED)}-\U0010FFFF]")
                self.ids = lambda text: self.whole(text) if left.search(text) else self.fast(text)
            else:
                self.ids = self.whole
        self.pieces = [_piece_bytes(p) if self.sentence else _letter_bytes(p, letters) for p in pieces]
        self.lengths = np.array([len(p) for p in self.pieces], np.int32)

    def whole(self, text: str) -> list[int]:
        """The ids by the library itself, which is loaded when first asked."""
        if self._library is None:
            import tokenizers

            self._library = tokenizers.Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
            self._library.no_truncation()
            self._library.no_padding()
        return self._library.encode(text, add_special_tokens=False).ids


class Words:
    """The pieces of texts word by word, for a model of which cut_by_words holds; those of frequent words are remembered."""

    def __init__(self, whole: Tokenizer):
        self.whole, self.known, self.kind = whole, {}, _kind(len(whole.pieces))
        self.cut = re.compile(r" [^ ]+")
        self.first = np.array([p.startswith(b" ") for p in whole.pieces])

    def __call__(self, text: str) -> bytes | None:
        """The ids of a text, packed; None if their bytes are not a blank and the text. Texts with other than lone blanks between words are taken as a whole."""
        words, known = self.cut.findall(" " + text), self.known
        if "▁" in text or sum(map(len, words)) != len(text) + 1:
            return self._packed(text)
        new = list({w for w in words if w not in known})
        if not new:
            return b"".join(map(known.__getitem__, words))
        data = self._packed("".join(new)[1:])
        if data is None:
            return self._packed(text)
        at = (np.flatnonzero(self.first[np.frombuffer(data, self.kind)]) * self.kind.itemsize).tolist()
        found = {w: data[s:e] for w, s, e in zip(new, at, [*at[1:], len(data)])}
        out = b"".join([known.get(w) or found[w] for w in words])
        if len(known) < REMEMBERED:
            known.update((w, ids) for w, ids in found.items() if len(w) <= WORD_CHARS)
        return out

    def _packed(self, text: str) -> bytes | None:
        ids = self.whole.ids(text)
        return array(self.kind.char, ids).tobytes() if b"".join(map(self.whole.pieces.__getitem__, ids)) == b" " + text.encode() else None


def cut_by_words(path: str) -> bool:
    """Whether a model of pieces gives a text the pieces of its words, each with the lone blank before it.

    So it is if the text stays as it is, a blank is put before it, characters without a piece are
    spelt in bytes, and no piece has a blank behind another character: then no merge reaches
    from one word into the next.
    """
    if not path.endswith(".model"):
        return False
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    trained, normal, kinds = model.trainer_spec, model.normalizer_spec, model.SentencePiece
    plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
    merges = trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix
    usual = all(p.type in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) for p in model.pieces)
    return bool(plain and merges and usual and not any(re.search("[^▁]▁", p.piece) for p in model.pieces if p.type == kinds.NORMAL))


def _piece_bytes(piece: str) -> bytes:
    hexed = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()


def _letter_bytes(piece: str, letters: dict[str, int]) -> bytes:
    return bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()


def _ranked(spec: dict, letters: dict[str, int]):
    """A faster encoder with the same vocabulary, if merges are in the order of the ids; else nothing."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    quiet = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not (plain and quiet and model.get("type") == "BPE" and spec.get("normalizer") is None):
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    places = [model["vocab"].get(m, -1) for m in merged]  # whole strings, so that ids are the ranks
    if places != sorted(set(places)) or len(places) + 256 != len(model["vocab"]):
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in name): k for name, k in model["vocab"].items()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def odd_characters(path: str) -> str | None:
    """Characters below TESTED that the faster encoder cuts otherwise than the library; None if there is no faster one."""
    if path.endswith(".model"):
        return None
    own = Tokenizer(path)
    if own.fast is None:
        return None
    probes = {chr(k): f"a{chr(k)}1{chr(k)}!{chr(k)} {chr(k)}\n" for k in range(TESTED) if not 0xD800 <= k < 0xE000}
    some, odd = list(probes), []
    for start in range(0, len(some), 4096):
        block = some[start:start + 4096]
        text = "".join(map(probes.get, block))
        if own.fast(text) != own.whole(text):
            odd += [c for c in block if own.fast(probes[c]) != own.whole(probes[c])]
    return "".join(odd)


def _kind(size: int) -> np.dtype:
    """How an id of a vocabulary of this size is stored."""
    return np.dtype(np.uint16 if size <= 1 << 16 else np.int32)


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b): the ids of every text as numbers of 16 bits if the vocabulary allows it, else 32, empty if the bytes of either are not space and text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    odd, by_words = odd_characters(a_path), cut_by_words(b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Tokenizer(a_path, odd), Tokenizer(b_path)
        kinds = [_kind(len(t.pieces)).char for t in (a, b)]
        words = Words(b) if by_words else None
        for batch in (b.slice(s, TEXTS) for b in batches for s in range(0, b.num_rows, TEXTS)):
            out: list[tuple[bytes, bytes]] = []
            for text in batch.column("text"):
                pair, text = (b"", b""), text.as_py()
                if text:
                    first, want = a.ids(" " + text), b" " + text.encode()
                    if words:
                        second = words(text)
                    else:
                        ids = b.ids(text)
                        second = array(kinds[1], ids).tobytes() if b"".join(map(b.pieces.__getitem__, ids)) == want else None
                    if second is not None and b"".join(map(a.pieces.__getitem__, first)) == want:
                        pair = array(kinds[0], first).tobytes(), second
                out.append(pair)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)]], names=["doc_id", "a", "b"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, a binary, b binary")


@dataclass
class Block:
    """Some texts: their tokens, in order, and the matrices over them."""

    ids: tuple[np.ndarray, np.ndarray]
    row: tuple[np.ndarray, np.ndarray]
    matrices: tuple[Csr, Csr]
    groups: tuple[np.ndarray, np.ndarray]
    size: int

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(token of A, token of B) of the pairs that share bytes."""
        for i, j, _ in product(self.matrices[0], self.matrices[1].transposed()):
            yield i, j

    def all_links(self) -> tuple[np.ndarray, np.ndarray]:
        parts = list(self.links())
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in (0, 1))

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(token of A, token of B) of the pairs in one group."""
        n = int(self.groups[0][-1]) + 1 if len(self.groups[0]) else 0
        a, b = (Csr(np.arange(len(g) + 1), g, n) for g in self.groups)
        for i, j, _ in product(a, b.transposed()):
            yield i, j

    def group_strings(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text: the ids of A and B in each group."""
        ids, group, row = (np.concatenate(x) for x in (self.ids, self.groups, self.row))
        if not len(ids):
            return [b""] * self.size
        side = np.repeat([0, 1], [len(self.ids[0]), len(self.ids[1])])
        order = np.argsort(2 * group + side, kind="stable")
        ids, group, side = ids[order], group[order], side[order]
        ends = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
        digits = len(str(ids.max()))
        power = 10 ** np.arange(digits - 1, -1, -1)
        every = np.arange(ids.max() + 1)[:, None]
        spelt = np.zeros((len(every), digits + 1), np.uint8)
        spelt[:, :digits] = np.where((every >= power) | (power == 1), every // power % 10 + ord("0"), 0)
        shown = spelt[ids]
        shown[:, digits] = np.where(ends, np.where(side == 0, ord("|"), ord(";")), ord(","))
        flat = shown.ravel()
        flat = flat[flat > 0].tobytes()
        length = np.count_nonzero(spelt, axis=1) + 1
        size = np.bincount(row[order], length[ids], self.size).astype(np.int64)
        at = np.append(0, np.cumsum(size)).tolist()
        return [flat[s:e - 1] if e > s else b"" for s, e in zip(at, at[1:])]


def _blocks(batch: pa.RecordBatch, lengths: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, Block]]:
    """(first row, block) of a batch of encoded texts; a longer text is a block of its own."""
    kinds = [_kind(len(x)) for x in lengths]
    flat, at = [], []
    for name in "ab":
        column = batch.column(name)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        data = column.buffers()[2]
        flat.append(np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8))
        at.append(offsets.astype(np.int64))
    k, n = 0, batch.num_rows
    while k < n:
        stop = k + 1
        while stop < n and at[0][stop + 1] - at[0][k] <= CHUNK:
            stop += 1
        ids = tuple(flat[x][at[x][k]:at[x][stop]].view(kinds[x]).astype(np.int64) for x in (0, 1))
        row = tuple(np.repeat(np.arange(stop - k), np.diff(at[x][k:stop + 1]) // kinds[x].itemsize) for x in (0, 1))
        upto = tuple(np.append(0, np.cumsum(lengths[x][ids[x]], dtype=np.int64)) for x in (0, 1))
        ends = np.zeros(int(upto[0][-1]) + 1, np.int8)
        for p in upto:
            ends[p[1:]] += 1
        cuts, column = np.cumsum(ends == 2), np.cumsum(ends > 0)
        matrices = tuple(incidence(np.diff(column[p])) for p in upto)
        groups = tuple(cuts[p[:-1]] for p in upto)
        yield k, Block(ids, row, matrices, groups, stop - k)
        k = stop


def _lengths(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every id; the vocabularies bound what goes along to the tasks."""
    return Tokenizer(a_path).lengths, Tokenizer(b_path).lengths


def pair_counts(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, n): in how many of the encoded texts the ids are linked at least once."""
    lengths = _lengths(a_path, b_path)

    def run(batches):
        width = len(lengths[1])
        held = [np.empty(0, np.int64), np.empty(0, np.int64)]

        def handed(pairs, n):
            return pa.RecordBatch.from_arrays([pa.array(pairs // width), pa.array(pairs % width), pa.array(n)], names=["a_id", "b_id", "n"])

        def merged(parts):
            pairs, place = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            return [pairs, np.bincount(place, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)]

        for batch in batches:
            parts = [held]
            for _, block in _blocks(batch, lengths):
                i, j = block.all_links()
                key = np.unique((block.row[0][i] * len(lengths[0]) + block.ids[0][i]) * width + block.ids[1][j])
                parts.append(np.unique(key % (len(lengths[0]) * width), return_counts=True))
                if sum(len(p) for p, _ in parts) > HELD:
                    parts = [merged(parts)]
            held = merged(parts)
            if len(held[0]) > HELD:
                yield handed(*held)
                held = [np.empty(0, np.int64), np.empty(0, np.int64)]
        yield handed(*held)

    rows = texts.mapInArrow(run, "a_id bigint, b_id bigint, n bigint")
    return rows.groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


class Counts:
    """The table of pair counts in sorted files of the shared folder."""

    def __init__(self, files: list[tuple[int, str]]):
        self.files = files
        self._open: dict[int, dict[str, np.ndarray]] = {}

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is the highest of its A id) of sorted pairs that the table has."""
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        cuts = [*np.searchsorted(pairs, [f for f, _ in self.files]), len(pairs)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            if e > s:
                if k not in self._open:
                    self._open[k] = map_arrays(self.files[k][1])
                part = self._open[k]
                place = np.searchsorted(part["pair"], pairs[s:e])
                count[s:e], best[s:e] = part["n"][place], part["best"][place] == 1
        return count, best


def count_files(counts: DataFrame, width: int) -> Counts:
    """Write the table of (a_id, b_id, n); one row a file reaches the driver."""
    folder = scratch_path(counts.sparkSession, "pairs")
    top = counts.groupBy("a_id").agg(F.max("n").alias("top"))
    rows = counts.join(top, "a_id").select((F.col("a_id") * width + F.col("b_id")).alias("pair"), "n", (F.col("n") == F.col("top")).cast("byte").alias("best"))

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            arrays = {c: np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("pair", "n", "best")}
            path = fresh(folder, "counts")
            write_arrays(path, arrays)
            yield pa.RecordBatch.from_pydict({"first": pa.array([int(arrays["pair"][0])], pa.int64()), "path": [path]})

    files = rows.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(run, "first bigint, path string")
    return Counts([tuple(r) for r in written_table(files, "pair-files").orderBy("first").collect()])


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", by: str = "bytes") -> DataFrame:
    """(doc_id, a_place, b_place, a_id, b_id) of every link of every text; by: ``bytes`` they share, or the same ``group``."""
    texts, lengths = encoded(docs, a_path, b_path, id_col, text_col), _lengths(a_path, b_path)

    def run(batches):
        for batch in batches:
            for k, block in _blocks(batch, lengths):
                for i, j in block.links() if by == "bytes" else block.group_links():
                    row = block.row[0][i]
                    place = [t - np.searchsorted(block.row[side], row) for side, t in ((0, i), (1, j))]
                    cols = [batch.column("doc_id").take(pa.array(row + k)), *map(pa.array, (*place, block.ids[0][i], block.ids[1][j]))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "a_place", "b_place", "a_id", "b_id"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, a_place bigint, b_place bigint, a_id bigint, b_id bigint")


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_group_links", "n_best", "count_sum")


def report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups_sha256) of every row.

    A null or empty text, and one whose tokens do not spell a blank and the text, has zeros and an
    empty hash. Repeated rows each come out and each count. Files of the vocabularies must be
    on all executors. An empty table gives no rows; other columns are left out.
    """
    texts = written_table(encoded(docs, a_path, b_path, id_col, text_col), "encoded")
    lengths = _lengths(a_path, b_path)
    width = len(lengths[1])
    counts = count_files(written_table(pair_counts(texts, a_path, b_path), "pair-counts"), width)

    def run(batches):
        for batch in batches:
            found: list[list] = [[] for _ in MEASURES]
            hashes: list[str] = []
            for _, block in _blocks(batch, lengths):
                i, j = block.all_links()
                pairs, place = np.unique(block.ids[0][i] * width + block.ids[1][j], return_inverse=True)
                count, best = counts.look_up(pairs)
                row = block.row[0][i]
                total = np.zeros(block.size, np.int64)
                np.add.at(total, row, count[place])
                first_of_group = [g[np.append(True, g[1:] != g[:-1])] if len(g) else g for g in block.groups[:1]][0]
                group_row = block.row[0][np.searchsorted(block.groups[0], first_of_group)] if len(first_of_group) else first_of_group
                shared = np.zeros(block.size, np.int64)
                for a, _ in block.group_links():
                    shared += np.bincount(block.row[0][a], minlength=block.size)
                values = (
                    np.bincount(block.row[0], minlength=block.size), np.bincount(block.row[1], minlength=block.size), np.bincount(group_row, minlength=block.size),
                    np.bincount(row, minlength=block.size), shared, np.bincount(row[best[place]], minlength=block.size), total,
                )
                for out, v in zip(found, values):
                    out.extend(v.tolist())
                hashes += [hashlib.sha256(g).hexdigest() if g else "" for g in block.group_strings()]
            cols = [batch.column("doc_id"), *[pa.array(v, pa.int64()) for v in found], pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *MEASURES, "groups_sha256"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, {', '.join(f'{m} bigint' for m in MEASURES)}, groups_sha256 string")
