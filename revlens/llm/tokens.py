"""Token counts with a shortcut for pre-tokens that are one token as a whole.

For a byte-level BPE it is proved beforehand which strings of the vocabulary come out as one
token when they stand alone. A text is cut into pre-tokens; those that are in the table count
one, only the rest is merged. The cut uses one pattern; which characters it sees otherwise than
the tokenizer's own cut is tested beforehand too, and texts with such characters, like all
texts of other kinds of tokenizers, are left to the library as they are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
#: The cut of byte-level BPE; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters from here on are not tested but left to the library; below are all alphabets and the common Han characters.
TESTED = 0xA000
#: Merged pre-tokens a worker remembers, and characters cut at once.
REMEMBERED, CHUNK = 1 << 18, 1 << 20
#: A place where no pre-token reaches across: a lone blank after and before other characters.
_SAFE = re.compile(r"\S(?= \S)")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable Latin-1 as itself and the other bytes as U+0100 and following."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _library(tokenizer) -> Callable[[str], int]:
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


class WholeTokens(dict):
    """Pre-token -> number of tokens: ones are proved, the rest is merged when asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, _byte_letters()
        cut = regex.compile(PATTERN)
        to_byte = {c: b for b, c in self.letters.items()}
        for token in tokenizer.get_vocab(with_added_tokens=False):
            try:
                text = bytes(to_byte[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character: no pre-token
            if cut.fullmatch(text) and cut.findall(text) == [text] and len(self.model.tokenize(token)) == 1:
                self[text] = 1
        self.proved = len(self)

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        if len(self) < self.proved + REMEMBERED:
            self[piece] = n
        return n


def odd_characters(tokenizer) -> str:
    """The characters below TESTED that PATTERN and the tokenizer's own cut put in different classes."""
    cut, odd = regex.compile(PATTERN), []

    def differ(probe: str) -> bool:
        return [s for s, _ in _own_spans(tokenizer, probe)] != [m.start() for m in cut.finditer(probe)]

    probes = {chr(k): f"a{chr(k)}1{chr(k)}!{chr(k)}\n" for k in range(TESTED)}
    some = list(probes)
    for start in range(0, len(some), 4096):
        block = some[start:start + 4096]
        if differ("".join(map(probes.get, block))):
            odd += [c for c in block if differ(probes[c])]
    return "".join(odd)


def _own_spans(tokenizer, text: str) -> list[tuple[int, int]]:
    return [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def _shortcut_fits(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    quiet = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return plain and quiet and spec.get("normalizer") is None and model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")


def prepare(path: str) -> dict:
    """What is found out beforehand, on the driver, for a vocabulary file: the odd characters, or that only the library fits."""
    if not path.endswith(".json") or not _shortcut_fits(path):
        return {"path": path, "odd": None}
    from tokenizers import Tokenizer

    return {"path": path, "odd": odd_characters(Tokenizer.from_file(path))}


def counter(facts: dict) -> Callable[[str], int]:
    """Function from a text to its number of tokens."""
    path = facts["path"]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    library = _library(tokenizer)
    if facts["odd"] is None:
        return library
    odd = re.compile(f"[{re.escape(facts['odd'])}{chr(TESTED)}-\U0010FFFF]")
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    special = re.compile("|".join(map(re.escape, special))) if special else None
    cut, whole = regex.compile(PATTERN), WholeTokens(tokenizer)

    def part(text: str) -> int:
        n, at = 0, 0
        while len(text) - at > CHUNK and (place := _SAFE.search(text, at + CHUNK)):
            n += sum(map(whole.__getitem__, cut.findall(text, at, place.end())))
            at = place.end()
        return n + sum(map(whole.__getitem__, cut.findall(text, at)))

    def count(text: str) -> int:
        if odd.search(text):
            return library(text)
        if special and special.search(text):
            parts = special.split(text)
            return len(parts) - 1 + sum(map(part, parts))
        return part(text)

    return count


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row for a vocabulary file that all executors have.

    Special strings in a text are special tokens, as the library's default has it; none are
    added. A null text is empty: no bytes, no tokens. Repeated rows each come out.
    """
    facts = prepare(path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        count = counter(facts)
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column("text")], pa.int64())
            size = pa.array([len(t.as_buffer()) for t in batch.column("text")], pa.int64())
            over = pa.array([k.as_py() > limit for k in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
