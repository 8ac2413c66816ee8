"""Conversation structure repair over an automaton of signatures that shares suffixes.

Each row of a conversation is one symbol of its signature: the role's initial and what is wrong
with the row. Different signatures are sorted by their reversed text, so those with a common end
follow each other; they form a DAWG that is built from the end, and only the path to the present
signature is held. A node (a suffix) is minimised to its table of cost-to-go and best edit for
every grammar state, less a constant: there are few such tables, each worked out once from
the symbol and the table behind it. The best audit is the chain of best edits from the first node.

Rows move twice as digests (repeats, order) and once with their text, streamed in order into the
repaired rows; nothing of a conversation is held but its signature and audit, a byte a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.shared import WORD
from revlens.session import written_table

SEPARATORS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows sent to Spark at once.
BATCH = 4096
#: Grammar states of ``(s?(ua)+)?``: nothing yet, after the system row, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}


def _answer(state: int) -> int:
    """The state after the row that an insertion or a new role makes."""
    return ASSISTANT if state == USER else USER


class Automaton:
    """Minimised nodes: (cost of each state above the least, best edit of each state).

    Symbols: ``x`` must be deleted; ``s``, ``u``, ``a``, ``o`` (other role) can stay, in capitals
    if truncated. The edits of one state have different letters, so ties end at the letter.
    """

    def __init__(self):
        self.nodes: list[tuple[tuple[int, ...], str]] = []
        self._known: dict[tuple, int] = {}
        self._next: dict[tuple[int, str], tuple[int, int]] = {}
        never = 1 << 40
        self.end, self.end_cost = self._node([(0, "."), (never, "."), (never, "."), (0, ".")])

    def _node(self, edits: list[tuple[int, str]]) -> tuple[int, int]:
        """Add what insertions offer, then (node, cost taken off)."""
        user, assistant = edits[USER], edits[ASSISTANT]
        edits[USER] = min(user, (assistant[0] + INSERT, "I"))
        edits[ASSISTANT] = min(assistant, (user[0] + INSERT, "I"))
        for state in (START, SYSTEM):
            edits[state] = min(edits[state], (edits[USER][0] + INSERT, "I"))
        least = min(cost for cost, _ in edits)
        node = tuple(cost - least for cost, _ in edits), "".join(edit for _, edit in edits)
        if node not in self._known:
            self._known[node] = len(self.nodes)
            self.nodes.append(node)
        return self._known[node], least

    def before(self, symbol: str, node: int) -> tuple[int, int]:
        """(node of the suffix with the symbol in front, cost taken off)."""
        found = self._next.get((node, symbol))
        if found is None:
            cost, kind, late = self.nodes[node][0], symbol.lower(), TRUNCATED * symbol.isupper()
            edits = []
            for state in range(4):
                best = (DELETE + cost[state], "D")
                if kind != "x":
                    best = min(best, (REROLE + late + cost[_answer(state)], "R"))
                    if (kind, state) in _KEEP:
                        best = min(best, (late + cost[_KEEP[kind, state]], "K"))
                edits.append(best)
            found = self._next[node, symbol] = self._node(edits)
        return found

    def audit(self, signature: str, path: list[int]) -> str:
        """Edits from the start; path: the node of every suffix, shortest first."""
        out, state, left = [], START, len(signature)
        while True:
            edit = self.nodes[path[left]][1][state]
            if edit == ".":
                return "".join(out)
            out.append(edit)
            if edit in "RI":
                state = _answer(state)
            elif edit == "K":
                state = _KEEP[signature[-left].lower(), state]
            left -= edit != "I"


def solve(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the different values of the column signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dawg = Automaton()
        path, cost, last = [dawg.end], [dawg.end_cost], ""
        for batch in batches:
            found: list[tuple[int, str]] = []
            for backward in batch.column("backward").to_pylist():
                same = 0
                for x, y in zip(backward, last):
                    if x != y:
                        break
                    same += 1
                del path[same + 1:], cost[same + 1:]
                for symbol in backward[same:]:
                    node, more = dawg.before(symbol, path[-1])
                    path.append(node)
                    cost.append(cost[-1] + more)
                last = backward
                found.append((cost[-1] + dawg.nodes[path[-1]][0][START], dawg.audit(backward[::-1], path)))
            rows = [batch.column("signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(rows, names=["signature", "cost", "audit"])

    different = signatures.select("signature").distinct().withColumn("backward", F.reverse("signature"))
    sorted_ = different.repartitionByRange("backward").sortWithinPartitions("backward")
    return sorted_.mapInArrow(run, "signature string, cost bigint, audit string")


def normalised(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): a null role or text is one blank, a null conversation or turn stays null."""
    one_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), one_blank(role_col).alias("role"), one_blank(text_col).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Normalised rows with faults, one in five, decided by crc32 of ``conv_id:turn``: dropped, emptied, cut, repeated, user."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind, text = F.crc32(name) % 20, F.col("text")
    return (
        rows.withColumn("kind", kind).filter("kind <> 0")
        .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
        .drop("copy")
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256)).alias("digest")


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Conversations whole and in order: by turn, nulls first, then role and digest of the text."""
    return rows.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", *first, "turn", "role", "digest")])


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of every conversation of normalised rows."""
    text, role = F.col("text"), F.col("role")
    narrow = rows.select(
        "conv_id", "turn", "role", _digest(text), text.rlike(WORD).alias("filled"),
        F.right(F.rtrim(text, F.lit(SEPARATORS)), F.lit(1)).isin(".", "!", "?").alias("ended"),
    )
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    initial = F.substring(role, 1, 1)
    marked = narrow.withColumn("again", F.row_number().over(same) > 1).select(
        "conv_id", "turn", "role", "digest",
        F.when(~F.col("filled"), 0).when(F.col("again"), 1).when(~F.col("ended"), 2).otherwise(3).alias("fault"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
    )
    names = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        conv, have = None, False
        key, count, turns, last_turn, last, symbols = [], [], None, None, None, []

        def ended():
            first, final, n = turns or (0, 0, 1)
            key.append(conv)
            count.append((final - first + 1 - n, *faults, illegal, "".join(symbols)))

        def filled():
            columns = list(zip(*count))
            out = pa.RecordBatch.from_arrays(
                [pa.array(key, of), *[pa.array(columns[k], pa.int64()) for k in range(5)], pa.array(columns[5], pa.string())], names=["conv_id", *names, "signature"]
            )
            key.clear()
            count.clear()
            return out

        of = None
        for batch in batches:
            of = batch.column("conv_id").type
            for c, turn, fault, initial in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "fault", "initial"))):
                if not have or c != conv:
                    if have:
                        ended()
                        if len(key) >= BATCH:
                            yield filled()
                    conv, have, turns, last_turn, last, symbols, illegal, faults = c, True, None, None, None, [], 0, [0, 0, 0]
                if turn is not None:
                    turns = (turns[0], turn, turns[2] + (turn != turns[1])) if turns else (turn, turn, 1)
                if fault < 3:
                    faults[fault] += 1
                if last is not None and last + initial not in ("su", "ua", "au"):
                    illegal += 1
                last = initial
                symbols.append("x" if fault < 2 else initial.upper() if fault == 2 else initial)
        if have:
            ended()
            yield filled()

    schema = f"conv_id {kind}, {', '.join(f'{n} bigint' for n in names)}, signature string"
    return _in_order(marked).mapInArrow(run, schema)


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of normalised rows."""
    found = written_table(signatures(rows), "signatures")
    return found.join(written_table(solve(found), "audits"), "signature").drop("signature")


def _edits(batches) -> Iterator[tuple]:
    """(conversation, edit, role, text) of every row that stays or comes in; edit "" ends a conversation."""
    conv, audit, at, state = None, None, 0, START

    def inserted():
        nonlocal at, state
        while audit[at:at + 1] == "I":
            at, state = at + 1, _answer(state)
            yield conv, "I", _ROLE[state], ""

    for batch in batches:
        for c, is_row, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "is_row", "role", "text"))):
            if not is_row:
                if audit is not None:
                    yield from inserted()
                    yield conv, "", None, None
                conv, audit, at, state = c, text, 0, START
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = _KEEP[role[0], state]
                yield conv, "K", role, text
            elif edit == "R":
                state = _answer(state)
                yield conv, "R", _ROLE[state], text
    if audit is not None:
        yield from inserted()
        yield conv, "", None, None


def _typed(batches) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    """The type of the conversations' ids, and the batches."""
    batches = iter(batches)
    first = next(batches, None)
    return (first.column("conv_id").type, chain([first], batches)) if first is not None else (None, batches)


def _with_audits(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows in order, before them one of each conversation with its audit as text."""
    head = planned.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    body = rows.select("conv_id", F.lit(True).alias("is_row"), "turn", "role", _digest(F.col("text")), "text")
    return _in_order(head.unionByName(body), "is_row").select("conv_id", "is_row", "role", "text")


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations; place counts from 0, edit is K, R or I."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        out, place = [], 0
        of, batches = _typed(batches)

        def filled():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], of), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], names=["conv_id", "place", "edit", "role", "text"])

        for conv, edit, role, text in _edits(batches):
            if edit:
                out.append((conv, place, edit, role, text))
            place = place + 1 if edit else 0
            if len(out) >= BATCH:
                yield filled()
        if out:
            yield filled()

    return _with_audits(rows, planned).mapInArrow(run, f"conv_id {kind}, place bigint, edit string, role string, text string")


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired rows as ``role:text`` lines, fed as they stream by."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        out, sha, gap = [], hashlib.sha256(), b""
        of, batches = _typed(batches)

        def filled():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], of), pa.array(columns[1], pa.string())], names=["conv_id", "repaired_sha256"])

        for conv, edit, role, text in _edits(batches):
            if edit:
                sha.update(gap + f"{role}:{text}".encode())
                gap = b"\n"
                continue
            out.append((conv, sha.hexdigest()))
            sha, gap = hashlib.sha256(), b""
            if len(out) >= BATCH:
                yield filled()
        if out:
            yield filled()

    return _with_audits(rows, planned).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def report(rows: DataFrame, original: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of original.

    Rows are normalised ones, ordered by turn (nulls first), ties by role and then by the digest
    of the text. Null ids are one conversation; null roles and texts are one blank; a row equal in
    role and text to an earlier one is a duplicate, so repeated rows are deleted but for one. A
    conversation without rows, like each in an empty table, has zeros, an empty audit and the hash
    of nothing. Other columns, whatever their names, are left out.
    """
    planned = written_table(plans(rows), "plans")
    named = planned.join(digests(rows, planned).withColumnRenamed("conv_id", "_same"), F.col("conv_id").eqNullSafe(F.col("_same"))).drop("_same")
    ids = original.select(F.col(id_col).alias("_id")).distinct()
    joined = ids.join(named, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select(
        F.col("_id").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
