import hashlib
import random
import re
import zlib

from revlens.llm import conversations as cv
from revlens.llm import queries

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damage(rows):
    """The faults of the contract, by plain loops; rows: (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows, wrong, k=0, state="", free=2):
    """(cost, audit, lines) of every way to edit the rows from k on, with at most two insertions in a row."""
    nexts = "a" if state == "u" else "u"
    name = {"u": "user", "a": "assistant"}[nexts]
    if k == len(rows) and state in ("", "a"):
        yield 0, "", ()
    if free:
        for c, a, r in all_repairs(rows, wrong, k, nexts, free - 1):
            yield c + 2, "I" + a, (f"{name}:", *r)
    if k < len(rows):
        for c, a, r in all_repairs(rows, wrong, k + 1, state):
            yield c + 3, "D" + a, r
        if wrong[k] not in ("blank", "duplicate"):
            late, role, text = int(wrong[k] == "truncated"), rows[k][2], rows[k][3]
            for c, a, r in all_repairs(rows, wrong, k + 1, nexts):
                yield c + late + 2, "R" + a, (f"{name}:{text}", *r)
            if role[:1] == nexts or (role[:1] == "s" and state == ""):
                for c, a, r in all_repairs(rows, wrong, k + 1, role[0]):
                    yield c + late, "K" + a, (f"{role}:{text}", *r)


def plain(rows):
    """The report of one conversation."""
    rows = in_order(rows)
    wrong, turns = faults(rows), [r[1] for r in rows if r[1] is not None]
    cost, audit, lines = min(all_repairs(rows, wrong), key=lambda x: x[:2]) if len(rows) <= 4 else split(rows, wrong)
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [wrong.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def split(rows, wrong):
    """As all_repairs, but the best of each (place, state) only; all_repairs on short rows shows that both agree."""
    best = {(len(rows), ""): (0, "", ()), (len(rows), "a"): (0, "", ())}
    for k in range(len(rows), -1, -1):
        if k < len(rows):
            for state in ("", "s", "u", "a"):
                tail = [best[k + 1, s] for s in ("", "s", "u", "a")]
                found = []
                nexts = "a" if state == "u" else "u"
                name = {"u": "user", "a": "assistant"}[nexts]
                at = dict(zip(("", "s", "u", "a"), tail))
                c, a, r = at[state]
                found.append((c + 3, "D" + a, r))
                if wrong[k] not in ("blank", "duplicate"):
                    late, role, text = int(wrong[k] == "truncated"), rows[k][2], rows[k][3]
                    c, a, r = at[nexts]
                    found.append((c + late + 2, "R" + a, (f"{name}:{text}", *r)))
                    if role[:1] == nexts or (role[:1] == "s" and state == ""):
                        c, a, r = at[role[0]]
                        found.append((c + late, "K" + a, (f"{role}:{text}", *r)))
                best[k, state] = min(found, key=lambda x: x[:2])
        for _ in range(2):
            for state in ("", "s", "u", "a"):
                nexts = "a" if state == "u" else "u"
                if (k, nexts) in best:
                    c, a, r = best[k, nexts]
                    more = (c + 2, "I" + a, (f"{'user' if nexts == 'u' else 'assistant'}:", *r))
                    best[k, state] = min(best.get((k, state), more), more, key=lambda x: x[:2])
    return best[0, ""]


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r))
    return out


def got_of(df):
    return {r["conv_id"]: tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def some_rows(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["One.", "Two!", "three", "Four? \n", " \t", "", None, "é.", "x" * 50, f"{rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def test_all_ways_of_short_conversations(spark):
    rows = some_rows()
    df = cv.normalised(spark.createDataFrame(rows, SCHEMA))
    got = got_of(cv.report(df, df))
    for conv, own in by_conversation([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]).items():
        assert got[conv] == plain(own), own
        assert split(in_order(own), faults(in_order(own)))[:2] == got[conv][5:7]


def test_query_on_the_given_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = got_of(queries.op12_conversation_repair(spark, SF))
    hurt = by_conversation(damage(rows))
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == (plain(hurt[conv]) if conv in hurt else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())), conv


def test_long_repeated_and_odd_rows(spark):
    long = [(7, k, ("user", "assistant")[k % 2] if k % 50 else "tool", f"text {k % 400}{'.' * (k % 3)}") for k in range(3000)]
    rows = [*long, (None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (8, 1, "user", "y" * 200_000), (9, None, "system", "s.")]
    df = cv.normalised(spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", digest int, audit string"))
    got = got_of(cv.report(df, df))
    for conv, own in by_conversation([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]).items():
        assert got[conv] == plain(own)
    assert got[9][5:7] == (3, "D") and len(got) == 4


def test_repaired_rows_follow_the_grammar(spark):
    df = cv.normalised(spark.createDataFrame(some_rows(100, 3), SCHEMA))
    done = by_conversation([(r["conv_id"], r["place"], r["role"], r["text"]) for r in cv.repaired(df, cv.plans(df)).collect()])
    for own in done.values():
        own.sort(key=lambda r: r[1])
        assert [r[1] for r in own] == list(range(len(own))) and re.fullmatch("s?(ua)+", "".join(r[2][0] for r in own))


def test_empty_and_all_dropped(spark):
    none = cv.normalised(spark.createDataFrame([], SCHEMA))
    assert cv.report(none, none).collect() == [] and cv.repaired(none, cv.plans(none)).collect() == []
    ids = spark.createDataFrame([(1,), (None,), (1,)], "conv_id bigint")
    assert got_of(cv.report(none, ids)) == {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for k in (1, None)}


def test_automaton_is_small_and_shared():
    dawg, rng = cv.Automaton(), random.Random(2)
    for _ in range(300):
        node = dawg.end
        for symbol in rng.choices("xsuaoSUAO", k=50):
            node, _ = dawg.before(symbol, node)
    assert len(dawg.nodes) < 200
