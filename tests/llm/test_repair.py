"""Conversation repair against a search of all edits, with blocks so small that conversations reach over many."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import repair

SPACES = " \t\n\x0b\x0c\r"


def sort_key(r):
    return (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(r[3].encode()).hexdigest())


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def slow_faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(SPACES)
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none")
        seen.add((role, text))
    return found


def slow_audit(rows, faults):
    """Every edit string, up to two insertions in a place."""
    inserts = [(x, "I" * len(x), 3 * len(x)) for k in range(3) for x in itertools.product("ua", repeat=k)]
    paths = [("", "", 0)]
    for row, fault in zip([*rows, None], [*faults, None]):
        paths = [(roles + "".join(x), label + y, cost + c) for roles, label, cost in paths for x, y, c in inserts]
        if row is None:
            break
        more = 3 if fault == "truncated" else 0
        edits = [("", "D", 4)]
        if fault in ("none", "truncated"):
            edits += [(row[2][:1] or "-", "K", more), ("u", "R", 3 + more), ("a", "R", 3 + more)]
        paths = [(roles + x, label + y, cost + c) for roles, label, cost in paths for x, y, c in edits]
        paths = [p for p in paths if re.fullmatch("s?(ua)*u?", p[0])]
    cost, label, roles = min((c, y, x) for x, y, c in paths if re.fullmatch("(s?(ua)+)?", x))
    lines, k, nth = [], 0, 0
    for x in label:
        name = {"u": "user", "a": "assistant"}.get(roles[nth] if nth < len(roles) else "")
        if x != "D":
            lines.append(f"{rows[k][2] if x == 'K' else name}:{'' if x == 'I' else rows[k][3]}")
            nth += 1
        k += x != "I"
    return cost, label, "\n".join(lines)


def slow(conv, rows):
    rows = sorted(rows, key=sort_key)
    faults = slow_faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = sum((a[2][:1], b[2][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:]))
    cost, audit, text = slow_audit(rows, faults)
    return (conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    found = []
    for conv in range(60):
        for _ in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Good.", "Good.", "Yes!", "cut off", "cut", " \n", "", None, "é漢?", "ends here. \t", f"word {rng.random()}."])
            found.append((conv, rng.choice([None, 0, 1, 2, 3, 7]), role, text))
    return found + [(None, 1, "user", "No id."), (None, 2, "assistant", "None."), (None, None, "user", "x" * 30_000)]


@pytest.mark.parametrize("bits", [(8, 6), (1, 1), (0, 1)])
def test_repair_is_the_slow_form(spark, rows, bits):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({x: F.lit(x) for x in ("pos", "_conv", "node", "fault", "audit", "label")})
    got = {r["conv_id"]: tuple(r) for r in repair.audit_conversations(repair.damage(df), df, block_bits=bits[0], fan_bits=bits[1]).collect()}
    damaged = slow_damage(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = [r for r in damaged if r[0] == conv]
        assert got[conv] == slow(conv, mine), mine


def test_one_long_conversation(spark):
    """Over all blocks and levels the same as in one block."""
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", "cut", f"Word {k}."])) for k in range(700)] + [(2, 0, "user", "Alone."), (0, 3, "system", "Be good.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    small, large = (sorted(map(tuple, repair.audit_conversations(df, df, block_bits=b, fan_bits=f).collect())) for b, f in ((3, 2), (12, 2)))
    assert small == large and len(small[1][7]) >= 700


def test_pieces_compose_like_the_whole():
    rng = random.Random(2)
    machine = repair.Machine()
    for _ in range(30):
        turns = tuple((rng.choice("suax"), rng.choice(["none", "none", "truncated", "blank", "duplicate"])) for _ in range(12))
        whole = [list(r) for r in repair.block_weights(machine, turns)]
        pieces = [[list(r) for r in repair.block_weights(machine, turns[k : k + 3])] for k in range(0, 12, 3)]
        made = pieces[0]
        for piece in pieces[1:]:
            made = repair.compose(made, piece)
        assert made == whole
        states = repair.states_between(pieces, 0, 3)
        assert "".join(p[a][b][1] for p, (a, b) in zip(pieces, states)) == whole[0][3][1]


def test_grammars_must_be_told_apart_by_labels():
    with pytest.raises(ValueError):
        repair.Machine(arcs=((0, "u", 1), (0, "a", 1)), finals=(1,))
    with pytest.raises(ValueError):
        repair.Machine(insert=0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert repair.audit_conversations(df, df).count() == 0
    one = spark.createDataFrame([(5, 1, "user", "x")], df.schema)
    assert tuple(repair.audit_conversations(df, one).first()) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
