"""Repairs against a search over all states, row by row."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product as every

import duckdb
import pytest
from rows import SMALL
from test_llm import named, rows_of

from spanloom.llm import op12_repair as op

ALIVE = re.compile(r"[^\x20\x09-\x0D]")
WANTED = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if key == 1:
            text = ""
        if key == 2:
            text = re.sub("[.!?]", "", text)
        if key == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if key == 0 else 2 if key == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        alive = ALIVE.findall(text)
        out.append("blank" if not alive else "duplicate" if (role, text) in seen else "truncated" if alive[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired rows): the best of each state after each row, by cost and then letters."""
    moves = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    best = {0: (0, "", ())}

    def better(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def inserted(best):
        out = dict(best)
        for _ in range(4):
            for state, (cost, audit, made) in list(out.items()):
                for role, name in (("u", "user"), ("a", "assistant")):
                    if state in moves[role]:
                        better(out, moves[role][state], (cost + 2, audit + "I", made + (f"{name}:",)))
        return out

    for (_, role, text), fault in zip(rows, found):
        after = {}
        for state, (cost, audit, made) in inserted(best).items():
            better(after, state, (cost + 3, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            cut = fault == "truncated"
            if state in moves.get(role[:1], {}):
                better(after, moves[role[0]][state], (cost + cut, audit + "K", made + (f"{role}:{text}",)))
            for r, name in (("u", "user"), ("a", "assistant")):
                if state in moves[r]:
                    better(after, moves[r][state], (cost + 2 + cut, audit + "R", made + (f"{name}:{text}",)))
        best = after
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def plain(rows):
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    out = []
    for conv, own in by_conv.items():
        own = damage(own)
        found = faults(own)
        turns = {t for t, *_ in own if t is not None}
        cost, audit, made = cheapest(own, found)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
                    cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return Counter(out)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def results(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def made_rows(seed, conversations, most):
    chance = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(chance.randint(1, most)):
            turn = chance.choice([turn, turn, turn, turn + 1, None])
            role = chance.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = chance.choice(["Good.", "Well?", "cut", "", " \t", None, "Fine! ", f"Turn {turn}.", "é…", "a\nb.\n"])
            rows += [(conv, turn, role, text)] * chance.choice([1, 1, 1, 1, 2, 3])
    return rows


def test_given_conversations(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall()
    assert results(named(12)(spark, SMALL)) == plain(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_conversations(spark, seed):
    rows = made_rows(seed, 120, 12)
    assert results(op.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_long_conversations_in_many_runs(spark, monkeypatch):
    """Runs, blocks of copies and products of products, at small sizes."""
    rows = made_rows(3, 4, 300) + [(2, 17, "user", "Same."), (3, 5, "assistant", "again")] * 40
    for name, value in (("RUN", 5), ("FAN", 3), ("BLOCK", 4)):
        monkeypatch.setattr(op, name, value)
    assert results(op.repair(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_clashing_columns_and_empty_table(spark):
    from pyspark.sql import functions as F

    rows = made_rows(4, 10, 6)
    names = "first same n k block letter run part place illegal cost audit fault copies nth cells packed".split()
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("extra").alias(n) for n in names))
    assert results(op.repair(frame)) == plain(rows)
    assert op.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_matrices_against_all_edits():
    """Every way to edit runs of up to three rows, and every number of inserts between."""
    known = op.Matrices(["us", "xA"])
    for size in range(4):
        for run in every("suaoSUAOx", repeat=size):
            best = None
            for edits in every("DKR", repeat=size):
                for places in every(range(3), repeat=size + 1):
                    audit, roles, cost, good = "", [""], 0, True
                    for letter, edit, n in zip([*run, None], [*edits, None], places):
                        audit += "I" * n
                        cost += 2 * n
                        roles = [r + "".join(i) for r in roles for i in every("ua", repeat=n)]
                        if letter is None:
                            continue
                        audit += edit
                        good &= not (letter == "x" and edit != "D") and not (letter in "oO" and edit == "K")
                        cost += {"D": 3, "K": 0, "R": 2}[edit] + (edit != "D" and letter in "SUAO")
                        if edit == "K":
                            roles = [r + letter.lower() for r in roles]
                        if edit == "R":
                            roles = [r + i for r in roles for i in "ua"]
                    if good and (best is None or (cost, audit) < best) and any(WANTED.match(r) for r in roles):
                        best = (cost, audit)
            whole = {}
            for (start, end), (cost, rope) in op.product(known.of("".join(run)), op.INSERTS).items():
                if start == op.START and end in (op.START, op.ASSISTANT):
                    op.add(whole, 0, cost, rope)
            assert (whole[0][0], whole[0][1].spelled()) == best, run
        if size == 2:
            break


def test_rules_are_products(spark):
    runs = ["sua" * 3, "suaua", "xxxx", "uxaUA" * 4]
    rules, packed = op.grammar(spark.createDataFrame([(r,) for r in runs], "run string"))
    assert rules
    known, bare = op.Matrices(rules), op.Matrices([])
    for row in packed.collect():
        assert sorted(op.cells(known.of(row.packed))) == sorted(op.cells(bare.of(row.run)))


def test_query_has_the_columns(spark):
    assert set(rows_of(named(12)(spark, SMALL))[0]) == set(COLUMNS)
