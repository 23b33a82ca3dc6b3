"""Conversation repair against an exhaustive search over lists of edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from pertinax.llm import conversation_repair as C
from pertinax.llm.catalog import damaged, repair_report

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def exhaustive(rows, most=4):
    """Every choice of inserts (up to ``most`` in a place) and edits; roles of rerolled and inserted rows free."""
    best = None
    for gaps in product(range(most + 1), repeat=len(rows) + 1):
        for letters in product("DKR", repeat=len(rows)):
            cost, audit, slots = 0, "", []
            for i, n in enumerate(gaps):
                cost, audit = cost + 5 * n, audit + "I" * n
                slots += ["ua"] * n
                if i < len(rows):
                    (initial, fault), letter = rows[i], letters[i]
                    audit += letter
                    if letter == "D":
                        cost += 2
                        continue
                    if fault in (C.BLANK, C.DUPLICATE):
                        cost += 10 ** 6
                    cost += (5 if fault == C.CUT else 0) + (letter == "R")
                    slots.append(initial if letter == "K" else "ua")
            if best and (cost, audit) >= best:
                continue
            if len(slots) <= 9 and any(GOOD.fullmatch("".join(w)) for w in product(*slots)) and all(slots):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_agenda_is_lightest(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.choice([C.NONE, C.NONE, C.CUT, C.BLANK, C.DUPLICATE]))
            for _ in range(rng.randint(0, 4))]
    got = min(C.lightest(rows, C.START, C.FINAL).values())
    assert got == exhaustive(rows, 2)
    assert C.lightest(rows, C.START, C.FINAL, first_only=True).popitem()[1] == got


@pytest.mark.parametrize("seed", range(20))
def test_chained_segments_are_the_whole(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["s", "u", "a", "u", "a", "x"]), rng.choice([0, 0, 0, C.CUT, C.CUT, C.BLANK])) for _ in range(60)]
    whole = min(C.lightest(rows, C.START, C.FINAL).values())
    c, parts, at = C.Chained(1), [], 0
    while at < len(rows):
        n = rng.randint(1, 9)
        span = C.measure([{"initial": i, "fault": f, "turn": None} for i, f in rows[at:at + n]]) | {"segment": at}
        parts += c.add(span)
        at += n
    cost, rest = c.end()
    assert (cost, "".join(a for _, _, a in parts + rest)) == whole
    assert sum(n for _, n, _ in parts + rest) == len(rows)


def brute(rows):
    """The query in plain Python, with a dynamic program over (state, edits)."""
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    out = {}
    for conv, mine in convs.items():
        after = []
        for _, turn, role, text in mine:
            harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            role = "user" if harm == 4 else role
            after += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in after:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(C.BLANK if not said else C.DUPLICATE if (role, text) in seen else
                          C.CUT if said[-1] not in ".!?" else C.NONE)
            seen.add((role, text))
        initials = [r[1][:1] for r in after]
        turns = {t for t, _, _ in after if t is not None}
        table = {"": (0, "", ())}               # grammar state by last initial: cost, audit, rows
        for i in range(len(after) + 1):
            for _ in range(3):                  # inserts
                for state, (cost, audit, kept) in list(table.items()):
                    to = "a" if state == "u" else "u"
                    name = "user" if to == "u" else "assistant"
                    new = (cost + 5, audit + "I", kept + (f"{name}:",))
                    if to not in table or new[:2] < table[to][:2]:
                        table[to] = new
            if i == len(after):
                break
            following, (_, role, text), fault, initial = {}, after[i], faults[i], initials[i]
            for state, (cost, audit, kept) in table.items():
                moves = [(2, "D", state, ())]
                if fault not in (C.BLANK, C.DUPLICATE):
                    extra = 5 if fault == C.CUT else 0
                    to = "a" if state == "u" else "u"
                    name = "user" if to == "u" else "assistant"
                    moves.append((1 + extra, "R", to, (f"{name}:{text}",)))
                    if initial == to or (initial == "s" and state == ""):
                        moves.append((extra, "K", initial, (f"{role}:{text}",)))
                for price, letter, to, add in moves:
                    new = (cost + price, audit + letter, kept + add)
                    if to not in following or new[:2] < following[to][:2]:
                        following[to] = new
            table = following
        cost, audit, kept = min(table[s] for s in ("", "a") if s in table)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(C.BLANK),
                     faults.count(C.DUPLICATE), faults.count(C.CUT),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def compare(df):
    got = repair_report(df).collect()
    want = brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def odd_rows():
    rng = random.Random(8)
    rows = [(None, None, None, None), (None, 1, "user", "Who?"), (1, 5, None, "x."), (2, None, "user", " \t"), (2, None, "assistant", "ok."),
            (3, 1, "", "no role."), (3, 9, "system", "late"), (4, 1, "user", "z" * 200_000), (4, 2, "assistant", "é" * 10 + "!"),
            (5, 1, "user", "same."), (5, 1, "user", "same."), (5, 1, "assistant", "other."), (5, 1, "user", "also.")]
    for conv in range(10, 150):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn if rng.random() < .95 else None, rng.choice(["user", "assistant"]) if rng.random() < .3 else
                         ("user", "assistant")[turn % 2] if turn or rng.random() < .8 else "system",
                         rng.choice(["Hello there.", "Why?", "cut off", "", "  ", "a.\nb!", "End. "]) + (str(turn) + "." if rng.random() < .7 else "")))
    return rows


def test_query_against_plain_python(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "1 AS spot", "'k' AS kind", "2 AS segment", "3 AS fault").repartition(5)
    compare(df)


def test_hot_conversation_spreads_over_segments(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT_BITS", 3)
    rng = random.Random(4)
    hot = [(7, i, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Yes.", "No.", f"{i}!", "cut", ""]))
           for i in range(700)] + [(7, 3, "user", "again.")] * 50
    df = spark.createDataFrame(hot + odd_rows()[:40], SCHEMA).repartition(4)
    compare(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(df)                          # now in parts of different range partitions
        order = C.ordered(damaged(df))
        assert order.where("conv_id = 7").select(F.shiftright("spot", 33)).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_rows(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    rows = C.repaired(df).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["at"])):
        by[r["conv_id"]].append(r["role"][:1])
    assert all(GOOD.fullmatch("".join(v)) for v in by.values())


def test_empty_table(spark):
    assert repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
