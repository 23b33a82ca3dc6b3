"""Conversation structure repair by Knuth's lightest-derivation agenda.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.  Rows are kept
(cost 0), rerolled to user or assistant (1) or deleted (2; required for blank and repeated rows),
and rows without text are inserted (5); a truncated row that stays adds 5.  Of all cheapest lists of
edits the one whose initials come first in ASCII order is taken.

The repair is a weighted deduction system.  An item ``[i, state]`` says that the first ``i`` rows have
been edited and the roles so far leave the grammar in ``state``; each edit is a rule from one item to
the next.  A rule is superior and monotone in ``(cost, audit)``: it makes both grow, and of two
derivations of one item the lighter stays lighter under any rule (both edit the same rows, so neither
audit begins with the other unless their costs differ).  So an agenda that pops items by ``(cost,
audit)`` pops each item first with its lightest derivation, and the goal is final once popped.

1. Rows are dealt to range partitions of (conversation, turn, role, text) with a tie-breaker and
   written, numbered by ``spot``.  A hot conversation spreads over many partitions.
2. Repeated rows are those that are not the first of their (conversation, role, text): an aggregate and
   a lookup by spot, so hot texts spread too.
3. Segments, at most ``SEGMENT`` rows of one conversation that stand side by side, run the agenda
   from each state they can be entered in: lightest derivations from state to state.
4. Segments of a conversation are rules themselves.  They are chained in order, from the start state, as
   a stream: one row a segment, four survivors, of which the part that all agree on is passed on at once.
5. The repaired rows are found by joining edits and rows by spot.  A digest of a whole conversation reads
   them in order as a stream (a hash has to), with bounded memory.

Defined results: null role and text are one space, a null turn comes first, a null conversation id is
a conversation of its own; rows that tie in turn are taken by role, the first 64 characters of the
text and its hash; a role without characters has no initial and can only be rerolled or deleted; a conversation without rows needs no
edits; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from pertinax.llm.common import map_batches
from pertinax.session import written

#: Rows of a conversation that one agenda works on: a power of two, by the low bits of ``spot``.
SEGMENT_BITS = 8
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar: nothing yet, system read, user read, assistant read.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: State -> the state after a user or assistant row, whichever the grammar takes there.
TURN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: First faults of a row.
NONE, BLANK, DUPLICATE, CUT = range(4)


def kept(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role; None if the grammar does not take it there."""
    if initial == "s":
        return SYSTEM if state == START else None
    after = TURN[state]
    return after if initial == ("u" if after == USER else "a") else None


def rules(state: int, row: tuple[str, int] | None) -> Iterator[tuple[int, int, str, int]]:
    """Edits of an item: ``(rows consumed, cost, initial, next state)``."""
    yield 0, INSERT, "I", TURN[state]
    if row is None:
        return
    initial, fault = row
    yield 1, DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if fault == CUT else 0
    if (after := kept(state, initial)) is not None:
        yield 1, extra, "K", after
    yield 1, REROLE + extra, "R", TURN[state]


def lightest(rows: list[tuple[str, int]], entry: int, goals: tuple[int, ...] = (START, SYSTEM, USER, ASSISTANT),
             first_only: bool = False) -> dict[int, tuple[int, str]]:
    """Knuth's agenda over the items of some rows, from ``entry``: the lightest ``(cost, audit)`` per
    state that the grammar can be in behind the last row (``first_only``: of the lightest goal)."""
    agenda, done, out = [(0, "", 0, entry)], set(), {}
    end = len(rows)
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))                       # popped first with its lightest derivation
        if i == end and state in goals:
            out[state] = (cost, audit)
            if first_only or len(out) == len(goals):
                break
        for used, price, letter, after in rules(state, rows[i] if i < end else None):
            if (i + used, after) not in done:
                heapq.heappush(agenda, (cost + price, audit + letter, i + used, after))
    return out


def chain(survivors: dict[int, tuple[int, str]], segment: dict[int, dict[int, tuple[int, str]]]) -> dict[int, tuple[int, str]]:
    """The lightest derivations behind a segment, from those before it."""
    out = {}
    for state, (cost, audit) in survivors.items():
        for after, (more, text) in segment[state].items():
            key = (cost + more, audit + text)
            if after not in out or key < out[after]:
                out[after] = key
    return out


def agreed(survivors: dict[int, tuple[int, str]]) -> tuple[str, dict[int, tuple[int, str]]]:
    """What all survivors' audits begin with, and the survivors without it."""
    audits = [a for _, a in survivors.values()]
    low, high = min(audits), max(audits)
    n = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    while n and low[n - 1] == "I":    # whole edits of rows: inserts go with the row behind them
        n -= 1
    return low[:n], {s: (c, a[n:]) for s, (c, a) in survivors.items()}


# ------------------------------------------------------------------ on Spark

def ordered(rows: DataFrame) -> DataFrame:
    """``conv_id, spot, turn, role, text`` of all rows in order; ``spot`` grows along each conversation."""
    filled = rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
                         F.monotonically_increasing_id().alias("tie"))
    # keys are sampled to the driver for the choice of ranges, so they hold no whole texts
    key = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.sha2("text", 256), "tie"]
    dealt = filled.repartitionByRange(*key).sortWithinPartitions(*key)
    return written(dealt.select("conv_id", F.monotonically_increasing_id().alias("spot"), "turn", "role", "text"),
                   "conversations")


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, spot, turn, initial, fault`` of ordered rows, without the texts."""
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    tail = F.substring(trimmed, -1, 1)
    narrow = rows.select("conv_id", "spot", "turn", F.substring("role", 1, 1).alias("initial"),
                         F.unhex(F.sha2(F.concat("role", F.lit("\u0000"), "text"), 256)).alias("digest"),
                         F.length("role").alias("width"),
                         (trimmed == "").alias("blank"), (~tail.isin(".", "!", "?")).alias("cut"))
    first = narrow.groupBy("conv_id", "width", "digest").agg(F.min("spot").alias("first")).select(
        F.col("first").alias("__first"))
    marked = narrow.join(first, F.col("spot") == F.col("__first"), "left")
    fault = (F.when(F.col("blank"), BLANK).when(F.col("__first").isNull(), DUPLICATE)
             .when(F.col("cut"), CUT).otherwise(NONE))
    return marked.select("conv_id", "spot", "turn", "initial", fault.alias("fault"))


_SPAN = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("blank", T.LongType()), T.StructField("duplicate", T.LongType()),
    T.StructField("truncated", T.LongType()), T.StructField("illegal", T.LongType()),
    T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()),
    T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("turns", T.LongType()),
    T.StructField("paths", T.StringType())])


def measure(rows: list[dict]) -> dict:
    """Counts and lightest derivations of one segment's rows, in order."""
    pairs = [(r["initial"], r["fault"]) for r in rows]
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    faults = [f for _, f in pairs]
    paths = ";".join(f"{s},{t},{c},{a}" for s in range(4) for t, (c, a) in lightest(pairs, s).items())
    return {"n": len(rows), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE),
            "truncated": faults.count(CUT),
            "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:])),
            "head": pairs[0][0], "tail": pairs[-1][0], "low": turns[0] if turns else None,
            "high": turns[-1] if turns else None, "turns": len(turns), "paths": paths}


def segments(faults: DataFrame) -> DataFrame:
    """One row per segment: ``conv_id, segment``, its counts and the lightest derivations through it."""
    rows = faults.groupBy("conv_id", F.shiftright("spot", SEGMENT_BITS).alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("spot", "turn", "initial", "fault"))).alias("rows"))

    schema = T.StructType([rows.schema["conv_id"], rows.schema["segment"], *_SPAN.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [measure(r) for r in batch.column(2).to_pylist()]
            made = pa.Table.from_pylist(spans, schema=pa.schema([
                (f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in _SPAN.fields]))
            columns = [batch.column(0), batch.column(1), *[c.combine_chunks() for c in made.columns]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return map_batches(rows, run, schema)


def _paths(text: str) -> dict[int, dict[int, tuple[int, str]]]:
    out: dict = {}
    for part in text.split(";"):
        s, t, c, a = part.split(",")
        out.setdefault(int(s), {})[int(t)] = (int(c), a)
    return out


class Chained:
    """One conversation while its segments come in."""

    def __init__(self, conv):
        self.conv, self.survivors, self.cost = conv, {START: (0, "")}, 0
        self.open, self.done = [], ""       # segments whose edits are not all known; audit so far
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.tail = self.low = self.high = None

    def add(self, span: dict) -> list[tuple[int, int, int, str]]:
        for name in ("n", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + span[name])
        if self.tail is not None:
            self.illegal += self.tail + span["head"] not in ("su", "ua", "au")
        self.tail = span["tail"]
        if span["low"] is not None:
            if self.high is not None and span["low"] == self.high:
                self.turns -= 1
            self.low = span["low"] if self.low is None else self.low
            self.high = span["high"]
        self.survivors = chain(self.survivors, _paths(span["paths"]))
        self.open.append([span["segment"], span["n"]])
        sure, self.survivors = agreed(self.survivors)
        return self.settle(sure)

    def settle(self, sure: str) -> list[tuple[int, int, int, str]]:
        """Edits that are final, cut at the segments they belong to: ``(segment, rows of it that
        are settled before, rows settled now, audit)``."""
        out = []
        while sure:
            segment = self.open[0]
            taken = rows = 0
            while taken < len(sure) and rows < segment[1]:
                rows += sure[taken] != "I"
                taken += 1
            if rows == segment[1] and len(self.open) == 1 and "I" * (len(sure) - taken) == sure[taken:]:
                taken = len(sure)                   # inserts behind the last row
            if taken:
                out.append((segment[0], rows, sure[:taken]))
            segment[1] -= rows
            sure = sure[taken:]
            if not segment[1] and len(self.open) > 1:
                self.open.pop(0)
        return out

    def end(self) -> tuple[int, list]:
        cost, audit = min(self.survivors[s] for s in FINAL if s in self.survivors)
        return cost, self.settle(audit)

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2 ** 63 - 1)


def repair(spans: DataFrame) -> DataFrame:
    """The chained segments: one row per conversation with ``audit`` parts in order.

    ``conv_id, part, segment, rows, audit, last`` and, on a conversation's last row, its counts."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([spans.schema["conv_id"], T.StructField("part", T.LongType()),
                           T.StructField("segment", T.LongType()), T.StructField("rows", T.LongType()),
                           T.StructField("audit", T.StringType()), T.StructField("last", T.BooleanType()),
                           *[T.StructField(c, T.LongType()) for c in counts]])
    conv_type = to_arrow_type(spans.schema["conv_id"].dataType)

    def close(c: Chained, part: int) -> list[tuple]:
        cost, parts = c.end()
        rows = [(c.conv, part + k, s, n, a, False) + (None,) * 6 for k, (s, n, a) in enumerate(parts)]
        return rows + [(c.conv, part + len(parts), None, 0, "", True, c.gaps(), c.blank, c.duplicate,
                        c.truncated, c.illegal, cost)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, 0
        for batch in batches:
            out = []
            for span in batch.to_pylist():
                if now is None or now.conv != span["conv_id"]:
                    if now is not None:
                        out += close(now, part)
                    now, part = Chained(span["conv_id"]), 0
                for s, n, a in now.add(span):
                    out.append((now.conv, part, s, n, a, False) + (None,) * 6)
                    part += 1
            if out:
                yield table(out)
        if now is not None:
            yield table(close(now, part))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [conv_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.int64()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.fieldNames())

    stream = spans.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return map_batches(stream, run, schema)


def edits(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``conv_id, spot, edit`` of every row: the inserts before it, its own edit and, on the last row of a
    conversation, the inserts behind it."""
    spots = rows.groupBy("conv_id", F.shiftright("spot", SEGMENT_BITS).alias("segment")).agg(
        F.sort_array(F.collect_list("spot")).alias("spots"))
    # a segment's parts in order are its whole audit: at most its rows and the inserts between them
    whole = parts.where(~F.col("last")).groupBy("conv_id", "segment").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    both = spots.alias("s").join(whole.alias("w"), F.col("s.conv_id").eqNullSafe(F.col("w.conv_id"))
                                 & (F.col("s.segment") == F.col("w.segment")))
    cut = F.regexp_extract_all("w.audit", F.lit("(I*[DKR]I*$|I*[DKR])"), 1)
    return both.select(F.col("s.conv_id").alias("conv_id"), F.explode(F.arrays_zip(
        F.col("s.spots").alias("spot"), cut.alias("edit"))).alias("e")).select("conv_id", "e.spot", "e.edit")


def repaired_stream(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """Rows and their edits, each conversation whole and in order within a partition."""
    left = rows.select("conv_id", "spot", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("edit"))
    right = edited.select("conv_id", "spot", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), "edit")
    return left.unionByName(right).repartition("conv_id").sortWithinPartitions("conv_id", "spot", "kind")


class Speaker:
    """Walks a conversation's edits through the grammar and gives the rows that remain."""

    def __init__(self):
        self.state = START

    def turn(self) -> str:
        self.state = TURN[self.state]
        return ROLE[self.state]

    def apply(self, edit: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        for letter in edit:
            if letter == "I":
                yield "I", self.turn(), ""
            elif letter == "R":
                yield "R", self.turn(), text
            elif letter == "K":
                self.state = kept(self.state, role[:1])
                yield "K", role, text


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conversation, is it new, rows that remain)`` for each row of the stream."""
    conv, speaker, edit, started = None, None, "", False
    for batch in batches:
        for r in batch.to_pylist():
            new = not started or r["conv_id"] != conv
            if new:
                conv, speaker, started = r["conv_id"], Speaker(), True
            if r["kind"] == 0:
                edit = r["edit"]
                yield conv, new, ()
            else:
                yield conv, new, list(speaker.apply(edit, r["role"], r["text"]))


def repaired_rows(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, at, edit, role, text``."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("at", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        out, at = [], 0
        for conv, new, remain in _walk(batches):
            at = 0 if new else at
            for edit, role, text in remain:
                out.append({"conv_id": conv, "at": at, "edit": edit, "role": role, "text": text})
                at += 1
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return map_batches(repaired_stream(rows, edited), run, schema)


def repaired_digests(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the hash of ``role:text`` of the repaired rows, newline-joined."""
    schema = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        out, conv, digest, first = [], None, None, True
        for now, new, remain in _walk(batches):
            if new:
                if digest is not None:
                    out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                conv, digest, first = now, hashlib.sha256(), True
            for _, role, text in remain:
                digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
                first = False
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if digest is not None:
            out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return map_batches(repaired_stream(rows, edited), run, schema)


def audits(parts: DataFrame) -> DataFrame:
    """``conv_id``, the counts and the whole ``audit`` of each conversation."""
    return parts.groupBy("conv_id").agg(
        *[F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "").alias("audit"))


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(ordered rows, audit parts, edits)`` of all conversations; rows and parts are written tables."""
    order = ordered(rows)
    faults = with_faults(order)
    parts = written(repair(segments(faults)), "repairs")
    return order, parts, edits(order, parts)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations, row by row."""
    order, _, edited = plan(rows)
    return repaired_rows(order, edited)


def report(rows: DataFrame) -> DataFrame:
    """Per conversation that has rows: counts, cost, audit and the digest of what remains."""
    order, parts, edited = plan(rows)
    a, d = audits(parts), repaired_digests(order, edited)
    return a.join(d.select(F.col("conv_id").alias("__of"), "repaired_sha256"),
                  F.col("conv_id").eqNullSafe(F.col("__of"))).drop("__of")
