"""Best-fit packing of documents into sequences by bin completion.

Documents that are longer than a sequence are cut into whole sequences (the first piece may be
shorter); all else is packed whole.  What a packing needs to know of the corpus is how many pieces
there are of each length, a table of at most ``room`` rows whatever the corpus:

1. One pass encodes the documents and writes the narrow table of pieces, each with its task and its
   number among the task's pieces of that length.
2. Pieces are counted by task and length, and by length.
3. ``plan`` packs the counts.  Best-fit decreasing gives the first incumbent; sequences that are filled
   alike are one pattern with a count.  Where it needs more sequences than the waste bound allows,
   bin completion searches on: it takes the largest length left, tries the undominated fillings of the
   rest of its sequence in order of waste, and leaves a branch once the waste so far and that which
   its lengths cannot avoid is what the incumbent has.  Equal fillings are made at once while there
   are many.  ``NODES`` bounds the search; the best incumbent is the result.
4. Every piece finds its place by its rank among the pieces of its length: the counts of the tasks
   before, plus its own number.  The patterns' ranges of ranks are searched in each task, so no piece is
   shuffled to another and equal lengths (a third of all, if need be) spread evenly.

Defined results: a null text is empty; repeated rows are packed each for itself; an empty table gives
no pieces; a document without tokens still has its end id; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pertinax.llm.bpe import SPELLING, slices
from pertinax.llm.common import col, map_batches, worker_state
from pertinax.session import written

#: States that the search may visit, and fillings tried in one.
NODES = 10_000
FILLINGS = 12
#: Subsets looked at for the fillings of one state.
LOOKS = 2_000
#: Equal fillings are made one by one once so few pieces are left.
FEW = 64

Pattern = tuple[tuple[int, int], ...]        # (length, how often), longest first


# ------------------------------------------------------------------ bounds and best fit

def waste_bound(counts: dict[int, int], room: int) -> int:
    """A number of sequences that no packing can do without: pieces over ``room - small`` share with
    none of ``small`` or more, those over half a sequence not with each other."""
    have = np.zeros(room + 2, np.int64)
    for length, n in counts.items():
        have[length] += n
    size = np.arange(room + 2)
    volume = np.concatenate([[0], np.cumsum(have * size)])      # of lengths below
    number = np.concatenate([[0], np.cumsum(have)])
    half = room // 2
    small = np.arange(1, half + 1)
    alone = number[-1] - number[room - small + 1]
    large = number[room - small + 1] - number[half + 1]
    free = large * room - (volume[room - small + 1] - volume[half + 1])
    rest = volume[half + 1] - volume[small] - free
    return int(max(-(-volume[-1] // room), *(alone + large + np.maximum(0, -(-rest // room)))))


def best_fit(counts: dict[int, int], room: int) -> Counter:
    """Best-fit decreasing on counts: ``pattern -> sequences``."""
    open_: dict[int, Counter] = {}          # room left -> patterns
    for length in sorted(counts, reverse=True):
        left = counts[length]
        moved: list[tuple[int, Pattern, int]] = []
        for free in sorted(f for f in open_ if f >= length):
            each = free // length            # the tightest sequence stays the tightest until full
            for pattern in list(open_[free]):
                if not left:
                    break
                take = min(open_[free][pattern], left // each)
                if take:
                    moved.append((free - each * length, pattern + ((length, each),), take))
                    left -= take * each
                    open_[free][pattern] -= take
                if left and left < each and open_[free][pattern]:
                    moved.append((free - left * length, pattern + ((length, left),), 1))
                    open_[free][pattern] -= 1
                    left = 0
                if not open_[free][pattern]:
                    del open_[free][pattern]
            if not open_[free]:
                del open_[free]
            if not left:
                break
        each = room // length
        if left >= each:
            moved.append((room - each * length, ((length, each),), left // each))
        if left % each:
            moved.append((room - left % each * length, ((length, left % each),), 1))
        for free, pattern, n in moved:
            open_.setdefault(free, Counter())[pattern] += n
    out = Counter()
    for patterns in open_.values():
        out.update(patterns)
    return out


# ------------------------------------------------------------------ bin completion

def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Can the pieces of ``b`` be put into the places that the pieces of ``a`` take?  Then ``a`` leaves
    the easier rest."""
    if len(a) > len(b) or sum(a) < sum(b):
        return False
    free = sorted(a)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for k, f in enumerate(free):
            if f >= b[i] and f not in tried:
                tried.add(f)
                free[k] -= b[i]
                if place(i + 1):
                    return True
                free[k] = f
        return False

    return place(0)


def fillings(counts: dict[int, int], lengths: list[int], free: int, waste: int) -> list[tuple[int, ...]]:
    """Undominated sets of pieces for ``free`` places that leave at most ``waste`` of them, tightest
    first.  ``lengths`` are those in ``counts``, ascending."""
    if counts.get(free):
        return [(free,)]                     # fills it in one: dominates all others
    found: list[tuple[int, ...]] = []
    looks = 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(free, bisect_left(lengths, free + 1) - 1, ())]
    while stack and looks < LOOKS:
        looks += 1
        room, at, chosen = stack.pop()
        while at >= 0 and (lengths[at] > room or chosen.count(lengths[at]) >= counts[lengths[at]]):
            at -= 1
        if at < 0:
            if room <= waste:
                found.append(chosen)
                if room == 0 and len(found) >= FILLINGS:
                    break
            continue
        stack.append((room, at - 1, chosen))                     # without one more of this length
        stack.append((room - lengths[at], at, chosen + (lengths[at],)))
    smallest = lengths[0] if lengths else free + 1
    whole = [f for f in set(found) if free - sum(f) < smallest or not any(
        counts[x] > f.count(x) and x <= free - sum(f) for x in lengths[:bisect_left(lengths, free - sum(f) + 1)])]
    whole.sort(key=lambda f: (free - sum(f), [-x for x in f]))
    out: list[tuple[int, ...]] = []
    for f in whole[:4 * FILLINGS]:
        if not any(dominates(o, f) for o in out):
            out.append(f)
        if len(out) == FILLINGS:
            break
    return out


def complete(counts: dict[int, int], room: int, incumbent: Counter, nodes: int = NODES) -> Counter:
    """Bin completion by depth-first branch and bound; returns the incumbent or a packing with fewer
    sequences."""
    total = sum(k * n for k, n in counts.items())
    target = waste_bound(counts, room)
    best, best_n = incumbent, sum(incumbent.values())

    def options(rest: dict[int, int], wasted: int):
        largest = max(rest)
        lengths = sorted(rest)
        spare = (best_n - 1) * room - total - wasted             # waste a better packing may still have
        if spare < 0:
            return iter(())
        rest[largest] -= 1
        few = sum(rest.values()) < FEW
        tried = fillings(rest, [x for x in lengths if rest[x]], room - largest, spare)
        rest[largest] += 1

        def moves():
            for f in tried:
                need = Counter((largest, *f))
                times = 1 if few else min(rest[x] // n for x, n in need.items())
                yield need, max(times, 1), room - largest - sum(f)
        return moves()

    rest = {k: n for k, n in counts.items() if n}
    if not rest or best_n <= target:
        return best
    path: list[tuple[Counter, int, int]] = []
    wasted, used = 0, 0
    stack = [options(rest, 0)]
    while stack and nodes > 0 and best_n > target:
        move = next(stack[-1], None)
        if move is None:
            stack.pop()
            if path:
                need, times, waste = path.pop()
                for x, n in need.items():
                    rest[x] = rest.get(x, 0) + n * times
                wasted, used = wasted - waste * times, used - times
            continue
        nodes -= 1
        need, times, waste = move
        for x, n in need.items():
            rest[x] -= n * times
            if not rest[x]:
                del rest[x]
        path.append(move)
        wasted, used = wasted + waste * times, used + times
        if not rest:
            if used < best_n:
                best, best_n = Counter(), used
                for n_, t_, _ in path:
                    best[tuple(sorted(n_.items(), reverse=True))] += t_
            stack.append(iter(()))
        elif used + (waste_bound(rest, room) if len(rest) < 64 or len(path) % 16 == 0
                     else -(-sum(k * n for k, n in rest.items()) // room)) >= best_n:
            stack.append(iter(()))
        else:
            stack.append(options(rest, wasted))
    return best


def plan(counts: dict[int, int], room: int, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences are filled by each, for all pieces of ``counts``."""
    counts = {int(k): int(n) for k, n in counts.items() if n}
    if any(not 0 < k <= room for k in counts):
        raise ValueError("a piece is longer than a sequence")
    return sorted(complete(counts, room, best_fit(counts, room), nodes).items(), reverse=True)


class Places:
    """Rank among the pieces of a length -> sequence and offset."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        given: Counter = Counter()
        first = 0
        for pattern, n in patterns:
            offset = 0
            for length, each in pattern:
                # pieces given[length] ... are dealt to the n sequences in turn, `each` times over
                ranges.setdefault(length, []).append((given[length], n, first, offset))
                given[length] += n * each
                offset += length * each
            first += n
        self.ranges = {k: np.array(v, np.int64) for k, v in ranges.items()}

    def find(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.ranges[length]
        at = np.searchsorted(table[:, 0], ranks, "right") - 1
        start, n, first, offset = table[at].T
        within = ranks - start
        return first + within % n, offset + within // n * length


# ------------------------------------------------------------------ encoding

#: Longest run without (or of) white space that the fast encoder is given.
RUN = 4_000


class ByteEncoder:
    """The ids that the tokenizers library gives for a byte-level file.  Its merges are replayed by
    the faster of the two installed libraries where the text has no special token and no very long
    run; all other texts go to the tokenizers library itself."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, self.fast = spec.get("pre_tokenizer") or {}, None
        plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                 and not spec.get("normalizer") and not spec.get("post_processor")
                 and spec["model"].get("type") == "BPE" and not spec["model"].get("ignore_merges"))
        if plain:
            import public_tokenizers
            import tiktoken
            byte = {chr(c): b for b, c in SPELLING.items()}
            special = {t["content"] for t in spec.get("added_tokens") or []}
            byte |= {chr(b): b for b in range(256) if b not in SPELLING}
            ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.long_run = re.compile(r"\S{%d}|\s{%d}" % (RUN, RUN))

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or (len(text) >= RUN and self.long_run.search(text)):
            return np.array(self.slow().encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def slow(self):
        """The library's tokenizer, loaded once a text needs it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library


def encoder(path: str) -> ByteEncoder:
    """The encoder of a file, loaded once per Python worker."""
    state = worker_state("packing")
    if path not in state:
        state[path] = ByteEncoder(path)
    return state[path]


# ------------------------------------------------------------------ on Spark

def pieces(docs: DataFrame, path: str, room: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, written: ``doc_id, piece, start, length, ids_crc32``, the task they
    come from (``block``), their number among its pieces of that length (``nth``) and, if asked for,
    ``ids``."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    kinds = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType(),
             "block": T.IntegerType(), "nth": T.LongType()}
    if with_ids:
        kinds["ids"] = T.BinaryType()
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType),
                           *[T.StructField(n, k) for n, k in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, seen, e = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64), encoder(path)
        for batch in batches:
            for part, texts in slices(batch):
                of, made = [], []
                for row, text in enumerate(texts):
                    ids = np.append(e.encode(text), np.array([end_id], "<u4"))
                    at = 0
                    for k, size in enumerate(cut(len(ids), room)):
                        mine = ids[at:at + size].tobytes()
                        of.append(row)
                        made.append((k, at, size, zlib.crc32(mine), block, int(seen[size])) + ((mine,) if with_ids else ()))
                        seen[size] += 1
                        at += size
                columns = [pa.array(c, t) for c, t in zip(zip(*made), [
                    pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()])]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *columns],
                                                 names=schema.fieldNames())

    return written(map_batches(rows, run, schema), "pieces")


def cut(n: int, room: int) -> list[int]:
    """Lengths of the pieces of a document: only one longer than a sequence is cut."""
    if n <= room:
        return [n]
    first = n % room
    return ([first] if first else []) + [room] * (n // room)


def pack(docs: DataFrame, path: str, room: int = 1024, end_id: int = 2, nodes: int = NODES, **names) -> DataFrame:
    """Every piece with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    table = pieces(docs, path, room, end_id, **names)
    counts = written(table.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # at most ``room`` rows
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan(sizes, room, nodes))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("block").alias("__b"), F.col("length").alias("__l"),   # one row a task and length
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__s"))
    ranked = table.join(shift, (F.col("block") == F.col("__b")) & (F.col("length") == F.col("__l"))).select(
        *[c for c in table.columns if c not in ("block", "nth")], (F.col("nth") + F.col("__s")).alias("rank"))
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            values, first = np.unique(lengths[order], return_index=True)
            for length, rows in zip(values.tolist(), np.split(order, first[1:])):
                sequence[rows], offset[rows] = places.find(length, ranks[rows])
            kept = [batch.column(k) for k, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=schema.fieldNames())

    return map_batches(ranked, run, schema)
