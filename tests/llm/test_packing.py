"""Packing against exhaustive search, and the query against the library and the rules of its result."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pertinax.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, room):
    """The fewest sequences, by trying every place for every piece."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k, b in enumerate(bins):
            if b + lengths[i] <= room and b not in bins[:k]:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        place(i + 1, bins + [lengths[i]])

    place(0, [])
    return best


def check_plan(patterns, counts, room):
    used = Counter()
    for pattern, n in patterns:
        assert n > 0 and sum(length * each for length, each in pattern) <= room
        for length, each in pattern:
            used[length] += each * n
    assert used == Counter({k: n for k, n in counts.items() if n})
    return sum(n for _, n in patterns)


@pytest.mark.parametrize("seed", range(40))
def test_few_pieces_take_the_fewest_sequences(seed):
    rng = random.Random(seed)
    room = rng.choice([20, 50, 100])
    lengths = [rng.randint(1, room) if rng.random() < .3 else rng.randint(room // 5, room // 2) for _ in range(rng.randint(1, 12))]
    counts = Counter(lengths)
    n = check_plan(packing.plan(counts, room), counts, room)
    assert packing.waste_bound(counts, room) <= n == fewest(lengths, room)


def test_search_beats_best_fit():
    """Pieces that best-fit decreasing puts into more sequences than needed."""
    rng, beaten = random.Random(3), 0
    for _ in range(3000):
        lengths = [rng.randint(15, 50) for _ in range(9)]
        counts = Counter(lengths)
        fit = packing.best_fit(counts, 100)
        if sum(fit.values()) > packing.waste_bound(counts, 100) and sum(fit.values()) > fewest(lengths, 100):
            beaten += 1
            assert check_plan(packing.plan(counts, 100), counts, 100) == fewest(lengths, 100)
    assert beaten >= 3


@pytest.mark.parametrize("seed", range(6))
def test_many_pieces(seed):
    rng = random.Random(seed)
    counts = Counter()
    for _ in range(400):
        counts[rng.randint(1, 1024)] += rng.choice([1, 2, 50, 3000])
    counts[1024] += 10 ** 6
    fit = packing.best_fit(counts, 1024)
    n = check_plan(packing.plan(counts, 1024), counts, 1024)
    assert packing.waste_bound(counts, 1024) <= n <= sum(fit.values()) <= packing.waste_bound(counts, 1024) * 1.03 + 1


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        room = 100
        lengths = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
        bins = []
        for x in lengths:
            fit = [k for k, b in enumerate(bins) if b + x <= room]
            if fit:
                bins[max(fit, key=lambda k: bins[k])] += x
            else:
                bins.append(x)
        assert sum(packing.best_fit(Counter(lengths), room).values()) == len(bins)


def test_dominance():
    assert packing.dominates((6, 4), (6, 3, 1)) and packing.dominates((5,), (3, 2))
    assert not packing.dominates((6, 3, 1), (6, 4)) and not packing.dominates((5, 5), (6, 4))


def test_cut():
    assert [packing.cut(n, 10) for n in (1, 10, 11, 20, 25)] == [[1], [10], [1, 10], [10, 10], [5, 10, 10]]


def texts():
    rng = random.Random(2)
    letters = ["a", "b", "th", "ing ", " ", "  ", "\n", "\t", "é", "ß", "日本", "🙂", "'s", "'ll", "12", "!?", "\x00", "İ", "​", "_"]
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(600)]
    return some + ["", " " * 9000 + "x", "z" * 9000, "日" * 5000, "a<|endoftext|>b", "<|endoftext|>" * 3, "\n" * 5000]


def test_encoder_is_the_library():
    t = Tokenizer.from_file(PATH)
    want = [e.ids for e in t.encode_batch(texts(), add_special_tokens=False)]
    e = packing.ByteEncoder(PATH)
    assert [e.encode(t).tolist() for t in texts()] == want


def check(docs, room=1024):
    rows = packing.pack(docs, PATH, room).collect()
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for d in docs.select("doc_id", "text").collect():
        ids = np.array(t.encode(d["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for k, n in enumerate(packing.cut(len(ids), room)):
            want[d["doc_id"], k, at, n, zlib.crc32(ids[at:at + n].tobytes())] += 1
            at += n
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= room
    sizes = Counter(r["length"] for r in rows)
    return len(by), packing.waste_bound(sizes, room)


def test_query(spark, clashing):
    docs = clashing.selectExpr("*", "'q' AS block", "7 AS nth", "8 AS piece", "9 AS offset")
    used, least = check(docs)
    assert used <= least + 1


def test_short_sequences(spark, odd):
    used, least = check(odd, 16)
    assert used <= least * 1.02 + 1


def test_empty_table(spark, empty):
    assert packing.pack(empty, PATH).count() == 0
