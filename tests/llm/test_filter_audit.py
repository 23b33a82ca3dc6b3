"""The filter audit against running every order by itself."""

import re
from collections import defaultdict
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from pertinax.llm import filter_audit
from pertinax.llm.catalog import filter_report

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    texts = defaultdict(set)
    for r in rows:
        texts[r["text"] or ""].add(r["doc_id"])
    fails = []
    for r in rows:
        t, d = r["text"] or "", r["doc_id"]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
             "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
             "E": d is not None and any(o is not None and o < d for o in texts[t])}
        fails.append((r["source"] or "", {k for k in f if f[k]}, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine, shapley = [x for x in fails if x[0] == part], defaultdict(int)
        for order in permutations("ABCDE"):
            alive = mine
            for step, f in enumerate(order):
                gone = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(alive), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def check(docs, labels):
    got = filter_report(docs, labels).collect()
    want = brute(docs.collect(), [tuple(r) for r in labels.collect()])
    assert len(got) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want


def test_paths_count_orders():
    for k in range(1, 7):
        into, out = filter_audit.path_counts(k)
        assert into[-1] == out[0] == factorial(k)
        for s in range(1 << k):
            n = s.bit_count()
            assert (into[s], out[s]) == (factorial(n), factorial(k - n))
        assert sum(w for s, f, w in filter_audit.edges(k) if f == 0) == factorial(k)


def test_against_every_order(spark, clashing):
    shout = [(500 + i, "LOUD & CLEAR " * (100 if i % 3 else 20), "en", "s1" if i % 2 else None, 0) for i in range(9)]
    good = " ".join(f"w{i}" for i in range(250))
    more = [(600 + i, good, "en", "s2", 0) for i in range(5)] + [(601, good, "en", "s1", 0), (None, good, "en", "s1", 0)]
    docs = clashing.unionByName(spark.createDataFrame(shout + more,
                                                      "doc_id long, text string, lang string, source string, n_chars long"),
                                allowMissingColumns=True)
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, 0, 1), (5, 1, None), (600, 1, 0), (602, 1, 1), (None, 1, 1),
                                    (501, None, 1), (210, 1, 0)], LABELS)
    check(docs, labels)


def test_empty_tables(spark, empty, odd):
    none = spark.createDataFrame([], LABELS)
    assert filter_report(empty, none).count() == 0
    check(odd, none)


def test_other_numbers_of_filters(spark):
    rows = spark.range(100).select(F.lit(None).cast("string").alias("s"), (F.col("id") % 2 == 0).alias("even"),
                                   (F.col("id") < 10).alias("small"))
    counts = filter_audit.cells(rows, F.col("s"), filter_audit.fail_mask([F.col("even"), F.col("small")]))
    got = {(r["filter_order"], r["step"]): (r["part"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"])
           for r in filter_audit.audit(counts, "XY").collect()}
    assert got == {("XY", 1): ("", 50, 50, 0, 45, 95), ("XY", 2): ("", 45, 5, 5, 5, 15),
                   ("YX", 1): ("", 90, 10, 0, 5, 15), ("YX", 2): ("", 45, 45, 5, 45, 95)}
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "XX")
