"""Exact dedup, source mixing and the license scan against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pertinax.llm import exact_dedup, license_scan, mixing

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def native(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


# -- exact dedup --------------------------------------------------------------------------------


def groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[(r[1] or "").translate(UPPER)].append(r)
    return out


@pytest.mark.parametrize("support", [0.001, 0.2, 0.9])
def test_dedup_report_is_exact_whatever_counts_as_frequent(odd, odd_rows, support):
    out = exact_dedup.report(odd, support=support)
    assert native(out)
    got = out.collect()
    assert len(got) == len(odd_rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups(odd_rows).items()}
    kept = defaultdict(int)
    for r in got:
        g = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(g)
        assert r["keep_id"] == max((x[0] for x in g if x[0] is not None), default=None)
        if r["kept"]:
            kept[r["text_sha256"]] += 1
            assert r["doc_id"] == r["keep_id"]
    assert dict(kept) == dict.fromkeys(by_hash, 1)      # repeated rows too: exactly one stays


def test_frequent_digests_are_verified_and_bounded(odd):
    digests = exact_dedup.digest_table(odd)
    hot = exact_dedup.winners(digests, 0.3).collect()
    assert [r["group_size"] for r in hot] == [60]       # only the text that really is that frequent


def test_drop_duplicates_keeps_columns_and_one_row(clashing, odd_rows):
    out = exact_dedup.drop_duplicates(clashing, support=0.2)
    assert out.columns == clashing.columns and native(out)
    got = out.collect()
    assert sorted((r["text"] or "").translate(UPPER) for r in got) == sorted(groups(odd_rows))
    assert {r["doc_id"] for r in got if r["text"] == "hot text here now"} == {159}


def test_dedup_of_an_empty_table(empty):
    assert exact_dedup.report(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


# -- mixing -------------------------------------------------------------------------------------


def expected_targets(sizes):
    """The contract by rounds: share by weight, cap at three times, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in capped]
        total = sum(weight[s] for s in open_)
        target.update({s: left * weight[s] / total for s in open_})
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            capped.add(s)
        if len(capped) == len(order):
            return target


def test_mix_report_targets_budgets_and_reruns(odd, odd_rows, clashing):
    out = mixing.report(odd)
    assert native(out)
    got = out.collect()
    assert len(got) == len(odd_rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, source_of = defaultdict(int), defaultdict(set)
    for r in odd_rows:
        sizes[r[3]] += size(r[1])
        source_of[r[0]].add(r[3])
    want = expected_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        (source,) = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2             # the cut is exact but for repeated rows
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    again = mixing.report(clashing.repartition(3)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_many_sources_take_the_salted_join(odd, monkeypatch):
    plain = sorted(map(str, mixing.report(odd).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.report(odd).collect())) == plain


def test_salted_sources_are_joined_by_shuffle(odd, monkeypatch):
    """Spark sizes the table of sources as before it is repeated by salts."""
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    plan = mixing.report(odd)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_mix_repeats_and_cuts_documents(spark, clashing):
    report = {(r["doc_id"], r["size"]): r for r in mixing.report(clashing).collect()}
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    for (doc_id, _), r in report.items():
        if doc_id != 5:                                  # the repeated row counts twice
            assert words[doc_id] == r["taken"]
    text = "  a  b\tc \n"
    df = spark.createDataFrame([(text, 0), (text, 2), (text, 9)], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["", "  a  b", text]


def test_mix_of_an_empty_table_and_of_no_words(empty, spark):
    assert mixing.report(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.report(blank).collect()] == [(0.0, 0)] * 2


# -- license scan -------------------------------------------------------------------------------


def brute(text):
    ws = license_scan.template_words(text or "")
    places = [(i, t.label) for t in license_scan.PHRASES for p in [license_scan.template_words(t.text)]
              for i in range(len(ws)) if ws[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(ws), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


LICENSED = [
    "Released under the MIT License.", "under the mit license under the MIT LICENSE, cc-by-nc CC BY/NC",
    "x Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0.", "under the mit licenses", "cc by", "",
    "under the mit", None, "é under the mit license é", "apache license version 2 " * 40,
    "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without any restriction",
    "Redistribution and use in source forms only", "word " * 30_000 + "under the mit license",
]


def test_license_scan_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(LICENSED)] + [(0, LICENSED[0]), (None, LICENSED[1]), (2, LICENSED[2] + " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS label", "2 AS template", "3 AS pos", "4 AS gram", "5 AS n").repartition(4)
    out = license_scan.scan(df)
    assert native(out)
    got = out.collect()
    key = lambda x: (str(x[0]), str(x[1:]))
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                   for r in got], key=key) == sorted([(i, *brute(t)) for i, t in rows], key=key)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[10] == "gpl-3"                         # not the notice that differs in the version
    assert labels[11] == "mit"                           # words inserted and left out: merged diagonals
    assert labels[12] == "" and labels[3] == ""
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "") for r in got)


def test_license_scan_of_an_empty_table(empty):
    assert license_scan.scan(empty).count() == 0


def test_any_part_of_a_license_gives_its_label(spark):
    text = lambda name: (license_scan.TEXTS / f"{name}.txt").read_text("utf-8")
    names = ["apache-2", "bsd", "cc0", "gpl-2", "gpl-3", "isc", "mit", "zlib"]
    rows = [(i, "a word before " + text(n)) for i, n in enumerate(names)]
    rows += [(20, text("mit")[text("mit").index("THE SOFTWARE IS"):]),                    # the warranty alone
             (21, " ".join(license_scan.template_words(text("gpl-3"))[3000:3100])),
             (22, " ".join(license_scan.template_words(text("apache-2"))[700:800]))]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, n in enumerate(names):
        assert n in got[i]["labels"].split(","), n
    assert [got[i]["labels"] for i in (20, 21, 22)] == ["mit", "gpl-3", "apache-2"]


def test_templates_of_any_length(spark):
    rng = random.Random(6)
    ws = [f"w{i}" for i in range(400)]
    long, short = license_scan.Template("long", " ".join(ws), key="w130 w131 w132"), license_scan.Template("short", "w1 w2 w3 x")
    cases = [ws, ws[:330], ws[:310], ws[70:], ws[140:], [w for w in ws if w not in {"w59", "w60", "w61", "w200"}],
             ["a"] * 9 + ws[:100] + ["b", "c"] + ws[100:]]
    cases += [[w for w in ws if rng.random() > 0.02] for _ in range(6)]
    out = license_scan.scan(spark.createDataFrame([(i, " ".join(c)) for i, c in enumerate(cases)], "doc_id int, text string"),
                            [long, short])
    got = {r["doc_id"]: r for r in out.collect()}
    grams = {tuple(ws[k:k + 3]): k for k in range(398)}
    for i, case in enumerate(cases):
        hits = [grams[g] for g in zip(case, case[1:], case[2:]) if g in grams]
        covered = len({k + j for k in hits for j in range(3)}) / 400
        diagonals = sorted({p - grams[g] for p, g in enumerate(zip(case, case[1:], case[2:])) if g in grams})
        if all(b - a <= license_scan.SLACK for a, b in zip(diagonals, diagonals[1:])):
            want = covered if covered >= 0.8 and 130 in hits else 0
            assert got[i]["score"] == pytest.approx(want), i
            assert got[i]["labels"] == ("long" if want else ""), i


def test_templates_must_fit(spark, empty):
    with pytest.raises(ValueError):
        license_scan.scan(empty, [license_scan.Template("short", "two words")])
    with pytest.raises(ValueError):
        license_scan.scan(empty, [license_scan.Template("key", "three words here", key="not in it")])
