"""PII, SimHash, quality, token store, language ID and BPE against plain Python."""

import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pertinax.llm import bpe, byte_cnn, components, hd_langid, pii, simhash, token_store
from pertinax.llm.catalog import TOKENIZER
from pertinax.session import scratch_dir, written

# -- personal data ------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum((d * 2 - 9 if d > 4 else d * 2) if k % 2 else d
                        for k, d in enumerate(map(int, reversed(digits)))) if digits else 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                    "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_patterns_match_brute_force_on_random_texts():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1.2@3-+ (5)6é_%") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("4111 1111 1111 1111 and 10.0.0.256") == [("card", 0, 19)]


def test_patterns_are_linear_on_hostile_texts():
    for text in ("a" * 200_000, "1" * 200_000, "+1" + "(" * 200_000, "a@" * 100_000, "1." * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def private(spark):
    rng = random.Random(3)
    common = ["report", "meeting", "about", "project", "final", "update", "review", "budget"]
    rows = []
    for i in range(300):
        rows.append((i, " ".join(rng.choices(common, k=40))))
    for i in range(300, 320):   # the nickname stands with this address only, the rest is common
        rows.append((i, " ".join(rng.choices(common, k=6)) + " Zorblax at jane.doe@example.org "
                     + " ".join(rng.choices(common, k=6))))
    rows += [(320, "a note on Zorblax alone"), (321, None), (322, ""), (321, None), (None, "x@y.zz")]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS hits", "2 AS base", "3 AS row_id", "4 AS term").repartition(4)


def test_disclosing_terms_are_found_wherever_they_stand(private):
    table = pii.disclosing_terms(private)
    assert [r["term"] for r in table.collect()] == ["zorblax"]
    got = {r["doc_id"]: r for r in pii.report(private).collect()}
    assert pii.report(private).count() == private.count()
    assert got[320]["spans"] == "term:10:17" and got[320]["n_email"] == 0
    assert got[310]["n_email"] == 1 and got[310]["spans"].count("term:") == 1
    assert all(got[i]["spans"] == "" for i in range(300))             # clean documents stay clean
    assert got[321]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[None]["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest()


def test_sanitise_masks_patterns_and_terms(private):
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(private).collect()}
    assert got[320] == "a note on  alone"                             # fully disclosing: removed
    assert "[EMAIL]" in got[310] and "Zorblax" not in got[310] and "jane" not in got[310]
    mild = {r["doc_id"]: r["text"] for r in pii.sanitise(private, remove=1.1).collect()}
    assert mild[320] == "a note on [NAME] alone"                      # generalised


def test_disclosure_is_pmi_over_information(private):
    rows = [(r["text"] or "") for r in private.collect()]
    n = sum(len(pii.terms(t)) for t in rows)
    near, n_e = Counter(), 0
    for t in rows:
        spans = pii.base_spans(t)
        for kind, a, b in spans:
            if t[a:b].startswith("jane"):
                words = pii.window(t, a, b, pii.Cover(spans))
                near.update(words)
                n_e += len(words)
    n_t = sum(pii.terms(t).count("zorblax") for t in rows)
    want = np.log2(near["zorblax"] * n / (n_t * n_e)) / np.log2(n / n_e)
    (row,) = pii.disclosing_terms(private).collect()
    assert row["disclosure"] == pytest.approx(min(1.0, want))


def test_copied_signatures_and_names_seen_once_are_found(spark):
    rng = random.Random(8)
    common = ["report", "meeting", "about", "project", "final", "update", "review", "budget"]
    plain = lambda n: " ".join(rng.choices(common, k=n))
    rows = [(i, plain(60)) for i in range(400)]
    # a block that repeats word for word: one window in forty documents
    block = " " + " ".join(common) + " Quillian Vantro +1 415 555 0100 " + " ".join(common)
    rows += [(i, plain(12) + block) for i in range(400, 440)]
    rows += [(440, plain(10) + " Ostrander ost@example.org " + plain(10)),    # seen once
             # often in its document, beside its address once
             (441, "Belvoir " + plain(12) + " Belvoir " + plain(12) + " Belvoir bel@example.org " + plain(12) + " Belvoir")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["term"] for r in pii.disclosing_terms(docs).collect()} == {"quillian", "vantro", "ostrander", "belvoir"}
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i, names in {400: ("Quillian", "Vantro"), 440: ("Ostrander",), 441: ("Belvoir",)}.items():
        assert not any(n in got[i] for n in names)
    assert all(got[i] == rows[i][1] for i in range(400))


def test_short_names_and_names_far_off_are_found(spark):
    rng = random.Random(9)
    common = ["report", "meeting", "about", "project", "final", "update", "review", "budget"]
    plain = lambda n: " ".join(rng.choices(common, k=n))
    rows = [(i, plain(60)) for i in range(400)]
    rows += [(400, plain(9) + " Ng wrote from ng1@example.org " + plain(9)), (401, plain(9) + " 王伟 wei@example.org " + plain(9)),
             (402, plain(9) + " ask li li1@example.org " + plain(9)),
             (403, plain(9) + " Farrow" + " " * 5_000 + "far@example.org" + "-" * 5_000 + " Wenlock " + plain(9)),
             (404, plain(9) + " Tarn " + "x" * 300 + " tarn@example.org " + plain(9)),
             (405, plain(9) + " is at as@example.org of " + plain(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["term"] for r in pii.disclosing_terms(docs).collect()}
    assert found == {"ng", "王伟", "li", "farrow", "wenlock", "tarn", "x" * 300, "wrote", "from", "ask"}
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i, name in {400: " Ng ", 401: "王伟", 402: " li ", 403: "Farrow", 404: "Tarn"}.items():
        assert name not in got[i]


def test_windows_walk_word_by_word():
    rng = random.Random(4)
    for _ in range(3_000):
        text = "".join(rng.choice(["ab ", "q" * 90, "  " * 60, "-", " x1", "Ärzte ", "to ", "y" * 300, ". "])
                       for _ in range(rng.randint(0, 40)))
        start = rng.randint(0, len(text))
        end = rng.randint(start, len(text))
        # runs that the mention cuts touch it
        before = [m[0] for m in pii.TERM.finditer(text[:start]) if m.end() < start][-8:]
        after = [m[0] for m in pii.TERM.finditer(text[end:]) if m.start() > 0][:8]
        want = [w.lower() for w in before + after if w not in pii.FUNCTION_WORDS]
        assert pii.window(text, start, end, pii.Cover([])) == want
    # gaps and long words are crossed a few times at most, not once a mention
    text = ("mail a@b.cc" + " " * 50_000) * 20 + "z" * 500_000 + " a@b.cc" * 20
    for kind, a, b in (spans := pii.base_spans(text)):
        pii.window(text, a, b, pii.Cover(spans))


def test_pii_of_odd_and_empty_tables(clashing, odd_rows, empty):
    assert pii.report(clashing).count() == len(odd_rows)
    assert pii.report(empty).count() == 0 and pii.sanitise(empty).count() == 0


# -- SimHash ------------------------------------------------------------------------------------


def brute_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, bits):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, x in enumerate(prints):
        for y in prints[i + 1:]:
            if bin((x ^ y) & (1 << 64) - 1).count("1") <= bits:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {p: find(p) for p in prints}


def test_simhash_report_matches_brute_force(clashing, odd_rows):
    got = simhash.report(clashing).collect()
    want = {r[0]: [] for r in odd_rows}
    for r in odd_rows:
        if len(r[1] or "") < 10_000:
            want[r[0]].append(f"{brute_print(r[1]):016x}")
    prints = [int(r["fingerprint"], 16) for r in got]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows)
    for r in got:
        assert not want[r["doc_id"]] or r["fingerprint"] in want[r["doc_id"]]
    comp = components_of(sorted(set(prints)), 4)
    least = defaultdict(list)
    for r, p in zip(got, prints):
        least[comp[p]].append(r["doc_id"])
    for r, p in zip(got, prints):
        assert r["component_id"] == min((i for i in least[comp[p]] if i is not None), default=None)


@pytest.mark.parametrize("bits,short", [(4, 1024), (4, 8), (3, 8), (2, 8), (1, 4)])
def test_links_keep_every_component_of_crowded_lists(spark, bits, short):
    rng = random.Random(bits)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in [rng.getrandbits(64) for _ in range(2)]:
        for _ in range(100):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(simhash._signed(x) for x in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["node"]: r["component"] for r in components.components(simhash.links(df, bits, short)).collect()}
    want = components_of(prints, bits)
    assert {p: got.get(p, p) for p in prints} == want


def test_exploded_rows_are_joined_by_shuffle(spark, monkeypatch):
    """Spark sizes a table as before its explode: a few narrow rows are sent to no driver as seventy or two thousand each."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(simhash, "written", lambda df, name: (plans.append((name, plan(df))), written(df, name))[1])
    prints = spark.createDataFrame([(x, x, x) for x in range(40)], "doc_id long, text_hash long, fp long")
    crowd = simhash.links(prints.select("fp"), short=8)
    plans.append(("crowd", plan(simhash._crowd_links(prints.select("fp"), 4))))
    plans.append(("report", plan(simhash.report(prints, prints=prints))))
    found = {name: [line for line in text.splitlines() if "Join" in line] for name, text in plans}
    assert all("SortMergeJoin" in line for line in found["posting-lists"] + found["crowd"])
    assert len(found["posting-lists"]) == len(found["crowd"]) == 1
    assert [line for line in found["report"] if "salt" in line and "SortMergeJoin" in line]
    assert {r["node"]: r["component"] for r in components.components(crowd).collect()} == {x: 0 for x in range(40)}


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (900, 901)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(chain).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_keep_one_drops_near_copies_only(clashing, empty):
    before = {(r["doc_id"], r["text"]): r for r in simhash.report(clashing).join(
        clashing.select(F.col("doc_id").alias("i"), "text", F.xxhash64("text").alias("h")),
        F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))).collect()}
    out = simhash.keep_one(clashing)
    assert out.columns == clashing.columns
    kept = out.collect()
    assert len(kept) == len({r["component"] for r in before.values()})
    assert {before[(r["doc_id"], r["text"])]["component"] for r in kept} == {r["component"] for r in before.values()}
    assert simhash.keep_one(empty).count() == 0 and simhash.report(empty).count() == 0


# -- quality ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(rng.choice(["buy!!!", "cl1ck$$$", "win###"]) if bad and k > 5 else
                        rng.choice(["the", "house", "river", "stands", "and", "old"])
                        for k in range(rng.randint(10, 300)))
        rows.append((i, text))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "the old house"), (1002, "the river " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS score")
    return docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_held_out_documents(rated, empty):
    docs, labels = rated
    model = byte_cnn.train(docs, labels)
    got = byte_cnn.predict(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert {r["predicted"] for r in got if r["doc_id"] == 1002} == {1}
    assert byte_cnn.predict(empty, model).count() == 0


def test_quality_learns_nothing_from_held_out_labels(rated):
    docs, labels = rated
    flipped = labels.withColumn("quality", F.when(byte_cnn.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    a, b = byte_cnn.train(docs, labels), byte_cnn.train(docs, flipped)
    assert all(np.array_equal(a[k], b[k]) for k in a)
    nothing = byte_cnn.train(docs, labels.limit(0))
    assert nothing is None and {r["score"] for r in byte_cnn.predict(docs, nothing).collect()} == {0.5}


def test_network_is_a_convolution_over_all_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    model = {"table": rng.normal(size=(257, 8)).astype(np.float32), "bias": rng.normal(size=24).astype(np.float32),
             "filters": rng.normal(size=(64, 24)).astype(np.float32)}
    model["table"][byte_cnn.PAD] = 0
    model["table"][byte_cnn.PAD, byte_cnn.PADDED] = 1
    model["table"][:byte_cnn.PAD, byte_cnn.PADDED] = 0
    model["filters"][byte_cnn.PADDED] = -1e4
    for n in (1, 63, 64, 65, 300, 1000):
        text = bytes(rng.integers(97, 105, n).tolist())
        data = np.concatenate([np.frombuffer(text, np.uint8).astype(int), np.full(300, byte_cnn.PAD)])
        flags = [n > i >= 5 and any(i - 4 - lag >= 0 and list(data[i - 4:i + 1]) == list(data[i - 4 - lag:i + 1 - lag])
                                    for lag in range(2, 25)) for i in range(len(data))]
        x = model["table"][data].copy()
        x[:, byte_cnn.REPEATED] = flags
        conv = np.array([x[i:i + 8].reshape(-1) @ model["filters"] for i in range(n)]) + model["bias"]
        starts = range(0, max(64, (-(-n // 64) - 1) * 64), 192)
        chunks = [np.maximum(conv[s:s + 256].max(axis=0), 0) for s in starts]
        want = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
        got = byte_cnn.features([text], model)[0]
        assert np.allclose(got, want, atol=1e-3), n
        monkeypatch.setattr(byte_cnn, "BLOCK", 256)
        assert np.allclose(byte_cnn.features([text], model)[0], got, atol=1e-4)
        monkeypatch.undo()


# -- language -----------------------------------------------------------------------------------


def brute_bundle(text):
    out = np.zeros(hd_langid.DIM)
    for word in "".join(c.lower() if c.isalpha() else " " for c in text).split():
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            v = [hd_langid.letter_vector(ord(x)) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


def test_bundles_bind_permuted_letters(monkeypatch):
    texts = ["", "a", " Ab1c ", "ÉTÉ été", "日本語 текст", "word " * 50, "x" * 300]
    want = np.array([brute_bundle(t) for t in texts])
    assert np.allclose(hd_langid.bundles(texts), want)
    monkeypatch.setattr(hd_langid, "SLICE_CHARS", 40)        # long texts piece by piece
    assert np.allclose(hd_langid.bundles(texts), want)


def test_language_of_held_out_documents(spark, clashing, odd_rows, empty):
    rng = random.Random(6)
    vocabulary = {"aa": ["tion", "the", "ing", "with"], "bb": ["ung", "der", "sch", "mit"], "cc": ["ción", "los", "que"]}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=20)), lang) for i in range(300)
            for lang in [rng.choice(sorted(vocabulary))]]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "the with", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = hd_langid.train(docs.where(~hd_langid.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in hd_langid.predict(docs, profiles).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if i < 900)
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (900, 901)] == [("und", 0.0)] * 2
    assert got[902]["lang_pred"] == "aa" and 0 < got[902]["score"] <= 1
    again = hd_langid.train(docs.repartition(7).where(~hd_langid.held_out(F.col("doc_id"))))
    assert all(np.array_equal(profiles[k], again[k]) for k in profiles)
    assert hd_langid.predict(clashing, profiles).count() == len(odd_rows)
    kept = hd_langid.keep_identified(clashing, profiles)
    assert kept.columns == clashing.columns
    assert kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in odd_rows)
    assert hd_langid.train(empty) == {} and hd_langid.predict(empty, {}).count() == 0
    assert {r["lang_pred"] for r in hd_langid.predict(clashing, {}).collect()} == {"und"}


# -- encoding and the token store ---------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(TOKENIZER)


def test_codec_equals_the_library_on_random_texts(library):
    rng = random.Random(1)
    letters = ["abcdefghijklmnopqrstuvwxyz", "aab", "a", "théïüöß", "日本語の文字", "abc123!?", "ΣσςABCé", "the in an ",
               "éa", "x<|endoftext|>y", "!.", " \x1c\x85a b", "Ĳĸŉſİı½²Ⅷ"]
    codec = bpe.Codec(TOKENIZER, leaf=16)
    for _ in range(3_000):
        some = rng.choice(letters) + rng.choice(letters)
        text = "".join(rng.choice(some) for _ in range(rng.choice([3, 20, 200, 700])))
        if rng.random() < 0.2:
            text = rng.choice(letters) * rng.randint(1, 60) + "<|startoftext|>"
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(codec.encode([text])[0], "<u4")
        assert got.tolist() == want, text
        assert codec.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_tree_of_a_long_piece(library):
    rng = random.Random(8)
    codec = bpe.Codec(TOKENIZER)
    for text in ("".join(rng.choice("etaoinshr") for _ in range(60_000)), "a" * 50_001, "ab" * 30_000):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == \
            library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec, own = bpe.Codec(path), Tokenizer.from_file(path)
    texts = ["", " two  words\n", "über 123"]
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids
        assert codec.decode(np.frombuffer(ids, "<u4")).decode() == own.decode(
            own.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)


def test_roundtrip_of_odd_rows(clashing, odd_rows, empty, library):
    got = bpe.roundtrip(clashing, TOKENIZER, with_ids=True).collect()
    want = Counter()
    for r in odd_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(
            library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids))] += 1
    assert Counter((*r[:4], tuple(r["ids"])) for r in got) == want
    assert bpe.roundtrip(empty, TOKENIZER).count() == 0


def test_token_store_of_odd_rows(spark, clashing, odd_rows, library):
    folder = token_store.write(clashing, scratch_dir(spark, "store-odd"), TOKENIZER, 2)
    got = token_store.read(spark, folder).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(odd_rows)
    text = {(r[0], r[1]) for r in odd_rows}
    want, start = defaultdict(list), 0
    for i, t in text:
        e = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[i].append((len(e), zlib.crc32(struct.pack(f"<{len(e)}I", *e))))
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        start += r["n_tokens"]
    manifest = json.loads(token_store._get(f"{folder}/manifest"))
    dictionary = token_store._get(f"{folder}/dictionary")
    assert manifest["tokens"] == start and manifest["dictionary"] == hashlib.sha256(dictionary).hexdigest()
    found = [s.find(11) for s in (token_store.Shard(f"{folder}/{x['name']}", dictionary) for x in manifest["shards"])]
    (doc,) = [f for f in found if f is not None]
    assert np.frombuffer(doc, "<u4").tolist() == library.encode("one", add_special_tokens=False).ids + [2]
    with pytest.raises(ValueError):
        token_store.Shard(f"{folder}/{manifest['shards'][0]['name']}", b"another")


def test_token_store_of_an_empty_table_and_of_text_ids(spark, empty):
    folder = token_store.write(empty, scratch_dir(spark, "store-empty"), TOKENIZER, 2)
    assert token_store.read(spark, folder).count() == 0
    with pytest.raises(TypeError):
        token_store.write(empty.withColumn("doc_id", F.lit("a")), scratch_dir(spark, "store-bad"), TOKENIZER, 2)


def test_zeros_and_many_mentions(spark):
    """A part of thousands of zeros is a number like any other; windows of many mentions stay linear."""
    import time

    from pertinax.llm import pii

    long_zero = "0" * 5000
    text = f"{long_zero}.1.2.3 and 1.{long_zero}9.{long_zero}.{long_zero}256 and 0.0.0.0"
    assert [(k, text[a:b][-7:]) for k, a, b in pii.base_spans(text)] == [("ip", "0.1.2.3"), ("ip", "0.0.0.0")]
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_ip"] == 2

    def seconds(n):
        t = " ".join(f"user{i}@example.com wrote line {i}" for i in range(n))
        spans = pii.base_spans(t)
        assert len(spans) == n
        start = time.process_time()
        cover = pii.Cover(spans)
        for _, a, b in spans:
            pii.window(t, a, b, cover)
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(4_000), 0.02)


def test_cover_is_what_mentions_cover():
    import random

    from pertinax.llm import pii

    rng = random.Random(3)
    for _ in range(200):
        spans = [("k", a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 8)))]
        cover = pii.Cover(spans)
        for a in range(70):
            b = a + rng.randint(1, 5)
            assert cover.meets(a, b) == any(x < b and a < y for _, x, y in spans)


def test_names_are_told_from_chance(spark):
    """Names planted beside their addresses are found; frequent words there are left alone."""
    import random

    from pertinax.llm import pii

    rng = random.Random(11)
    common = [f"common{i}" for i in range(300)]
    names = [f"Name{i}x" for i in range(60)]
    docs = []
    for i in range(3000):
        words = [rng.choice(common) for _ in range(120)]
        if i < 240:
            at = rng.randint(20, 100)
            words[at:at] = [names[i % 60], f"person{i % 60}@mail.example"]
        docs.append((i, " ".join(words)))
    table = pii.disclosing_terms(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {r["term"] for r in table.collect()}
    wanted = {n.lower() for n in names}
    assert wanted <= found                                     # recall 1
    assert len(found & set(common)) <= 0.02 * len(common)      # frequent words stay


def test_dictionary_is_the_same_in_every_run(spark):
    """Sampled by hash from whole documents: other partitions and orders of the rows change nothing."""
    import random

    from pertinax.llm import token_store
    from pertinax.llm.catalog import TOKENIZER

    rng = random.Random(1)
    rows = [(i % 1500, " ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.randrange(999)}"]) for _ in range(rng.choice([5, 40, 9000 if i < 3 else 60]))))
            for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = token_store.train_dictionary(df.repartition(7), TOKENIZER, 2, "doc_id", "text")
    assert first and first == token_store.train_dictionary(df.orderBy("text").repartition(3), TOKENIZER, 2, "doc_id", "text")
    ids = bytes(range(256)) * 400
    few = token_store.drawn_blocks(ids, 4096)
    assert len(few) <= 4 * 4096 and few == token_store.drawn_blocks(ids, 4096) and token_store.drawn_blocks(ids[:400], 4096) == ids[:400]
