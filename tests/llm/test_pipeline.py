"""The pipeline against a plain Python version of its five stages, on a small fixture."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pertinax.llm import hd_langid
from pertinax.session import written
from .test_native import expected_targets
from .test_text_operators import brute_print, components_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 80))), "en", f"s{i % 4}", 0) for i in range(120)]
    rows += [(200 + i, rows[0][1].upper(), "en", "s0", 0) for i in range(40)]      # exact copies
    long = " ".join(rng.choices(vocabulary, k=900))
    rows += [(300 + i, long + f" tail{i}", "en", "s1", 0) for i in range(40)]      # near copies
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, "12 34", "en", None, 0),
             (403, "nur ein satz", None, None, 0), (403, "nur ein satz", None, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_stage_against_brute_force(spark, corpus):
    docs = corpus
    assert [s[0] for s in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        docs = written(stage(spark, docs, "unused"), "pipeline-test")
        after = [r.asDict() for r in docs.collect()]
        if number < 4:
            assert docs.columns == corpus.columns
        if number == 0:
            assert Counter(map(str, after)) == Counter(
                str(r) for r in before if any(c.isalpha() for c in r["text"] or ""))
        if number == 1:
            best = {}
            for r in before:
                key = r["text"].translate(UPPER)
                best[key] = max(best.get(key, r), r, key=lambda x: x["doc_id"])
            assert Counter(map(str, after)) == Counter(map(str, best.values()))
        if number == 2:
            prints = {r["doc_id"]: brute_print(r["text"]) for r in before}
            comp = components_of(sorted(set(prints.values())), 4)
            groups = defaultdict(list)
            for i, p in prints.items():
                groups[comp[p]].append(i)
            assert sorted(r["doc_id"] for r in after) == sorted(min(g) for g in groups.values())
            assert len(after) < len(before)
        if number == 3:
            sizes, taken = defaultdict(int), defaultdict(int)
            texts = {r["doc_id"]: r["text"] for r in before}
            for r in before:
                sizes[r["source"]] += len(r["text"].split())
            for r in after:
                taken[r["source"]] += len(r["text"].split())
                assert texts[r["doc_id"]].startswith(r["text"])
            want = expected_targets(dict(sizes))
            assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        if number == 4:
            from tokenizers import Tokenizer
            library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
            assert Counter((r["doc_id"], tuple(r["ids"])) for r in after) == Counter(
                (r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in before)


def test_dropping_copies_shuffles_alike_at_any_size(spark):
    """The list of copies grows with the table, so a small one is not joined in another way than a large one."""
    docs = spark.createDataFrame([(i, f"text number {i // 2} of a few words") for i in range(40)], "doc_id long, text string")
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
        kept = stage(spark, docs, "")
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert any("SortMergeJoin" in line and "LeftAnti" in line for line in plan.splitlines())
    assert corpus_pipeline.drop_exact_copies(spark, docs, "").count() == 20


def test_exact_dedup_shuffles_texts_once(spark):
    """Copies, rows equal in id and text, and null ids leave by one shuffle of the texts, not by one each."""
    rows = [(i, f"text number {i // 2}") for i in range(40)] + [(7, "Text number 3"), (7, "text number 3")] * 30
    rows += [(None, "text number 3"), (None, "no id"), (None, "no id"), (None, "NO ID"), (50, None), (51, ""), (51, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_exact_copies(spark, docs.withColumn("n", F.lit(1)), "")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert sum("Exchange hashpartitioning" in line for line in lines) == 2     # the rows; the list of copies, without texts
    first = lambda name: next(i for i, line in enumerate(lines) if name in line)
    assert first("SortMergeJoin") < first("partial_min_by")                    # equal rows are merged before they travel
    assert Counter((r["doc_id"], r["text"].lower() if r["text"] else "") for r in kept.collect()) == Counter(
        [(i, f"text number {i // 2}") for i in range(1, 40, 2)] + [(None, "no id"), (51, "")])


def test_an_empty_corpus_runs_through(spark, corpus):
    docs = corpus.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "unused"), "pipeline-empty")
        assert docs.count() == 0


def test_run_on_the_smallest_tables(spark, sf_small):
    out = corpus_pipeline.run(spark, sf_small)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert hd_langid.UNKNOWN == "und"
