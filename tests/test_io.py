"""Sources, sinks and the stream scorer (S1–S9, D6, D7) on small literal inputs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pertinax.sources import sinks
from pertinax.sources.tables import read_table, scan_existing


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="pertinax-io-"), name)


def test_csv_lands_as_strings_and_roundtrips(spark):
    df = spark.createDataFrame([(1, 36.5, "Sí"), (2, None, "No")], "id int, temp double, vm string")
    path = _tmp("t.csv")
    sinks.write_table(df, path, "csv")
    back = read_table(spark, path, "csv")
    assert dict(back.dtypes) == {"id": "string", "temp": "string", "vm": "string"}
    assert sorted((r["id"], r["vm"]) for r in back.collect()) == [("1", "Sí"), ("2", "No")]


def test_scan_existing_reports_missing_and_bad_files(spark):
    good = _tmp("good.parquet")
    spark.createDataFrame([(1, "a")], "k int, v string").write.parquet(good)
    bad = _tmp("bad.parquet")
    with open(bad, "w") as fh:
        fh.write("not parquet")
    data, status = scan_existing(spark, [good, _tmp("missing.parquet"), bad])
    st = {os.path.basename(r["source_name"]): r["status"] for r in status.collect()}
    assert st["good.parquet"] == "ok" and st["missing.parquet"] == "missing"
    assert st["bad.parquet"] in ("failed", "ok")      # parquet footers are read lazily
    assert data.where(F.col("source_name") == good).count() == 1


def test_scan_existing_goes_on_after_a_bad_column_chunk(spark):
    import pyarrow as pa
    import pyarrow.parquet as pq
    good, bad, none = _tmp("good.parquet"), _tmp("bad.parquet"), _tmp("none.parquet")
    rows = spark.createDataFrame([(i, f"v{i}", {"a": i}) for i in range(50)], "k int, v string, m map<string,int>")
    rows.write.parquet(good)
    rows.limit(0).write.parquet(none)
    pq.write_table(pa.table({"k": list(range(5_000)), "v": [f"text {i}" for i in range(5_000)]}), bad)
    chunk = pq.ParquetFile(bad).metadata.row_group(0).column(1)
    with open(bad, "r+b") as fh:   # the footer and the other column stay whole
        fh.seek(chunk.dictionary_page_offset or chunk.data_page_offset)
        fh.write(b"\xff" * chunk.total_compressed_size)
    assert spark.read.parquet(bad).count() == 5_000
    data, status = scan_existing(spark, [good, bad, none])
    st = {os.path.basename(r["source_name"]): r for r in status.collect()}
    assert [st[n]["status"] for n in ("good.parquet", "bad.parquet", "none.parquet")] == ["ok", "failed", "ok"]
    assert [st[n]["rows"] for n in ("good.parquet", "bad.parquet", "none.parquet")] == [50, None, 0]
    assert st["bad.parquet"]["error"] and sorted(r["v"] for r in data.collect()) == sorted(f"v{i}" for i in range(50))


def test_write_errors_skips_when_clean(spark):
    ok = spark.createDataFrame([(1, 1), (0, 0)], "real int, pred int")
    assert sinks.write_errors(ok, "real", "pred", _tmp("e"), ["real", "pred"]) is False
    bad = spark.createDataFrame([(1, 0), (0, 0)], "real int, pred int")
    path = _tmp("e2")
    assert sinks.write_errors(bad, "real", "pred", path, ["real", "pred"]) is True
    assert spark.read.option("header", True).csv(path).count() == 1


def test_convert_files_keeps_going_after_a_failure(spark):
    src = tempfile.mkdtemp(prefix="pertinax-conv-")
    spark.createDataFrame([(1, "x")], "a int, b string").coalesce(1).write.option("header", True) \
        .csv(os.path.join(src, "one.csv"))
    os.makedirs(os.path.join(src, "empty.csv"))   # a folder with no data: Spark cannot infer it
    out = {r["file"]: r for r in sinks.convert_files(spark, src, _tmp("dst"), "csv", "parquet").collect()}
    assert out["one.csv"]["ok"] and out["one.csv"]["rows"] == 1
    assert not out["empty.csv"]["ok"] and len(out["empty.csv"]["error"]) <= 40


def test_stream_scoring_matches_batch(spark, sf_small):
    from __spark_entry__ import queries
    out = queries()["d7_score_stream"](spark, sf_small, sizes={"forest": dict(numTrees=20, maxDepth=6)})
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf_small}/events.parquet").where("event_id % 61 <> 0").count()  # a key is required
    assert all(r["decision_ok"] for r in rows)      # in range: scored; out of range: not
    assert {r["valid"] for r in rows} == {True, False}


def test_stream_changes_model_between_batches_and_repeats_after_a_failure(spark, tmp_path, monkeypatch):
    """Each batch keeps the version it first ran with, also when it has to run again."""
    from pertinax.operators import ensembles as E
    from pertinax.operators import trees as T
    from pertinax.sources import model_store
    from pertinax.streaming import score_stream as S

    rows = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 100).cast("double").alias("x"),
                                   (F.col("id") % 100 > 50).cast("double").alias("label"))

    def save(depth):
        m = E.fit(rows, E.Features(["x"]), [E.Member("m", T.TreeSpec("forest", 5, depth))], F.col("row_id"))["m"]
        model_store.save_model(spark, m, f"{tmp_path}/store", {"depth": depth})
        return model_store.versions(spark, f"{tmp_path}/store")[-1]

    def score(df, model, **_):
        out = model.transform(df).withColumns({"valid": F.lit(True), "reject_reasons": F.array().cast("array<string>")})
        return out.withColumns({c: F.col("prediction") for c in ("alerts", "Prediccion_Modelo", "Confianza_%", "Prediccion")})

    monkeypatch.setattr(S, "score_records", score)
    schema = rows.drop("label").schema

    def run():
        q = S.score_stream_from_store(spark, f"{tmp_path}/src", schema, lambda d: d, f"{tmp_path}/store", f"{tmp_path}/out",
                                      f"{tmp_path}/ckpt", keep=["row_id"])
        q.awaitTermination()

    part = lambda k: rows.drop("label").where(F.col("row_id") % 2 == k).coalesce(1)
    first = save(2)
    part(0).write.mode("append").parquet(f"{tmp_path}/src")
    run()
    part(1).write.mode("append").parquet(f"{tmp_path}/src")
    second = save(3)

    def broken(df, model, **_):
        raise RuntimeError("lost after the version was pinned")

    monkeypatch.setattr(S, "score_records", broken)
    with pytest.raises(Exception, match="lost after"):
        run()
    third = save(4)                       # newer than the version that the failed batch has
    monkeypatch.setattr(S, "score_records", score)
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    got = {(r["model_version"], r["row_id"] % 2): r["n"] for r in
           out.groupBy("model_version", (F.col("row_id") % 2).alias("row_id")).agg(F.count("*").alias("n")).collect()}
    assert got == {(first, 0): 200, (second, 1): 200} and third not in {v for v, _ in got}
