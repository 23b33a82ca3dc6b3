"""Registered queries over the driver's native tables and the encounter extract:
joins (J1–J6), aggregates (A1–A12), set operations (U1–U4), ordering (O1–O3), S3, P8–P14."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.operators import aggregate as A
from pertinax.operators import joins as J
from pertinax.operators import order as OR
from pertinax.operators import project as P
from pertinax.operators import setops as U
from pertinax.operators.nearest import nearest_join
from pertinax.plans import oracle as O
from pertinax.plans.clinical import prepared_encounters
from pertinax.plans.fixture import FIXTURE_SCORE_SQL, encounters
from pertinax.plans.registry import register
from pertinax.sources.tables import sample_head, table

RAW = "WITH encounters AS (" + O.encounters_duckdb_sql() + ")\n"
ENC = O.encounters_cte()
SPLIT_SQL = "substr(md5(CAST({k} AS VARCHAR) || '42'), 1, 8) < '33333333'"


def rnd(df: DataFrame, cols: list[str], scale: int = 6) -> DataFrame:
    """Round float outputs so the two engines' summation orders cannot differ."""
    return df.withColumns({c: F.round(c, scale) for c in cols})


def _docs_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return J.attach_validation(d, table(spark, sf_dir, "labels"), "doc_id", "doc_id",
                               ["quality", "toxic"])


_DOCS_LABELS_SQL = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l
  ON upper(trim(CAST(d.doc_id AS VARCHAR))) = upper(trim(CAST(l.doc_id AS VARCHAR)))"""


# --------------------------------------------------------------------- joins

@register("j1_attach_validation", oracle=_DOCS_LABELS_SQL)
def j1_attach_validation(spark, sf_dir):
    """Every document keeps its row; the label attaches on the normalised key."""
    return _docs_labels(spark, sf_dir)


@register("j1_attach_validation_validated", oracle="SELECT * FROM (" + _DOCS_LABELS_SQL +
          ") WHERE quality IS NOT NULL")
def j1_attach_validation_validated(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return J.attach_validation(d, table(spark, sf_dir, "labels"), "doc_id", "doc_id",
                               ["quality", "toxic"], validated_only=True, label="quality")


@register("j2_training_set_by_side", oracle="""
SELECT d.doc_id, d.lang, l.quality, l.toxic,
  CASE WHEN """ + SPLIT_SQL.format(k="d.doc_id") + """ THEN 'test' ELSE 'train' END AS side
FROM documents d JOIN labels l
  ON upper(trim(CAST(d.doc_id AS VARCHAR))) = upper(trim(CAST(l.doc_id AS VARCHAR)))""")
def j2_training_set_by_side(spark, sf_dir):
    """Inner join of documents and labels, tagged with the hash holdout side (M1)."""
    from pertinax.operators.prep import hash_split_flag
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    t = J.training_set(d, table(spark, sf_dir, "labels"), "doc_id", "doc_id", ["quality", "toxic"])
    return t.withColumn("side", F.when(hash_split_flag("doc_id"), F.lit("test")).otherwise(F.lit("train")))


@register("j3_join_rate", oracle="""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(quality) AS BIGINT) AS with_label,
  CAST(count(*) - count(quality) AS BIGINT) AS without_label,
  round(CAST(count(quality) AS DOUBLE) * 100 / count(*), 6) AS pct_with
FROM (""" + _DOCS_LABELS_SQL + ")")
def j3_join_rate(spark, sf_dir):
    return rnd(J.join_rate(_docs_labels(spark, sf_dir), "quality"), ["pct_with"])


def _scored(spark, sf_dir):
    """Prepared encounters + encoded truth + the deterministic fixture score."""
    e = prepared_encounters(spark, sf_dir)
    p = F.expr(FIXTURE_SCORE_SQL)
    return e.withColumns({"real": P.encode_label("Resolucion"), "p_pert": p}).withColumns({
        "pred": F.when(F.col("p_pert") > 0.5, F.lit(1)).otherwise(F.lit(0)),
        "conf": F.greatest(F.col("p_pert"), 1 - F.col("p_pert"))})


@register("j4_attach_scores", oracle=O.scored_cte() + """
SELECT e.row_id, s.pred, s.conf FROM enc e
LEFT JOIN (SELECT row_id, pred, conf FROM scored2 WHERE real IS NOT NULL) s ON e.row_id = s.row_id""")
def j4_attach_scores(spark, sf_dir):
    """Predictions written back on the scored (labelled) rows only, by row identity."""
    s = _scored(spark, sf_dir)
    scored = s.where(F.col("real").isNotNull())
    return J.attach_scores(prepared_encounters(spark, sf_dir).select(schema.ROW_ID), scored,
                           ["pred", "conf"])


@register("j4_attach_labels", oracle="""
SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j4_attach_labels(spark, sf_dir):
    """J4 on two tables: labels written back on their documents by row identity."""
    return J.attach_scores(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"),
                           ["quality", "toxic"], row_id="doc_id")


@register("j5_value_lookup", oracle="""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status_text
FROM orders""")
def j5_value_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", J.lookup("o_orderstatus", {"F": "final", "O": "open"}).alias("status_text"))


@register("j6_restrict_to_labelled", oracle=O.scored_cte() + """
SELECT row_id, pred FROM scored2 WHERE row_id IN (SELECT row_id FROM scored2 WHERE real IS NOT NULL)""")
def j6_restrict_to_labelled(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return J.restrict_to_labelled(s.select(schema.ROW_ID, "pred"), s.select(schema.ROW_ID, "real"),
                                  label="real")


@register("j6_labelled_documents", oracle="""
SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)""")
def j6_labelled_documents(spark, sf_dir):
    """J6 on two tables: the documents that have a label."""
    return J.restrict_to_labelled(table(spark, sf_dir, "documents").select("doc_id", "lang"),
                                  table(spark, sf_dir, "labels"), row_id="doc_id", label="quality")


# --------------------------------------------------------------------- A1–A12

@register("j7_nearest", oracle="""
WITH d AS (SELECT s_suppkey, min({'d': ((s_acctbal - c_acctbal) * (s_acctbal - c_acctbal)
      + CAST(s_nationkey - c_nationkey AS DOUBLE) * (s_nationkey - c_nationkey)) * 2 / 2, 'i': c_custkey}, 3) AS best
  FROM supplier, customer GROUP BY s_suppkey)
SELECT s_suppkey, CAST(k AS INTEGER) AS rank, best[k].i AS c_custkey, round(sqrt(best[k].d), 6) AS distance
FROM d, (VALUES (1), (2), (3)) v(k) WHERE k <= len(best)""")
def j7_nearest(spark, sf_dir):
    """Each supplier's three nearest customers by balance and nation."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return rnd(nearest_join(s, c, ["balance", "nation"], 3, "s_suppkey", "c_custkey"), ["distance"])


@register("a1_class_distribution", oracle="""
SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def a1_class_distribution(spark, sf_dir):
    return A.class_distribution(table(spark, sf_dir, "documents"), "lang")


@register("a2_class_share", oracle="""
SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n,
  round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM orders), 6) AS pct
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""")
def a2_class_share(spark, sf_dir):
    return rnd(A.class_share(table(spark, sf_dir, "orders"), "o_orderstatus"), ["pct"])


_A3_COLS = ["lang", "source", "n_chars", "quality", "toxic", "missing_col"]


@register("a3_completeness", oracle="""
WITH j AS (""" + _DOCS_LABELS_SQL + """), t AS (SELECT count(*) AS total FROM j)
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, true AS present, CAST(count({c}) AS BIGINT) AS non_null, "
    f"CAST((SELECT total FROM t) AS BIGINT) AS total, "
    f"round(CAST(count({c}) AS DOUBLE) * 100 / (SELECT total FROM t), 6) AS pct FROM j"
    for c in _A3_COLS[:-1]) + """
UNION ALL SELECT 'missing_col', false, NULL, CAST((SELECT total FROM t) AS BIGINT), NULL""")
def a3_completeness(spark, sf_dir):
    return rnd(A.completeness(_docs_labels(spark, sf_dir), _A3_COLS), ["pct"])


_A4_MAP = {"FC": "fc", "SatO2": "sato2", "Temperatura": "temp", "Glasgow": "glasgow", "BUN": "bun"}


@register("a4_missingness", oracle=RAW + ", t AS (SELECT count(*) AS total FROM encounters)\n" +
          "\nUNION ALL\n".join(
              f"SELECT '{v}' AS variable, '{c}' AS column, 'ok' AS status, "
              f"round(100.0 - CAST(count({c}) AS DOUBLE) * 100 / (SELECT total FROM t), 6) AS pct_null FROM encounters"
              for v, c in list(_A4_MAP.items())[:-1]) +
          "\nUNION ALL SELECT 'BUN', 'bun', 'COLUMNA NO EXISTE', NULL")
def a4_missingness(spark, sf_dir):
    return rnd(A.missingness(encounters(spark, sf_dir), _A4_MAP), ["pct_null"])


_A5_COLS = ["fc", "fr", "sato2", "hemoglobina", "compromiso_conciencia", "texto_libre"]


@register("a5_completeness_by_class", oracle=RAW + """,
c AS (SELECT * FROM encounters WHERE validacion = 'PERTINENTE'), t AS (SELECT count(*) AS total FROM c),
r AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, true AS present, CAST(count({c}) AS BIGINT) AS non_null, "
    f"CAST((SELECT total FROM t) AS BIGINT) AS total, "
    f"CAST(count({c}) AS DOUBLE) * 100 / (SELECT total FROM t) AS pct FROM c" for c in _A5_COLS) + """)
SELECT "column", present, non_null, total, round(pct, 6) AS pct FROM r WHERE 100.0 - pct < 50.0""")
def a5_completeness_by_class(spark, sf_dir):
    return rnd(A.completeness_by_class(encounters(spark, sf_dir), "validacion", "PERTINENTE",
                                       _A5_COLS), ["pct"])


_A6_COLS = ["hta", "dva", "ventilacion_mecanica"]


@register("a6_binary_values", oracle=RAW + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, {c} AS value, CAST(count(*) AS BIGINT) AS n FROM encounters GROUP BY {c}"
    for c in _A6_COLS))
def a6_binary_values(spark, sf_dir):
    return A.binary_values(encounters(spark, sf_dir), _A6_COLS)


_LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("a7_class_means", oracle="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, round(avg({c}) FILTER (WHERE l_returnflag = 'R'), 6) AS mean_pos, "
    f"CAST(count({c}) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS n_pos, "
    f"round(avg({c}) FILTER (WHERE l_returnflag = 'N'), 6) AS mean_neg, "
    f"CAST(count({c}) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS n_neg FROM lineitem"
    for c in _LI_COLS))
def a7_class_means(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rnd(A.class_means(li, "l_returnflag", "R", "N", _LI_COLS), ["mean_pos", "mean_neg"])


@register("a8_group_mean_diff", oracle="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, round(avg({c}) FILTER (WHERE l_returnflag = 'R'), 6) AS mean_a, "
    f"round(avg({c}) FILTER (WHERE l_returnflag = 'A'), 6) AS mean_b, "
    f"round(avg({c}) FILTER (WHERE l_returnflag = 'R') - avg({c}) FILTER (WHERE l_returnflag = 'A'), 6) AS diff "
    f"FROM lineitem" for c in _LI_COLS))
def a8_group_mean_diff(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = A.group_mean_diff(li, F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", _LI_COLS)
    return rnd(out, ["mean_a", "mean_b", "diff"])


@register("a9_binary_share_by_group", oracle=O.scored_cte() + """,
raw AS (SELECT event_id AS row_id, CASE WHEN event_id % 37 = 0 THEN 'Sí' ELSE 'No' END AS vm,
               CASE WHEN event_id % 41 = 0 THEN 'Sí' ELSE 'No' END AS tr FROM events),
j AS (SELECT s.real, s.pred, raw.vm, raw.tr FROM scored2 s JOIN raw USING (row_id)),
g AS (SELECT count(*) FILTER (WHERE real = 1 AND pred = 0) AS na, count(*) FILTER (WHERE real = 1 AND pred = 1) AS nb,
  count(*) FILTER (WHERE real = 1 AND pred = 0 AND vm = 'Sí') AS a0, count(*) FILTER (WHERE real = 1 AND pred = 1 AND vm = 'Sí') AS b0,
  count(*) FILTER (WHERE real = 1 AND pred = 0 AND tr = 'Sí') AS a1, count(*) FILTER (WHERE real = 1 AND pred = 1 AND tr = 'Sí') AS b1 FROM j)
SELECT 'ventilacion_mecanica' AS column, round(a0 * 100.0 / na, 6) AS pct_a, round(b0 * 100.0 / nb, 6) AS pct_b FROM g
UNION ALL SELECT 'transfusiones', round(a1 * 100.0 / na, 6), round(b1 * 100.0 / nb, 6) FROM g""")
def a9_binary_share_by_group(spark, sf_dir):
    """A9 on the scored extract: % 'Sí' among false negatives vs detected positives."""
    s = _scored(spark, sf_dir).select(schema.ROW_ID, "real", "pred")
    raw = encounters(spark, sf_dir).select(schema.ROW_ID, "ventilacion_mecanica", "transfusiones")
    j = s.join(raw, schema.ROW_ID)
    fn = (F.col("real") == 1) & (F.col("pred") == 0)
    tp = (F.col("real") == 1) & (F.col("pred") == 1)
    out = A.binary_share_by_group(j, fn, tp, ["ventilacion_mecanica", "transfusiones"])
    return rnd(out, ["pct_a", "pct_b"])


@register("a10_monthly_counts", oracle="""
SELECT date_trunc('month', o_orderdate) AS month, CAST(count(*) AS BIGINT) AS n
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def a10_monthly_counts(spark, sf_dir):
    out = A.monthly_counts(table(spark, sf_dir, "orders"), "o_orderdate")
    return out.withColumn("month", F.col("month").cast("timestamp_ntz"))


@register("a11_validator_counts", oracle=RAW + """,
v AS (SELECT validacion AS raw_label, """ + O.clean_label("validacion") + """ AS clean_label,
             CASE WHEN tipo_cama IS NOT NULL THEN validacion END AS second_pass
      FROM encounters),
c AS (SELECT """ + ", ".join(
    f"count({c}) AS n{i}, count(*) FILTER (WHERE upper(trim({c})) = 'PERTINENTE') AS p{i}, "
    f"count(*) FILTER (WHERE upper(trim({c})) = 'NO PERTINENTE') AS q{i}"
    for i, c in enumerate(["raw_label", "clean_label", "second_pass"])) + """ FROM v)
SELECT 'raw_label' AS column, CAST(n0 AS BIGINT) AS n, CAST(p0 AS BIGINT) AS n_pos, CAST(q0 AS BIGINT) AS n_neg,
  n0 = greatest(n0, n1, n2) AS is_best FROM c
UNION ALL SELECT 'clean_label', CAST(n1 AS BIGINT), CAST(p1 AS BIGINT), CAST(q1 AS BIGINT),
  n1 = greatest(n0, n1, n2) AND n0 < n1 FROM c
UNION ALL SELECT 'second_pass', CAST(n2 AS BIGINT), CAST(p2 AS BIGINT), CAST(q2 AS BIGINT),
  n2 = greatest(n0, n1, n2) AND n0 < n2 AND n1 < n2 FROM c""")
def a11_validator_counts(spark, sf_dir):
    """A11 over three label passes of the extract (raw, cleaned, and a second reviewer who
    only labelled records that carry a bed type)."""
    e = encounters(spark, sf_dir)
    v = e.select(F.col("validacion").alias("raw_label"),
                 P.clean_label("validacion").alias("clean_label"),
                 F.when(F.col("tipo_cama").isNotNull(), F.col("validacion")).alias("second_pass"))
    return A.validator_counts(v, ["raw_label", "clean_label", "second_pass"])


@register("a12_column_stats", oracle="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS n, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"min({c}) AS min, max({c}) AS max, round(median({c}), 6) AS median, true AS numeric FROM lineitem"
    for c in _LI_COLS))
def a12_column_stats(spark, sf_dir):
    out = A.column_stats(table(spark, sf_dir, "lineitem"), _LI_COLS)
    return rnd(out, ["median"])


@register("a12_column_stats_extract", oracle=ENC + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS n, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"min({c}) AS min, max({c}) AS max, round(median({c}), 6) AS median, true AS numeric FROM enc"
    for c in ["FC", "SatO2", "Temperatura", "Hemoglobina"]))
def a12_column_stats_extract(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir)
    return rnd(A.column_stats(e, ["FC", "SatO2", "Temperatura", "Hemoglobina"]), ["median"])


# --------------------------------------------------------------------- U1–U4

@register("u1_combine", oracle="""
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def u1_combine(spark, sf_dir):
    c = table(spark, sf_dir, "customer").toDF("key", "name", "nationkey", "acctbal", "segment")
    s = table(spark, sf_dir, "supplier").toDF("key", "name", "nationkey", "acctbal")
    return U.combine(c, s)


def _cols_sql(t):
    return f"(SELECT column_name AS column FROM (DESCRIBE SELECT * FROM {t}))"


_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                "o_orderpriority"]
_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _nn_sql(t, cols, side):
    return "\n  UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", CAST(count({c}) AS BIGINT) AS non_null_{side} FROM {t}' for c in cols)


@register("u2_schema_overlap", oracle=f"""
WITH na AS ({_nn_sql('orders', _ORDERS_COLS, 'a')}), nb AS ({_nn_sql('lineitem', _LINEITEM_COLS, 'b')}),
o AS (SELECT coalesce(a.column, b.column) AS "column", a.column IS NOT NULL AS in_a, b.column IS NOT NULL AS in_b,
  CASE WHEN a.column IS NOT NULL AND b.column IS NOT NULL THEN 'common'
       WHEN a.column IS NOT NULL THEN 'missing' ELSE 'extra' END AS status
  FROM {_cols_sql('orders')} a FULL JOIN {_cols_sql('lineitem')} b ON a.column = b.column)
SELECT o.*, na.non_null_a, nb.non_null_b FROM o LEFT JOIN na USING ("column") LEFT JOIN nb USING ("column")""")
def u2_schema_overlap(spark, sf_dir):
    """Column sets of two tables as rows, with each column's non-null count per table."""
    return U.schema_overlap(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


@register("u3_schema_identical", oracle=f"""
WITH o AS (SELECT count(*) FILTER (WHERE a.column IS NULL OR b.column IS NULL) AS d
           FROM {_cols_sql('orders')} a FULL JOIN {_cols_sql('lineitem')} b ON a.column = b.column)
SELECT d = 0 AS identical, CAST(d AS BIGINT) AS sym_diff,
  (SELECT count(*) FROM orders) AS rows_a, (SELECT count(*) FROM lineitem) AS rows_b FROM o""")
def u3_schema_identical(spark, sf_dir):
    return U.schema_identical(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


@register("u4_unique", oracle="SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def u4_unique(spark, sf_dir):
    return U.unique(table(spark, sf_dir, "customer"), "c_mktsegment")


# --------------------------------------------------------------------- O1–O3, S3

@register("o1_leaderboard_segments", oracle="""
WITH s AS (SELECT c_mktsegment, round(avg(c_acctbal), 6) AS avg_acctbal,
                  round(max(c_acctbal), 6) AS max_acctbal FROM customer GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY avg_acctbal DESC, c_mktsegment) AS BIGINT) AS rank,
  max_acctbal - avg_acctbal AS gap FROM s""")
def o1_leaderboard_segments(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    res = rnd(c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("avg_acctbal"),
                                            F.max("c_acctbal").alias("max_acctbal")),
              ["avg_acctbal", "max_acctbal"])
    return OR.leaderboard(res, "avg_acctbal", "c_mktsegment", gap_of=("max_acctbal", "avg_acctbal"))


@register("o1_global_rank_customers", oracle="""
SELECT *, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rank
FROM customer""")
def o1_global_rank_customers(spark, sf_dir):
    """O1 over a whole table: distributed 1..n rank (no single-partition window)."""
    return OR.global_rank(table(spark, sf_dir, "customer"), [("c_acctbal", "desc"), "c_custkey"])


@register("o2_top3", oracle="""
SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3""")
def o2_top3(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return OR.top_k(c, [F.col("c_acctbal").desc(), "c_custkey"], 3)


@register("o3_preview", oracle=RAW + "SELECT row_id, episodio, validacion FROM encounters ORDER BY row_id LIMIT 10")
def o3_preview(spark, sf_dir):
    return OR.preview(encounters(spark, sf_dir).select(schema.ROW_ID, "episodio", "validacion"), 10)


@register("s3_sample_head", oracle=RAW + "SELECT row_id, fc, validacion FROM encounters ORDER BY row_id LIMIT 1000")
def s3_sample_head(spark, sf_dir):
    return sample_head(encounters(spark, sf_dir).select(schema.ROW_ID, "fc", "validacion"), 1000)


# --------------------------------------------------------------------- P8–P14 on tables

@register("p8_filter_month", oracle="""
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-10-01' AND o_orderdate < TIMESTAMP '1998-11-01' AND o_orderstatus IS NOT NULL""")
def p8_filter_month(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return P.filter_month(o, "o_orderdate", 1998, 10, label="o_orderstatus").select("o_orderkey", "o_orderdate")


@register("p9_temporal_holdout", oracle="""
SELECT CASE WHEN coalesce(o_orderdate >= TIMESTAMP '1998-10-01' AND o_orderdate < TIMESTAMP '1998-11-01', false)
            THEN 'valid' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1""")
def p9_temporal_holdout(spark, sf_dir):
    o = P.temporal_holdout(table(spark, sf_dir, "orders"), "o_orderdate", 1998, 10)
    return o.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("p1_p5_p10_p12_projection", oracle=RAW + """
SELECT row_id, fc AS "Frecuencia Cardiaca", fc AS FC, sato2 AS SatO2, pas AS PAS FROM encounters""")
def p1_p5_p10_p12_projection(spark, sf_dir):
    """Filler-column drop (P12), alias (P5), form renames (P1) and present-column
    selection (P10) in one projection."""
    return _p1_out(encounters(spark, sf_dir))


def _p1_out(raw):
    e = raw.select(schema.ROW_ID, F.col("fc").alias("Frecuencia Cardiaca"),
                   F.col("sato2").alias("Saturación de Oxígeno"),
                   F.col("pas").alias("Presión Arterial Sistólica"),
                   F.lit(None).cast("string").alias("Unnamed: 7"))
    e = P.drop_unnamed(e)
    e = P.alias_columns(e, {"Frecuencia Cardiaca": "FC"})          # P5: FC added, original kept
    e = P.rename(e, {"Saturación de Oxígeno": "SatO2",              # P1 entries
                     "Presión Arterial Sistólica": "PAS"})
    return P.select_present(e, ["Frecuencia Cardiaca", "FC", "SatO2", "PAS", "Dolor"],
                            keep=[schema.ROW_ID])


@register("p4_normalize_columns", oracle=RAW + """
SELECT row_id, fc AS FC, pas AS PA_Sistolica, hta AS Antecedente_HTA, tipo_cama AS Tipo_Cama, validacion AS Resolucion
FROM encounters""")
def p4_normalize_columns(spark, sf_dir):
    """Accented, oddly spaced headers map to canonical names through the header key."""
    e = encounters(spark, sf_dir).select(
        schema.ROW_ID, F.col("fc").alias("Frecuencia  Cardíaca"),
        F.col("pas").alias(" Presión Arterial Sistólica "),
        F.col("hta").alias("Antecedentes de Hipertensión Arterial"),
        F.col("tipo_cama").alias("TIPO DE CAMA"), F.col("validacion").alias("Resolución"))
    return P.normalize_columns(e)


@register("p11_backfill", oracle=RAW + """
SELECT row_id, fc, 0 AS HipertencionArterial, 'desconocido' AS Tipo_Cama, CAST(NULL AS DOUBLE) AS Dolor
FROM encounters""")
def p11_backfill(spark, sf_dir):
    e = encounters(spark, sf_dir).select(schema.ROW_ID, "fc")
    return P.backfill(e, ["fc", "HipertencionArterial", "Tipo_Cama", "Dolor"], policy="by_kind",
                      binary=["HipertencionArterial"], categorical=["Tipo_Cama"])


@register("p13_check_required", oracle=RAW + """SELECT 'FC' AS "column", 'vitals' AS "group", true AS present, CAST(count(fc) AS BIGINT) AS non_null FROM encounters
UNION ALL SELECT 'FR' AS "column", 'vitals' AS "group", true AS present, CAST(count(fr) AS BIGINT) AS non_null FROM encounters
UNION ALL SELECT 'PAS' AS "column", 'vitals' AS "group", true AS present, CAST(count(pas) AS BIGINT) AS non_null FROM encounters
UNION ALL SELECT 'PAD' AS "column", 'vitals' AS "group", true AS present, CAST(count(pad) AS BIGINT) AS non_null FROM encounters
UNION ALL SELECT 'SatO2' AS "column", 'vitals' AS "group", true AS present, CAST(count(sato2) AS BIGINT) AS non_null FROM encounters
UNION ALL SELECT 'Temp' AS "column", 'vitals' AS "group", true AS present, CAST(count(temp) AS BIGINT) AS non_null FROM encounters
UNION ALL SELECT 'Glasgow' AS "column", 'vitals' AS "group", true AS present, CAST(count(glasgow) AS BIGINT) AS non_null FROM encounters
UNION ALL SELECT 'Triage' AS "column", 'vitals' AS "group", true AS present, CAST(count(triage) AS BIGINT) AS non_null FROM encounters
UNION ALL SELECT 'HipertencionArterial' AS "column", 'antecedents' AS "group", true AS present, CAST(count(hta) AS BIGINT) AS non_null FROM encounters
UNION ALL SELECT 'DiabetesMellitus', 'antecedents', false, CAST(NULL AS BIGINT)
UNION ALL SELECT 'Cardiopatia', 'antecedents', false, CAST(NULL AS BIGINT)""")
def p13_check_required(spark, sf_dir):
    """The bulk-scoring contract against the extract: present or not, and how filled."""
    from pertinax.plans.clinical import production_encounters
    report, _ = P.check_required(production_encounters(spark, sf_dir))
    return report


@register("p14_validate_ranges", oracle=ENC + """,
r AS (SELECT row_id, list_filter([
  CASE WHEN coalesce(FC <= 0, false) THEN 'fc_no_positiva' END,
  CASE WHEN coalesce(FR <= 0, false) THEN 'fr_no_positiva' END,
  CASE WHEN coalesce(PA_Sistolica <= 0 OR PA_Diastolica <= 0, false) THEN 'presion_no_positiva' END,
  CASE WHEN coalesce(SatO2 <= 0 OR SatO2 > 100, false) THEN 'sato2_fuera_de_rango' END,
  CASE WHEN coalesce(Temperatura < 30 OR Temperatura > 45, false) THEN 'temperatura_fuera_de_rango' END],
  lambda x: x IS NOT NULL) AS rr FROM enc)
SELECT row_id, array_to_string(rr, ',') AS reject_reasons, len(rr) = 0 AS valid FROM r""")
def p14_validate_ranges(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir)
    v = P.validate_ranges(e, pas="PA_Sistolica", pad="PA_Diastolica", temp="Temperatura")
    return v.select(schema.ROW_ID, F.array_join("reject_reasons", ",").alias("reject_reasons"), "valid")


# --------------------------------------------------------------------- S1, S2, S4, P2, P3, P6, P17

def _scratch(spark, name):
    import uuid
    from pertinax.session import scratch_dir
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex[:10]}")


_ORDERS_TXT = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  CAST(o_totalprice AS VARCHAR) AS o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"""


@register("s1_read_table_csv", oracle=_ORDERS_TXT)
def s1_read_table_csv(spark, sf_dir):
    """A CSV extract lands with its header and every column as STRING."""
    from pertinax.sources.sinks import write_table
    from pertinax.sources.tables import read_table
    path = _scratch(spark, "s1-csv")
    orders = table(spark, sf_dir, "orders")
    write_table(orders.withColumn("o_orderdate", F.col("o_orderdate").cast("string")), path, "csv")
    return read_table(spark, path, "csv")


@register("s2_read_table_json", oracle=_ORDERS_TXT)
def s2_read_table_json(spark, sf_dir):
    """The same table entering as JSON (the workbook path re-aimed to open formats)."""
    from pertinax.sources.sinks import write_table
    from pertinax.sources.tables import read_table
    path = _scratch(spark, "s2-json")
    orders = table(spark, sf_dir, "orders")
    write_table(orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns]), path, "json")
    return read_table(spark, path, "json")


@register("s4_scan_existing_status", oracle="""
SELECT 'customer' AS source_name, 'ok' AS status, (SELECT count(*) FROM customer) AS rows
UNION ALL SELECT 'no_such_table', 'missing', NULL
UNION ALL SELECT 'supplier', 'ok', (SELECT count(*) FROM supplier)""")
def s4_scan_existing_status(spark, sf_dir):
    """Per requested source, whether it was read (missing files are reported, not fatal)."""
    from pertinax.sources.tables import scan_existing
    paths = [f"{sf_dir}/{t}.parquet" for t in ("customer", "no_such_table", "supplier")]
    _, status = scan_existing(spark, paths)
    return status.select(F.regexp_extract("source_name", r"([^/]+)\.parquet$", 1).alias("source_name"),
                         "status", "rows")


@register("s4_scan_existing_rows", oracle="""
SELECT 'customer' AS source_name, CAST(count(*) AS BIGINT) AS n, CAST(count(c_mktsegment) AS BIGINT) AS with_segment FROM customer
UNION ALL SELECT 'supplier', CAST(count(*) AS BIGINT), 0 FROM supplier""")
def s4_scan_existing_rows(spark, sf_dir):
    """The readable sources unioned by name (missing columns NULL), rows per source."""
    from pertinax.sources.tables import scan_existing
    paths = [f"{sf_dir}/{t}.parquet" for t in ("customer", "no_such_table", "supplier")]
    data, _ = scan_existing(spark, paths)
    src = F.regexp_extract("source_name", r"([^/]+)\.parquet$", 1)
    return data.groupBy(src.alias("source_name")).agg(F.count(F.lit(1)).alias("n"),
                                                      F.count("c_mktsegment").alias("with_segment"))


@register("p1_p2_p3_rename_presets", oracle=RAW + """
SELECT row_id, fc AS FC_form, sato2 AS SatO2_form, temp AS Temp_form, hta AS DM_form,
  fc AS FC, sato2 AS SatO2, validacion AS Validacion FROM encounters""")
def p1_p2_p3_rename_presets(spark, sf_dir):
    """Form (P1), evaluation (P3) and base (P2) presets on one frame.  The form preset maps the
    unaccented 'Frecuencia Cardiaca' and leaves the accented header for the evaluation preset
    (trap T6: the two presets spell the same vital differently)."""
    e = encounters(spark, sf_dir)
    d = e.select(schema.ROW_ID,
                 F.col("fc").alias("Frecuencia Cardiaca"), F.col("fc").alias("Frecuencia Cardíaca"),
                 F.col("sato2").alias("Saturación de Oxígeno"), F.col("sato2").alias("Saturación Oxígeno"),
                 F.col("temp").alias("Temperatura en °C"), F.col("hta").alias("Antecedentes Diabéticos"),
                 F.col("validacion").alias("Resolucion"))
    d = P.rename_form(d)
    d = d.withColumnsRenamed({"FC": "FC_form", "SatO2": "SatO2_form", "Temp": "Temp_form",
                              "DiabetesMellitus": "DM_form"})
    d = P.rename_base(P.rename_eval(d))
    return d.select(schema.ROW_ID, "FC_form", "SatO2_form", "Temp_form", "DM_form", "FC", "SatO2",
                    "Validacion")


@register("p6_filter_validated", oracle=RAW + "SELECT row_id, validacion FROM encounters WHERE validacion IS NOT NULL")
def p6_filter_validated(spark, sf_dir):
    e = encounters(spark, sf_dir).select(schema.ROW_ID, "validacion")
    return P.filter_validated(e, "validacion")


@register("p17_encode_label_sorted", oracle=RAW + """,
l AS (SELECT row_id, """ + O.clean_label("validacion") + """ AS label FROM encounters)
SELECT row_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_index
FROM l WHERE label IS NOT NULL""")
def p17_encode_label_sorted(spark, sf_dir):
    """Sorted distinct classes -> 0..k-1 (StringIndexer, alphabetical)."""
    e = encounters(spark, sf_dir).select(schema.ROW_ID, P.clean_label("validacion").alias("label"))
    out, _ = P.encode_label_sorted(e, "label")
    return out.where(F.col("label").isNotNull())
