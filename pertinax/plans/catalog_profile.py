"""Registered queries: profiling and schema matching (Q1–Q5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pertinax import schema
from pertinax.operators import profile as Q
from pertinax.plans import oracle as O
from pertinax.plans.fixture import encounters
from pertinax.plans.registry import register
from pertinax.sources.tables import table

# Form-style headers for the encounter extract (the reference layout for Q1).
FORM_HEADERS = {
    "episodio": "Episodio",
    "fc": "Frecuencia Cardíaca",
    "fr": "Frecuencia Respiratoria",
    "pas": "Presión Arterial Sistólica",
    "pad": "Presión Arterial Diastólica",
    "sato2": "Saturación Oxígeno",
    "temp": "Temperatura en °C",
    "glasgow": "Glasgow",
    "triage": "Triage",
    "fio2": "FiO2",
    "hemoglobina": "Hemoglobina",
    "hta": "Antecedentes de Hipertensión Arterial",
    "dva": "DVA",
    "ventilacion_mecanica": "Ventilación Mecánica",
    "transfusiones": "Transfusiones",
    "compromiso_conciencia": "Compromiso Conciencia",
    "tipo_cama": "Tipo de Cama",
    "texto_libre": "Texto Libre",
    "validacion": "Validacion",
}


def form_extract(spark, sf_dir):
    e = encounters(spark, sf_dir)
    return e.select(*[F.col(c).alias(FORM_HEADERS.get(c, c)) for c in e.columns])


def _sources(spark, sf_dir):
    return {"extract_form": form_extract(spark, sf_dir),
            "extract_short": encounters(spark, sf_dir),
            "orders": table(spark, sf_dir, "orders"),
            "lineitem": table(spark, sf_dir, "lineitem")}


# ------------------------------------------------------------------ oracle helpers

def _norm_sql(x: str) -> str:
    return (f"replace(replace(replace({O.trim_ws(f'lower(coalesce({x}, ''))')}, '_', ' '), '°', ''), "
            f"'  ', ' ')")


def _name_match_sql(x: str) -> str:
    n = _norm_sql(x)
    whens = []
    for target, aliases in schema.VARIABLE_ALIASES:
        cond = " OR ".join(f"contains({n}, {O.q(a)}) OR contains({O.q(a)}, {n})" for a in aliases)
        whens.append(f"WHEN {cond} THEN {O.q(target)}")
    return "(CASE " + " ".join(whens) + " END)"


def _has(n: str, *subs: str) -> str:
    return "(" + " OR ".join(f"contains({n}, {O.q(s)})" for s in subs) + ")"


def _content_sql() -> str:
    n = _norm_sql('"column"')
    num = '("numeric" AND n > 0)'
    yn = "(n_distinct <= 3 AND has_yes_no)"
    return f"""(CASE WHEN n = 0 THEN NULL
  WHEN {yn} AND {_has(n, 'cirug', 'cx')} THEN 'Cirugía'
  WHEN {yn} AND {_has(n, 'ventil', 'vm')} THEN 'Ventilación Mecánica'
  WHEN {yn} AND {_has(n, 'dialisis', 'hd')} THEN 'Diálisis'
  WHEN {num} AND min >= 34 AND max <= 42 AND max - min < 10 AND {_has(n, 'temp')} THEN 'Temperatura'
  WHEN {num} AND min >= 50 AND max <= 100 AND median > 90 AND {_has(n, 'sat', 'o2', 'ox')} THEN 'Saturación Oxígeno'
  WHEN {num} AND min >= 80 AND max <= 250 AND {_has(n, 'sist', 'pas')} THEN 'Presión Arterial Sistólica'
  WHEN {num} AND min >= 40 AND max <= 150 AND {_has(n, 'diast', 'pad')} THEN 'Presión Arterial Diastólica'
  WHEN {num} AND min >= 30 AND max <= 200 AND {_has(n, 'fc', 'card', 'pulso')} THEN 'Frecuencia Cardíaca'
  WHEN {num} AND min >= 8 AND max <= 60 AND max - min < 50 AND {_has(n, 'fr', 'respir')} THEN 'Frecuencia Respiratoria'
  WHEN {num} AND min >= 3 AND min <= 15 AND max <= 15 AND {_has(n, 'glas', 'gcs')} THEN 'Glasgow'
  WHEN n_distinct < 10 AND has_pertinente THEN 'Validación' END)"""


def _profile_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        v = f'CAST("{c}" AS VARCHAR)'
        parts.append(
            f"SELECT {i} AS position, {O.q(c)} AS \"column\", count({v}) AS n, count(DISTINCT {v}) AS n_distinct, "
            f"count(*) FILTER (WHERE {v} IS NOT NULL AND {O.num(v)} IS NULL) = 0 AS \"numeric\", "
            f"min({O.num(v)}) AS min, max({O.num(v)}) AS max, median({O.num(v)}) AS median, "
            f"coalesce(bool_or(lower({v}) IN {O.in_list(Q.YES_NO_TOKENS)}), false) AS has_yes_no, "
            f"coalesce(bool_or(contains(upper({v}), 'PERTINENTE')), false) AS has_pertinente, "
            f"count(*) AS total FROM {src}")
    return "\nUNION ALL\n".join(parts)


def _detect_sql(src: str, cols: list[str], source: str) -> str:
    nm = _name_match_sql('"column"')
    ct = _content_sql()
    return f"""SELECT '{source}' AS source, position, "column", coalesce({nm}, {ct}) AS variable,
  CASE WHEN {nm} IS NOT NULL THEN 'nombre' WHEN {ct} IS NOT NULL THEN 'contenido' END AS method,
  round(CASE WHEN total = 0 THEN 0.0 ELSE n * 100.0 / total END, 6) AS completeness
FROM ({_profile_sql(src, cols)})"""


_RAW_COLS = ["row_id", "episodio", "fecha_alta", "fc", "fr", "pas", "pad", "sato2", "temp", "glasgow",
             "triage", "fio2", "hemoglobina", "hta", "dva", "ventilacion_mecanica", "transfusiones",
             "compromiso_conciencia", "tipo_cama", "texto_libre", "validacion"]
_FORM_SQL = ("SELECT " + ", ".join(f'{c} AS "{FORM_HEADERS.get(c, c)}"' for c in _RAW_COLS)
             + " FROM encounters")
_RAW = "WITH encounters AS (" + O.encounters_duckdb_sql() + f"), form AS ({_FORM_SQL})\n"
_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_DETECT_ALL = (_RAW + "\n" + "SELECT * FROM (" + _detect_sql("encounters", _RAW_COLS, "extract_short") + ")\nUNION ALL\n"
               + "SELECT * FROM (" + _detect_sql("form", [FORM_HEADERS.get(c, c) for c in _RAW_COLS], "extract_form")
               + ")\nUNION ALL\nSELECT * FROM (" + _detect_sql("lineitem", _LI_COLS, "lineitem") + ")")


def _detected(spark, sf_dir):
    srcs = {"extract_short": encounters(spark, sf_dir), "extract_form": form_extract(spark, sf_dir),
            "lineitem": table(spark, sf_dir, "lineitem")}
    return Q.detect_variables_many(srcs).withColumn("completeness", F.round("completeness", 6))


# ------------------------------------------------------------------ queries

_SRC_SQL = {"extract_form": "form", "extract_short": "encounters", "orders": "orders",
            "lineitem": "lineitem"}


@register("q1_compat_ranking", oracle=_RAW + """,
ref AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM form)),
exp AS (SELECT c FROM ref WHERE c <> 'Validacion'),
src_cols AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{k}' AS source, column_name AS c FROM (DESCRIBE SELECT * FROM {v})" for k, v in _SRC_SQL.items()) + """),
meta AS (SELECT source, count(*) AS cols, count(*) FILTER (WHERE c IN (SELECT c FROM exp)) AS common,
         count(*) FILTER (WHERE c NOT IN (SELECT c FROM ref)) AS extra,
         bool_or(c IN ('VALIDACIÓN', 'Validacion', 'validacion', 'PERTINENTE')) AS has_label
         FROM src_cols GROUP BY source),
nrows AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{k}' AS source, count(*) AS rows FROM {v}" for k, v in _SRC_SQL.items()) + """),
s AS (SELECT m.source, CAST(r.rows AS BIGINT) AS rows, CAST(m.cols AS INTEGER) AS cols,
        CAST(m.common AS INTEGER) AS common,
        CAST((SELECT count(*) FROM exp) - m.common AS INTEGER) AS missing, CAST(m.extra AS INTEGER) AS extra,
        m.common * 100.0 / (SELECT count(*) FROM exp) AS compat, m.has_label
      FROM meta m JOIN nrows r USING (source))
SELECT *, CASE WHEN compat >= 100 AND has_label THEN 'listo' WHEN compat >= 90 AND has_label THEN 'ajustes_menores'
  WHEN compat >= 90 THEN 'sin_validaciones' ELSE 'baja_compatibilidad' END AS verdict,
  CAST(row_number() OVER (ORDER BY compat DESC, source) AS BIGINT) AS rank FROM s""")
def q1_compat_ranking(spark, sf_dir):
    """Q1: sources ranked by column compatibility with the form layout."""
    src = _sources(spark, sf_dir)
    ref = src["extract_form"].columns
    return Q.compat_ranking(src, ref, label_cols=["Validacion"])


_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                "o_orderpriority"]


def _completeness_sql(t, cols):
    return "\n  UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", round(count({c}) * 100.0 / count(*), 6) AS completeness FROM {t}'
        for c in cols)


_NM = _name_match_sql('n."column"')


@register("q2_match_by_name", oracle=f"""WITH n AS (SELECT column_name AS "column" FROM (DESCRIBE SELECT * FROM lineitem)
  UNION ALL SELECT column_name FROM (DESCRIBE SELECT * FROM orders)),
c AS ({_completeness_sql("lineitem", _LI_COLS)}
  UNION ALL {_completeness_sql("orders", _ORDERS_COLS)})
SELECT n."column", {_NM} AS variable, CASE WHEN {_NM} IS NOT NULL THEN 'nombre' END AS method,
  c.completeness FROM n LEFT JOIN c ON n."column" = c."column" """)
def q2_match_by_name(spark, sf_dir):
    """Q2 over the columns of two native tables, each with its completeness."""
    out = None
    for t in ("lineitem", "orders"):
        src = table(spark, sf_dir, t)
        m = Q.match_by_name(Q.columns_as_rows(spark, src, t), data=src)
        out = m if out is None else out.unionByName(m)
    return out.select("column", "variable", "method", F.round("completeness", 6).alias("completeness"))


@register("q3_detect_variables", oracle=_DETECT_ALL)
def q3_detect_variables(spark, sf_dir):
    """Q2 + Q3: name match, then content rules from exact per-column statistics."""
    return _detected(spark, sf_dir)


_Q4_SQL = f"""WITH d AS ({_DETECT_ALL.replace(_RAW, '', 1)})
SELECT source, CAST(count(DISTINCT variable) AS BIGINT) AS variables,
  CAST(count(DISTINCT CASE WHEN variable IN {O.in_list(schema.QUALITY_VITALS)} THEN variable END) AS BIGINT) AS vitals,
  CAST(count(DISTINCT CASE WHEN variable IN {O.in_list(schema.QUALITY_PROCEDURES)} THEN variable END) AS BIGINT) AS procedures,
  coalesce(bool_or(variable = 'Validación'), false) AS has_label
FROM d GROUP BY source"""
_Q4_FULL = _RAW + ", " + _Q4_SQL[len("WITH "):]
_Q4_SCORE = ("round(vitals / 7.0 * 100 * 0.5 + procedures / 4.0 * 100 * 0.3 + "
             "CASE WHEN has_label THEN 100.0 ELSE 0.0 END * 0.2, 6)")


@register("q4_quality_score", oracle="SELECT *, " + _Q4_SCORE + " AS score FROM (" + _Q4_FULL + ")")
def q4_quality_score(spark, sf_dir):
    s = Q.quality_score(_detected(spark, sf_dir))
    return s.withColumn("score", F.round("score", 6))


@register("q5_quality_ranking", oracle="""WITH s AS (SELECT *, """ + _Q4_SCORE + """ AS score FROM (""" + _Q4_FULL + """))
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, source) AS BIGINT) AS rank,
  CASE WHEN score >= 70 AND has_label THEN 'excelente' WHEN score >= 70 THEN 'bueno_sin_validacion' ELSE 'moderada' END AS verdict
FROM s""")
def q5_quality_ranking(spark, sf_dir):
    s = Q.quality_score(_detected(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return Q.quality_ranking(s)
