"""DuckDB SQL twins used as the correctness oracle for registered queries.

These strings restate the library's semantics in plain SQL over the same parquet views, so
the driver can compare both engines row for row.  They are test oracles, not an execution
path of the library.
"""

from __future__ import annotations

from pertinax import schema
from pertinax.plans.fixture import FIXTURE_SCORE_SQL, encounters_duckdb_sql

NUMERIC_RE = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def trim_ws(x: str) -> str:
    return rf"trim(CAST({x} AS VARCHAR), chr(32) || chr(9) || chr(13) || chr(10) || chr(12))"


def num(x: str) -> str:
    t = trim_ws(x)
    return f"(CASE WHEN regexp_full_match({t}, '{NUMERIC_RE}') THEN TRY_CAST({t} AS DOUBLE) END)"


def parse_decimal(x: str) -> str:
    s = f"replace({trim_ws(x)}, '%', '')"
    body = (f"(CASE WHEN contains({s}, '.') AND contains({s}, ',') "
            f"THEN replace(replace({s}, '.', ''), ',', '.') "
            f"WHEN contains({s}, ',') THEN replace({s}, ',', '.') ELSE {s} END)")
    return (f"(CASE WHEN lower({trim_ws(x)}) IN {in_list(schema.NULLISH_TOKENS)} THEN NULL "
            f"ELSE {num(body)} END)")


def to_bool(x: str) -> str:
    return f"coalesce(lower({trim_ws(x)}) IN {in_list(schema.TO_BOOL_TRUE)}, false)"


def bin_map(x: str) -> str:
    t = f"lower({trim_ws(x)})"
    return (f"(CASE WHEN {t} IN {in_list(schema.BIN_MAP_YES)} THEN 1 "
            f"WHEN {t} IN {in_list(schema.BIN_MAP_NO)} THEN 0 END)")


def clean_label(x: str) -> str:
    return (f"(CASE WHEN {x} IN {in_list(schema.LABEL_NULL_TOKENS)} THEN NULL "
            f"WHEN {x} = {q(schema.LABEL_REJECT_TOKEN)} THEN {q(schema.LABEL_NEG)} ELSE {x} END)")


def encode_label(x: str) -> str:
    t = f"upper({trim_ws(x)})"
    return (f"(CASE WHEN {t} = {q(schema.LABEL_POS)} THEN 1 "
            f"WHEN {t} = {q(schema.LABEL_NEG)} THEN 0 END)")


def clean_text(x: str) -> str:
    return rf"regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9\s]+', ' ', 'g')"


def _words(words) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def category(bed: str, text: str) -> str:
    ctx = f"lower(coalesce({bed}, 'nan') || ' ' || coalesce({text}, 'nan'))"
    return (f"(CASE WHEN regexp_matches({ctx}, '{_words(schema.NEO_KEYWORDS)}') THEN 'NEO' "
            f"WHEN regexp_matches({ctx}, '{_words(schema.PED_KEYWORDS)}') THEN 'PEDIATRICO' "
            f"ELSE 'ADULTO' END)")


ALERT_SELECT = ",\n    ".join(
    f"regexp_matches(__clean, {q(p)}) AS alert_{slug}" for p, slug in schema.TEXT_ALERTS)


def encounters_cte() -> str:
    """``WITH encounters AS (...), enc AS (...)``: raw extract and prepared encounters."""
    raw = encounters_duckdb_sql()
    parsed_nums = {"FC": "fc", "FR": "fr", "PA_Sistolica": "pas", "PA_Diastolica": "pad",
                   "SatO2": "sato2", "Temperatura": "temp", "Glasgow": "glasgow",
                   "FiO2_raw": "fio2", "Hemoglobina": "hemoglobina"}
    bools = {"Antecedente_HTA": "hta", "DVA": "dva", "Ventilacion_Mecanica": "ventilacion_mecanica",
             "Transfusiones": "transfusiones", "Compromiso_Conciencia": "compromiso_conciencia"}
    sel = ["row_id", "episodio AS Episodio", "fecha_alta AS Fecha_Alta", "triage AS Triage",
           "tipo_cama AS Tipo_Cama", "texto_libre AS Texto_Libre",
           f"{clean_label('validacion')} AS Resolucion"]
    sel += [f"{parse_decimal(src)} AS {dst}" for dst, src in parsed_nums.items()]
    sel += [f"{to_bool(src)} AS {dst}" for dst, src in bools.items()]
    parsed = ",\n    ".join(sel)
    t = "coalesce({}, false)"
    cat = "Categoria_Inferida"
    fio2, sat, gcs = "FiO2", "SatO2", "Glasgow"
    high = f"({t.format(f'{fio2} >= 0.50')})"
    resp = (f"(({cat} = 'ADULTO' AND (Ventilacion_Mecanica OR ({high} AND {t.format(f'{sat} <= 90')}))) "
            f"OR ({cat} = 'PEDIATRICO' AND (Ventilacion_Mecanica OR ({high} AND {t.format(f'{sat} < 92')}))) "
            f"OR ({cat} = 'NEO' AND (Ventilacion_Mecanica OR ({t.format(f'{fio2} >= 0.40')} AND {t.format(f'{sat} <= 92')}))))")
    neuro = (f"(({cat} = 'PEDIATRICO' AND {t.format(f'{gcs} <= 12')}) "
             f"OR ({cat} <> 'PEDIATRICO' AND ({t.format(f'{gcs} <= 8')} OR (Compromiso_Conciencia AND {t.format(f'{gcs} <= 12')}))))")
    circ = (f"(DVA OR ({cat} = 'ADULTO' AND {t.format('PA_Sistolica < 90')}) "
            f"OR (Transfusiones AND {t.format('Hemoglobina < 7')}))")
    triage = t.format(f"{num('Triage')} IN (1, 2)")
    return f"""WITH encounters AS ({raw}),
enc_parsed AS (
  SELECT {parsed}
  FROM encounters WHERE episodio IS NOT NULL
),
enc_text AS (
  SELECT *, CASE WHEN FiO2_raw > 1.0 THEN FiO2_raw / 100.0 ELSE FiO2_raw END AS FiO2,
    {clean_text('Texto_Libre')} AS __clean,
    {category('Tipo_Cama', 'Texto_Libre')} AS {cat}
  FROM enc_parsed
),
enc_flags AS (
  SELECT * EXCLUDE (__clean),
    {ALERT_SELECT},
    {resp} AS flag_resp_grave,
    {neuro} AS flag_neuro_grave,
    {circ} AS flag_circ_grave,
    {triage} AS flag_triage_critico
  FROM enc_text
),
enc AS (
  SELECT * REPLACE (coalesce(Tipo_Cama, 'desconocido') AS Tipo_Cama),
    flag_resp_grave OR flag_circ_grave OR flag_neuro_grave AS CUMPLE_CRITERIO_DECRETO
  FROM enc_flags
)"""


def scored_cte() -> str:
    """``encounters_cte`` plus ``scored``: label, rule and the deterministic fixture score."""
    return encounters_cte() + f""",
scored AS (
  SELECT e.*, {encode_label('Resolucion')} AS real,
    {FIXTURE_SCORE_SQL} AS p_pert
  FROM enc e
),
scored2 AS (
  SELECT *, CASE WHEN p_pert > 0.5 THEN 1 ELSE 0 END AS pred,
    greatest(p_pert, 1 - p_pert) AS conf
  FROM scored
)"""
