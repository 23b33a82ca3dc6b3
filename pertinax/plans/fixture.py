"""Stand-in clinical input derived from the driver's ``events`` table.

The driver tables hold no clinical extract, so the clinical operators run on this
deterministic view of ``events``: it only shapes rows into the raw extract schema (strings
with decimal commas, '%' suffixes, nine yes/no spellings, padded and missing keys, vitals out of range, dirty
labels).  It
does none of the library's work — every parser, rule and aggregate downstream treats it as an
arbitrary extract of that schema.

The same SQL text runs on Spark (``{events}`` bound to a DataFrame) and, with the
placeholder replaced by the view name, on DuckDB for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pertinax.sources.tables import table

ENCOUNTERS_SQL = """
SELECT event_id AS row_id,
 CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '  ep' || CAST(event_id AS string) || ' ' ELSE 'EP' || CAST(event_id AS string) END AS episodio,
 CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL '31' DAY ELSE ts + INTERVAL '62' DAY END AS fecha_alta,
 CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'ND' WHEN event_id % 83 = 0 THEN '0' ELSE CAST(45 + (event_id * 7) % 110 AS string) END AS fc,
 CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 127 = 0 THEN '-3' ELSE CAST(8 + (event_id * 5) % 30 AS string) END AS fr,
 CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 131 = 0 THEN '0' ELSE CAST(70 + (event_id * 13) % 130 AS string) END AS pas,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(40 + (event_id * 11) % 70 AS string) END AS pad,
 CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 137 = 0 THEN '120' WHEN event_id % 3 = 0 THEN CAST(80 + (event_id * 3) % 21 AS string) ELSE CAST(80 + (event_id * 3) % 21 AS string) || '%' END AS sato2,
 CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 139 = 0 THEN '51' WHEN event_id % 4 = 0 THEN CAST(35 + event_id % 6 AS string) || '.' || CAST(event_id % 10 AS string) ELSE CAST(35 + event_id % 6 AS string) || ',' || CAST(event_id % 10 AS string) END AS temp,
 CASE WHEN event_id % 7 = 0 THEN NULL WHEN value > 40.0 THEN CAST(3 + (event_id * 5) % 9 AS string) ELSE CAST(8 + (event_id * 5) % 8 AS string) END AS glasgow,
 CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS string) END AS triage,
 CASE WHEN event_id % 9 = 0 THEN '0,' || CAST(21 + event_id % 70 AS string) ELSE CAST(21 + event_id % 70 AS string) END AS fio2,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(5 + event_id % 11 AS string) || '.' || CAST(event_id % 10 AS string) END AS hemoglobina,
 CASE event_id % 9 WHEN 0 THEN 'Si' WHEN 1 THEN 'Sí' WHEN 2 THEN ' sí ' WHEN 3 THEN 's' WHEN 4 THEN '1' WHEN 5 THEN 'No' WHEN 6 THEN 'n' WHEN 7 THEN '0' ELSE NULL END AS hta,
 CASE event_id % 7 WHEN 0 THEN 'SI' WHEN 1 THEN 'x' WHEN 2 THEN 'true' WHEN 3 THEN 'No' ELSE NULL END AS dva,
 CASE WHEN event_id % 37 = 0 THEN 'Sí' ELSE 'No' END AS ventilacion_mecanica,
 CASE WHEN event_id % 41 = 0 THEN 'Sí' ELSE 'No' END AS transfusiones,
 CASE WHEN event_id % 43 = 0 THEN 'Sí' WHEN event_id % 47 = 0 THEN NULL ELSE 'No' END AS compromiso_conciencia,
 CASE event_type WHEN 'view' THEN 'UCI Adulto' WHEN 'signup' THEN 'UCI Pediátrico' WHEN 'error' THEN 'Cuna NEO' WHEN 'click' THEN 'Box Urgencia' ELSE NULL END AS tipo_cama,
 CASE user_id % 8 WHEN 0 THEN 'Dolor torácico, sospecha de IAM' WHEN 1 THEN 'Convulsión y coma' WHEN 2 THEN 'Neumonía: disnea' WHEN 3 THEN 'Accidente. Politraumatizado; sangrado' WHEN 4 THEN 'lactante con fiebre' WHEN 5 THEN 'TEP en estudio' WHEN 6 THEN 'control sano' ELSE CASE event_id % 5 WHEN 0 THEN 'Paro cardíaco presenciado' WHEN 1 THEN 'Shock mixto' WHEN 2 THEN 'Sepsis de foco urinario' WHEN 3 THEN 'ACV isquémico' ELSE NULL END END AS texto_libre,
 CASE WHEN event_id % 5 = 0 THEN NULL WHEN value > 40.0 THEN CASE WHEN event_id % 3 = 0 THEN ' pertinente ' ELSE 'PERTINENTE' END WHEN event_id % 10 = 1 THEN 'RECHAZO' WHEN event_id % 10 = 2 THEN 'ND' ELSE 'NO PERTINENTE' END AS validacion
FROM {events}
"""

# Deterministic stand-in model score (for decision/metric operators that need a score
# without a trained model).  Columns: row_id, p_pert.
FIXTURE_SCORE_SQL = "CAST(row_id * 37 % 101 AS double) / CAST(100 AS double)"


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw encounter extract (all STRING columns but ``row_id`` and ``fecha_alta``)."""
    return spark.sql(ENCOUNTERS_SQL, events=table(spark, sf_dir, "events"))


def encounters_duckdb_sql() -> str:
    return ENCOUNTERS_SQL.replace("{events}", "events")
