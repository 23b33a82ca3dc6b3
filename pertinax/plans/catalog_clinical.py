"""Registered queries: cleaning (C*), label handling (P15–P21), features and rules (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pertinax import schema
from pertinax.functions import clean as C
from pertinax.functions.features import (ALERT_COLUMNS, alert_list, features_archive,
                                         features_interaction, features_production, text_alerts)
from pertinax.functions.rules import category_context, clinical_alerts, patient_category
from pertinax.operators import metrics, project
from pertinax.plans import oracle as O
from pertinax.plans.clinical import (clinical_encounters, prepared_encounters,
                                     production_encounters)
from pertinax.plans.fixture import FIXTURE_SCORE_SQL, encounters
from pertinax.plans.registry import register
from pertinax.sources.tables import table

ENC = O.encounters_cte()


def labelled_rule(spark, sf_dir):
    """Prepared encounters with the encoded truth (``real``) and the rule as ``pred``."""
    df = prepared_encounters(spark, sf_dir)
    return df.select(schema.ROW_ID, project.encode_label("Resolucion").alias("real"),
                     F.col("CUMPLE_CRITERIO_DECRETO").cast("int").alias("pred"),
                     "CUMPLE_CRITERIO_DECRETO", "Categoria_Inferida")


# --------------------------------------------------------------------- flagship

@register("decree_vs_label_confusion", oracle=ENC + """,
lab AS (SELECT """ + O.encode_label("Resolucion") + """ AS real,
               CAST(CUMPLE_CRITERIO_DECRETO AS INTEGER) AS pred FROM enc)
SELECT g.real, g.pred, CAST(count(lab.real) AS BIGINT) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(real, pred)
LEFT JOIN lab ON lab.real = g.real AND lab.pred = g.pred
GROUP BY g.real, g.pred""")
def decree_vs_label_confusion(spark, sf_dir):
    """Flagship: clean -> category -> decree rule -> label -> 2x2 confusion."""
    return metrics.confusion_matrix(labelled_rule(spark, sf_dir), "real", "pred", (0, 1))


# --------------------------------------------------------------------- C1–C4

@register("c1_to_number", oracle="""WITH encounters AS (""" + O.encounters_duckdb_sql() + """)
SELECT row_id, """ + O.num("fc") + """ AS fc_num, """ + O.num("sato2") + """ AS sato2_num,
  """ + O.num("hemoglobina") + """ AS hb_num FROM encounters""")
def c1_to_number(spark, sf_dir):
    e = encounters(spark, sf_dir)
    return e.select(schema.ROW_ID, C.to_number("fc").alias("fc_num"),
                    C.to_number("sato2").alias("sato2_num"),
                    C.to_number("hemoglobina").alias("hb_num"))


@register("c2_parse_decimal", oracle="""WITH encounters AS (""" + O.encounters_duckdb_sql() + """)
SELECT row_id, """ + ", ".join(f"{O.parse_decimal(c)} AS {c}_val" for c in
                               ("fc", "sato2", "temp", "fio2", "hemoglobina")) + """ FROM encounters""")
def c2_parse_decimal(spark, sf_dir):
    e = encounters(spark, sf_dir)
    return e.select(schema.ROW_ID, *[C.parse_decimal(c).alias(f"{c}_val")
                                     for c in ("fc", "sato2", "temp", "fio2", "hemoglobina")])


@register("c3_comma_to_dot", oracle="""WITH encounters AS (""" + O.encounters_duckdb_sql() + """)
SELECT row_id, """ + O.num("replace(temp, ',', '.')") + """ AS temp_val,
  """ + O.num("replace(fio2, ',', '.')") + """ AS fio2_val FROM encounters""")
def c3_comma_to_dot(spark, sf_dir):
    e = encounters(spark, sf_dir)
    return e.select(schema.ROW_ID, C.comma_to_dot("temp").alias("temp_val"),
                    C.comma_to_dot("fio2").alias("fio2_val"))


@register("c4_fio2_fraction", oracle=ENC + """
SELECT row_id, FiO2_raw, FiO2 FROM enc""")
def c4_fio2_fraction(spark, sf_dir):
    return prepared_encounters(spark, sf_dir).select(schema.ROW_ID, "FiO2_raw", "FiO2")


# --------------------------------------------------------------------- C5–C8 yes/no

def _bin_exact_sql(x):
    return (f"(CASE WHEN {x} IN {O.in_list(schema.BIN_EXACT_YES)} THEN 1 "
            f"WHEN {x} IN {O.in_list(schema.BIN_EXACT_NO)} THEN 0 ELSE 0 END)")


@register("c5_c8_yes_no_parsers", oracle="""WITH encounters AS (""" + O.encounters_duckdb_sql() + """)
SELECT row_id, hta, dva,
  """ + O.bin_map("hta") + """ AS hta_bin_map, """ + O.bin_map("dva") + """ AS dva_bin_map,
  coalesce(""" + O.bin_map("hta") + """, 0) AS hta_bin_map_zero,
  coalesce(""" + O.bin_map("dva") + """, 0) AS dva_bin_map_zero,
  """ + _bin_exact_sql("hta") + """ AS hta_bin_exact, """ + _bin_exact_sql("dva") + """ AS dva_bin_exact,
  """ + O.to_bool("hta") + """ AS hta_to_bool, """ + O.to_bool("dva") + """ AS dva_to_bool
FROM encounters""")
def c5_c8_yes_no_parsers(spark, sf_dir):
    """The four yes/no parsers side by side (trap: they disagree on SI, x, true, ' sí ')."""
    e = encounters(spark, sf_dir)
    out = [schema.ROW_ID, "hta", "dva"]
    for c in ("hta", "dva"):
        out += [C.bin_map(c).alias(f"{c}_bin_map"), C.bin_map_zero(c).alias(f"{c}_bin_map_zero"),
                C.bin_exact(c).alias(f"{c}_bin_exact"), C.to_bool(c).alias(f"{c}_to_bool")]
    return e.select(*out)


# --------------------------------------------------------------------- C9–C13 text

@register("c9_c13_text_cleaning", oracle="""
SELECT doc_id, strip_accents(text) AS text_no_accents,
  """ + O.clean_text("text") + """ AS text_clean,
  lower(trim(regexp_replace(strip_accents(text), '\\s+', ' ', 'g'))) AS text_key
FROM documents""")
def c9_c13_text_cleaning(spark, sf_dir):
    """Accent stripping (C9), header-style key (C10) and alert cleaning (C13) over every
    document's whole text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.strip_accents("text").alias("text_no_accents"),
                    C.clean_text("text").alias("text_clean"),
                    C.normalize_key("text").alias("text_key"))


@register("c11_normalize_name", oracle="""
SELECT doc_id, replace(replace(replace(trim(lower(coalesce(source || '_' || lang || '°', ''))), '_', ' '), '°', ''), '  ', ' ') AS name_norm
FROM documents""")
def c11_normalize_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", C.normalize_name(F.concat("source", F.lit("_"), "lang", F.lit("°")))
                    .alias("name_norm"))


@register("c12_join_key", oracle="""WITH encounters AS (""" + O.encounters_duckdb_sql() + """)
SELECT row_id, upper(""" + O.trim_ws("episodio") + """) AS episodio_key FROM encounters""")
def c12_join_key(spark, sf_dir):
    e = encounters(spark, sf_dir)
    return e.select(schema.ROW_ID, C.join_key("episodio").alias("episodio_key"))


@register("c14_dates", oracle="""
SELECT o_orderkey, try_strptime(CAST(o_orderdate AS VARCHAR), '%Y-%m-%d %H:%M:%S') AS parsed,
  year(o_orderdate) AS yr, month(o_orderdate) AS mo,
  date_trunc('month', o_orderdate) AS month_start
FROM orders""")
def c14_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey",
                    C.try_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
                               "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("parsed"),
                    F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"),
                    C.month_period("o_orderdate").cast("timestamp_ntz").alias("month_start"))


@register("c16_c17_pct_and_guards", oracle=ENC + """
SELECT row_id, round_even((""" + FIXTURE_SCORE_SQL + """) * 100.0, 2) AS pct,
  CASE WHEN (FR + 1) = 0 THEN NULL ELSE SatO2 / (FR + 1) END AS ratio,
  coalesce(Glasgow, 0) AS gcs_filled, Glasgow IS NOT NULL AS has_gcs,
  Categoria_Inferida IN ('NEO', 'PEDIATRICO') AS is_child
FROM enc""")
def c16_c17_pct_and_guards(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir)
    return e.select(schema.ROW_ID, C.pct_round(F.expr(FIXTURE_SCORE_SQL)).alias("pct"),
                    C.safe_div(F.col("SatO2"), F.col("FR") + 1).alias("ratio"),
                    F.coalesce("Glasgow", F.lit(0.0)).alias("gcs_filled"),
                    F.col("Glasgow").isNotNull().alias("has_gcs"),
                    F.col("Categoria_Inferida").isin("NEO", "PEDIATRICO").alias("is_child"))


@register("c18_string_predicates", oracle="""
SELECT doc_id, starts_with(source, 'src1') AS src1x, contains(lower(text), 'license') AS has_license,
  substring(lang, 1, 1) AS lang_initial
FROM documents""")
def c18_string_predicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").startswith("src1").alias("src1x"),
                    F.lower("text").contains("license").alias("has_license"),
                    F.substring("lang", 1, 1).alias("lang_initial"))


# --------------------------------------------------------------------- P15–P21

@register("p15_p16_p18_labels", oracle="""WITH encounters AS (""" + O.encounters_duckdb_sql() + """),
l AS (SELECT row_id, validacion, """ + O.clean_label("validacion") + """ AS cleaned FROM encounters)
SELECT row_id, validacion, cleaned, """ + O.encode_label("cleaned") + """ AS encoded,
  CASE cleaned WHEN 'PERTINENTE' THEN 1 WHEN 'NO PERTINENTE' THEN 0 END AS encoded_exact,
  CASE """ + O.encode_label("cleaned") + """ WHEN 1 THEN 'PERTINENTE' WHEN 0 THEN 'NO PERTINENTE' END AS decoded
FROM l""")
def p15_p16_p18_labels(spark, sf_dir):
    e = encounters(spark, sf_dir)
    cleaned = project.clean_label("validacion")
    enc = project.encode_label(cleaned)
    return e.select(schema.ROW_ID, "validacion", cleaned.alias("cleaned"), enc.alias("encoded"),
                    project.encode_label(cleaned, "exact").alias("encoded_exact"),
                    project.decode_label(enc).alias("decoded"))


@register("p19_drop_unlabelled", oracle=ENC + """
SELECT row_id, """ + O.encode_label("Resolucion") + """ AS real FROM enc
WHERE """ + O.encode_label("Resolucion") + """ IS NOT NULL""")
def p19_drop_unlabelled(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir)
    df = e.select(schema.ROW_ID, project.encode_label("Resolucion").alias("real"))
    return project.drop_unlabelled(df, ["real"])


@register("p21_to_int_flags", oracle=ENC + """
SELECT row_id, CAST(flag_resp_grave AS INTEGER) AS flag_resp_grave,
  CAST(flag_circ_grave AS INTEGER) AS flag_circ_grave,
  CAST(flag_neuro_grave AS INTEGER) AS flag_neuro_grave, CAST(DVA AS INTEGER) AS DVA
FROM enc""")
def p21_to_int_flags(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir)
    cols = ["flag_resp_grave", "flag_circ_grave", "flag_neuro_grave", "DVA"]
    return project.to_int_flags(e.select(schema.ROW_ID, *cols), cols)


@register("p7_filter_with_key_report", oracle="""WITH encounters AS (""" + O.encounters_duckdb_sql() + """)
SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count(episodio) AS BIGINT) AS rows_after FROM encounters""")
def p7_filter_with_key_report(spark, sf_dir):
    _, report = project.filter_with_key(encounters(spark, sf_dir), "episodio")
    return report


# --------------------------------------------------------------------- F1–F7

def _prod_inputs(spark, sf_dir):
    return production_encounters(spark, sf_dir).select(
        schema.ROW_ID, "FC", "FR", "PAS", "PAD", "SatO2", "Temp", "Glasgow", "Triage",
        "HipertencionArterial")


_F1_SQL = """WITH encounters AS (""" + O.encounters_duckdb_sql() + """),
p AS (SELECT row_id, """ + ", ".join(f"{O.num(src)} AS {dst}" for dst, src in
                                     (("FC", "fc"), ("FR", "fr"), ("PAS", "pas"), ("PAD", "pad"),
                                      ("SatO2", "sato2"), ("Temp", "temp"), ("Glasgow", "glasgow"),
                                      ("Triage", "triage"))) + """,
      """ + O.bin_map("hta") + """ AS HipertencionArterial FROM encounters),
f AS (SELECT *,
  CASE WHEN FR + 1 = 0 THEN NULL ELSE SatO2 / (FR + 1) END AS Ratio_SatO2_FR,
  CAST(coalesce(PAS < 90 OR PAD < 60, false) AS INTEGER) AS Flag_Hipotension,
  (PAS + 2 * PAD) / 3 AS Ratio_PAM,
  CAST(coalesce(FC > 100, false) AS INTEGER) AS Flag_Taquicardia,
  CAST(coalesce(Temp > 38, false) AS INTEGER) AS Flag_Fiebre,
  CAST(coalesce(Glasgow < 13, false) AS INTEGER) AS Flag_GlasgowBajo,
  CAST(coalesce(Triage <= 2, false) AS INTEGER) AS Flag_TriageCritico
  FROM p)
SELECT *, Flag_Hipotension + Flag_Taquicardia + Flag_Fiebre + Flag_GlasgowBajo AS Score_Gravedad FROM f"""


@register("f1_features_production", oracle=_F1_SQL)
def f1_features_production(spark, sf_dir):
    """F1 on the production naming: C1 numbers (so '98%' and '36,5' are NULL here, as in
    the original production path), C5 yes/no, then the derived ratios and flags."""
    return features_production(_prod_inputs(spark, sf_dir), variant="train")


@register("f1_features_serving", oracle=_F1_SQL)
def f1_features_serving(spark, sf_dir):
    return features_production(_prod_inputs(spark, sf_dir), variant="serving")


@register("f2_features_archive", oracle=ENC + """,
a AS (SELECT row_id, PA_Sistolica AS PAS, PA_Diastolica AS PAD, SatO2 AS Saturacion_O2, FR, Glasgow,
  CAST(coalesce(PA_Sistolica < 100, false) AS INTEGER) AS h1,
  CAST(coalesce(PA_Sistolica > 180, false) AS INTEGER) AS h2,
  CAST(coalesce(SatO2 < 92, false) AS INTEGER) AS h3,
  CAST(coalesce(FR > 24, false) AS INTEGER) AS h4,
  CAST(coalesce(Glasgow < 13, false) AS INTEGER) AS h5 FROM enc)
SELECT row_id, PAS, PAD, Saturacion_O2, FR, Glasgow,
  CASE WHEN FR + 1 = 0 THEN NULL ELSE Saturacion_O2 / (FR + 1) END AS Ratio_SatO2_FR,
  CASE WHEN Glasgow + 1 = 0 THEN NULL ELSE PAS / (Glasgow + 1) END AS Ratio_PAS_Glasgow,
  PAS - PAD AS Presion_Pulso, (PAS + 2 * PAD) / 3 AS Presion_Media_Calc,
  h1 AS Flag_Hipotension, h2 AS Flag_Hipertension_Critica, h3 AS Flag_Hipoxemia,
  h4 AS Flag_Taquipnea, h5 AS Flag_Glasgow_Bajo,
  CAST(h1 * 2 + h2 * 1.5 + h3 * 2 + h4 * 1.5 + h5 * 2 AS DOUBLE) AS Score_Gravedad,
  Saturacion_O2 * Glasgow AS SatO2_x_Glasgow, PAS * FR AS PA_x_FR
FROM a""")
def f2_features_archive(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir).select(
        schema.ROW_ID, F.col("PA_Sistolica").alias("PAS"), F.col("PA_Diastolica").alias("PAD"),
        F.col("SatO2").alias("Saturacion_O2"), "FR", "Glasgow")
    return features_archive(e, sat="Saturacion_O2").withColumn(
        "Score_Gravedad", F.col("Score_Gravedad").cast("double"))


@register("f3_features_interaction", oracle=ENC + """
SELECT row_id,
  CASE WHEN FC + 1 = 0 THEN NULL ELSE PA_Sistolica / (FC + 1) END AS Shock_Index_Inv,
  SatO2 * FR AS Eficiencia_Resp,
  CASE WHEN FiO2 + 0.01 = 0 THEN NULL ELSE SatO2 / (FiO2 + 0.01) END AS Indice_Oxigenacion,
  Glasgow * FC AS Neuro_Cardiaco,
  Hemoglobina * CAST(Transfusiones AS INTEGER) AS Severidad_Anemia,
  CAST(DVA AS INTEGER) * PA_Sistolica AS Shock_Refractario,
  Temperatura * FC AS Respuesta_Inflam,
  FiO2 * (100 - SatO2) AS Severidad_Hipoxemia,
  CAST(flag_resp_grave AS INTEGER) * CAST(flag_circ_grave AS INTEGER) AS Fallo_Multiorganico,
  CAST(alert_shock AS INTEGER) * CAST(DVA AS INTEGER) AS Shock_Distributivo,
  CAST(flag_resp_grave AS INTEGER) * Glasgow AS Resp_Neuro_Combo,
  PA_Sistolica - PA_Diastolica AS Presion_Pulso
FROM enc""")
def f3_features_interaction(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir)
    base = set(e.columns)
    out = features_interaction(e)
    new = [c for c in out.columns if c not in base]
    return out.select(schema.ROW_ID, *new)


@register("f4_text_alerts", oracle=ENC + """
SELECT row_id, """ + ", ".join(ALERT_COLUMNS) + """ FROM enc""")
def f4_text_alerts(spark, sf_dir):
    e = clinical_encounters(spark, sf_dir).where(F.col("Episodio").isNotNull()).select(schema.ROW_ID, "Texto_Libre")
    return text_alerts(e).select(schema.ROW_ID, *ALERT_COLUMNS)


@register("f4_alert_list", oracle=ENC + """
SELECT row_id, array_to_string(list_filter([""" + ", ".join(
    f"CASE WHEN {c} THEN '{c[len('alert_'):]}' END" for c in ALERT_COLUMNS) + """], lambda x: x IS NOT NULL), ',') AS alerts
FROM enc""")
def f4_alert_list(spark, sf_dir):
    """the names of the alerts that fired, per record."""
    e = clinical_encounters(spark, sf_dir).where(F.col("Episodio").isNotNull()).select(schema.ROW_ID, "Texto_Libre")
    a = text_alerts(e)
    return a.select(schema.ROW_ID, F.array_join(alert_list(a), ",").alias("alerts"))


@register("f5_patient_category", oracle=ENC + """
SELECT Categoria_Inferida, CAST(count(*) AS BIGINT) AS n FROM enc GROUP BY 1""")
def f5_patient_category(spark, sf_dir):
    e = clinical_encounters(spark, sf_dir).where(F.col("Episodio").isNotNull())
    cat = patient_category(category_context(e))
    return e.groupBy(cat.alias("Categoria_Inferida")).agg(F.count(F.lit(1)).alias("n"))


@register("f6_decree_flags", oracle=ENC + """
SELECT row_id, Categoria_Inferida, flag_resp_grave, flag_neuro_grave, flag_circ_grave,
  flag_triage_critico, CUMPLE_CRITERIO_DECRETO FROM enc""")
def f6_decree_flags(spark, sf_dir):
    return prepared_encounters(spark, sf_dir).select(
        schema.ROW_ID, "Categoria_Inferida", "flag_resp_grave", "flag_neuro_grave",
        "flag_circ_grave", "flag_triage_critico", "CUMPLE_CRITERIO_DECRETO")


@register("f7_clinical_alerts", oracle=ENC + """
SELECT row_id, array_to_string(list_filter([
  CASE WHEN coalesce(PA_Sistolica < 90 OR PA_Diastolica < 60, false) THEN 'hipotension' END,
  CASE WHEN coalesce(FC > 100, false) THEN 'taquicardia' END,
  CASE WHEN coalesce(Temperatura > 38, false) THEN 'fiebre' END,
  CASE WHEN coalesce(Glasgow < 13, false) THEN 'glasgow_bajo' END,
  CASE WHEN coalesce(""" + O.num("Triage") + """ <= 2, false) THEN 'triage_critico' END,
  CASE WHEN coalesce(SatO2 < 90, false) THEN 'hipoxemia' END], lambda x: x IS NOT NULL), ',') AS alerts
FROM enc""")
def f7_clinical_alerts(spark, sf_dir):
    e = prepared_encounters(spark, sf_dir).withColumn("Triage_num", C.to_number("Triage"))
    alerts = clinical_alerts(pas="PA_Sistolica", pad="PA_Diastolica", temp="Temperatura",
                             triage="Triage_num")
    return e.select(schema.ROW_ID, F.array_join(alerts, ",").alias("alerts"))


@register("prepare_clinical_full", oracle=ENC + """
SELECT * EXCLUDE (Fecha_Alta) FROM enc""")
def prepare_clinical_full(spark, sf_dir):
    """The whole clinical preparation (P7, P4, C2, C4, C8, P15, F4, F5, F6) per row."""
    return prepared_encounters(spark, sf_dir).drop("Fecha_Alta")
