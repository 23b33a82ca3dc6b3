"""Clinical preparation plan: raw extract -> typed, flagged encounters.

``prepare_clinical`` is the Spark form of the original ``prepare_dataframe``: key filter
(P7), header normalisation (P4), decimal parsing (C2), FiO2 fraction (C4), booleans (C8),
label cleaning (P15), text alerts (F4), decree flags (F5/F6), bed-type default.  It is a
chain of projections and one filter: a single map-only stage, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.functions.clean import fio2_fraction, parse_decimal, to_bool
from pertinax.functions.features import text_alerts
from pertinax.functions.rules import decree_flags
from pertinax.operators.project import clean_label, normalize_columns, rename
from pertinax.plans.fixture import encounters


def prepare_clinical(df: DataFrame, key: str | None = "Episodio",
                     accent_insensitive: bool = False) -> DataFrame:
    if key and key in df.columns:
        df = df.where(F.col(key).isNotNull())
    df = normalize_columns(df)
    conv = {c: parse_decimal(c) for c in schema.CLINICAL_NUMERIC if c in df.columns}
    df = df.withColumns(conv) if conv else df
    df = df.withColumn("FiO2", fio2_fraction("FiO2_raw") if "FiO2_raw" in df.columns
                       else F.lit(None).cast("double"))
    conv = {c: to_bool(c) for c in schema.CLINICAL_BOOL if c in df.columns}
    df = df.withColumns(conv) if conv else df
    if "Resolucion" in df.columns:
        df = df.withColumn("Resolucion", clean_label("Resolucion"))
    df = text_alerts(df)
    df = decree_flags(df, accent_insensitive=accent_insensitive)
    bed = F.coalesce(F.col("Tipo_Cama"), F.lit("desconocido")) if "Tipo_Cama" in df.columns \
        else F.lit("desconocido")
    return df.withColumn("Tipo_Cama", bed)


def clinical_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounter extract renamed to canonical clinical columns (still raw strings)."""
    return rename(encounters(spark, sf_dir), schema.RENAME_ENCOUNTERS)


def prepared_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_clinical(clinical_encounters(spark, sf_dir))


# Clinical canonical names -> production-path names (F1/D1 use PAS/PAD/Temp).
CLINICAL_TO_PRODUCTION = {
    "PA_Sistolica": "PAS",
    "PA_Diastolica": "PAD",
    "Temperatura": "Temp",
    "Antecedente_HTA": "HipertencionArterial",
    "Antecedente_Diabetico": "DiabetesMellitus",
    "Antecedente_Cardiaco": "Cardiopatia",
    "Resolucion": "Validacion",
}


def production_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounter extract in the production (form/base) naming, raw strings."""
    return rename(clinical_encounters(spark, sf_dir), CLINICAL_TO_PRODUCTION)
