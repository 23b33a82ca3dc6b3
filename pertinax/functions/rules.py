"""Rule-based criteria as column expressions.

``patient_category`` (F5), ``decree_flags`` (F6) and ``clinical_alerts`` (F7) are pure
projections: one ``select`` over the input, no shuffle, no Python.  Absent input columns are
decided at plan time from ``df.columns`` and behave as NULL / false, as in the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.functions.clean import col, flag, strip_accents, to_number

NEO, PED, ADULT = "NEO", "PEDIATRICO", "ADULTO"


def _word_pattern(words: list[str]) -> str:
    # (?U): Unicode-aware \b, like Python's str regexes.
    return r"(?U)\b(" + "|".join(words) + r")\b"


NEO_PATTERN = _word_pattern(schema.NEO_KEYWORDS)
PED_PATTERN = _word_pattern(schema.PED_KEYWORDS)


def category_context(df: DataFrame, bed: str = "Tipo_Cama", text: str = "Texto_Libre") -> Column:
    """lower(bed + ' ' + text); a missing value reads as 'nan', a missing column as ''."""
    def part(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("nan")) if name in df.columns else F.lit("")
    return F.lower(F.concat_ws(" ", part(bed), part(text)))


def patient_category(ctx: Column, accent_insensitive: bool = False) -> Column:
    """NEO > PEDIATRICO > ADULTO by whole-word keywords (accents kept by default, so
    'UCI Pediátrico' stays ADULTO exactly as in the original)."""
    if accent_insensitive:
        ctx = strip_accents(ctx)
    return (F.when(ctx.rlike(NEO_PATTERN), F.lit(NEO))
            .when(ctx.rlike(PED_PATTERN), F.lit(PED))
            .otherwise(F.lit(ADULT)))


def _num(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    dtype = dict(df.dtypes)[name]
    return to_number(name) if dtype == "string" else F.col(name).cast("double")


def _bool(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def decree_flags(df: DataFrame, accent_insensitive: bool = False) -> DataFrame:
    """decree criteria per age category.

    Adds ``Categoria_Inferida`` (when absent), ``flag_resp_grave``, ``flag_neuro_grave``,
    ``flag_circ_grave``, ``flag_triage_critico`` and ``CUMPLE_CRITERIO_DECRETO``
    (resp or circ or neuro; triage is reported but not part of the master rule).
    Expects cleaned inputs: numbers as doubles (FiO2 as a fraction), yes/no as booleans.
    """
    if "Categoria_Inferida" not in df.columns:
        df = df.withColumn("Categoria_Inferida",
                           patient_category(category_context(df), accent_insensitive))
    cat = F.col("Categoria_Inferida")
    fio2, sat, gcs = _num(df, "FiO2"), _num(df, "SatO2"), _num(df, "Glasgow")
    pas, hb, triage = _num(df, "PA_Sistolica"), _num(df, "Hemoglobina"), _num(df, "Triage")
    vm, fio2_flag = _bool(df, "Ventilacion_Mecanica"), _bool(df, "FiO2_ge50_flag")
    comp, dva = _bool(df, "Compromiso_Conciencia"), _bool(df, "DVA")
    hemo, ciru = _bool(df, "Hemodinamia_mismo_dia"), _bool(df, "Cirugia_mismo_dia")
    endo, transf = _bool(df, "Endoscopia_mismo_dia"), _bool(df, "Transfusiones")
    rnm, tromb = _bool(df, "RNM_Stroke"), _bool(df, "Trombolisis_mismo_dia")

    high_fio2 = _true(fio2 >= 0.50) | fio2_flag
    resp = ((cat == ADULT) & (vm | (high_fio2 & _true(sat <= 90)))
            | (cat == PED) & (vm | (high_fio2 & _true(sat < 92)))
            | (cat == NEO) & (vm | (_true(fio2 >= 0.40) & _true(sat <= 92))))
    neuro = (((cat == PED) & _true(gcs <= 12))
             | ((cat != PED) & (_true(gcs <= 8) | (comp & _true(gcs <= 12))))
             | rnm | tromb)
    circ = (dva | ((cat == ADULT) & _true(pas < 90)) | hemo | ciru
            | (endo & transf) | (transf & _true(hb < 7)))
    return df.withColumns({
        "flag_resp_grave": resp,
        "flag_neuro_grave": neuro,
        "flag_circ_grave": circ,
        "flag_triage_critico": _true(triage.isin(1, 2)),
    }).withColumn("CUMPLE_CRITERIO_DECRETO",
                  F.col("flag_resp_grave") | F.col("flag_circ_grave") | F.col("flag_neuro_grave"))


# Clinical alert names (F7), in display order.
ALERT_NAMES = ["hipotension", "taquicardia", "fiebre", "glasgow_bajo", "triage_critico", "hipoxemia"]


def clinical_alerts(pas="PAS", pad="PAD", fc="FC", temp="Temp", glasgow="Glasgow",
                    triage="Triage", sat="SatO2") -> Column:
    """array of alert names that fire for one record (NULL inputs never fire)."""
    conds = [
        (col(pas) < 90) | (col(pad) < 60),
        col(fc) > 100,
        col(temp) > 38,
        col(glasgow) < 13,
        col(triage) <= 2,
        col(sat) < 90,
    ]
    return F.array_compact(F.array(*[
        F.when(_true(c), F.lit(name)) for c, name in zip(conds, ALERT_NAMES)]))
