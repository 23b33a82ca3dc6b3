"""Clinical feature sets (F1–F4) as single projections.

The three numeric feature sets are namespaced on purpose: the production set (F1) and the
archive set (F2) share names such as ``Flag_Hipotension`` with different rules (<90/60 vs
<100), so they are never merged.  Each feature is emitted only when its inputs exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.functions.clean import bin_map, clean_text, finite, flag, safe_div, to_number


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def _sum(cols: list[Column]) -> Column:
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def coerce_production(df: DataFrame, numeric=None, binary=None) -> DataFrame:
    """Production-path coercion: numbers via C1, yes/no via C5 (unknown -> NULL)."""
    numeric = schema.PRODUCTION_NUMERIC if numeric is None else numeric
    binary = schema.PRODUCTION_BINARY if binary is None else binary
    conv = {c: to_number(c) for c in numeric if c in df.columns}
    conv.update({c: bin_map(c) for c in binary if c in df.columns})
    return df.withColumns(conv) if conv else df


def features_production(df: DataFrame, variant: str = "train", coerce: bool = True) -> DataFrame:
    """production feature set.

    ``variant='train'`` adds the pain flag (5-flag severity score) and the activity
    features; ``variant='serving'`` is the 4-flag serving copy.
    """
    if coerce:
        df = coerce_production(df)
    out: dict[str, Column] = {}
    c = F.col
    if _has(df, "SatO2", "FR"):
        out["Ratio_SatO2_FR"] = safe_div(c("SatO2"), c("FR") + 1)
    if _has(df, "PAS", "PAD"):
        out["Flag_Hipotension"] = flag((c("PAS") < 90) | (c("PAD") < 60))
        out["Ratio_PAM"] = (c("PAS") + 2 * c("PAD")) / 3
    if _has(df, "FC"):
        out["Flag_Taquicardia"] = flag(c("FC") > 100)
    if _has(df, "Temp"):
        out["Flag_Fiebre"] = flag(c("Temp") > 38)
    if variant == "train" and _has(df, "Dolor"):
        out["Flag_DolorSevero"] = flag(c("Dolor") >= 7)
    if _has(df, "Glasgow"):
        out["Flag_GlasgowBajo"] = flag(c("Glasgow") < 13)
    score_flags = ["Flag_Hipotension", "Flag_Taquicardia", "Flag_Fiebre", "Flag_DolorSevero",
                   "Flag_GlasgowBajo"]
    parts = [out[f] for f in score_flags if f in out]
    if parts:
        out["Score_Gravedad"] = _sum(parts)
    if variant == "train":
        if _has(df, "NumExamenes", "NumProcedimientos", "CantMedicamentos"):
            total = _sum([F.coalesce(c(n), F.lit(0.0))
                          for n in ("NumExamenes", "NumProcedimientos", "CantMedicamentos")])
            out["TotalActividad"] = total
            out["Flag_AltaActividad"] = flag(total > 5)
        if _has(df, "NumExamenes", "HorasObservacion"):
            out["Ratio_Examen_Hora"] = safe_div(c("NumExamenes"), c("HorasObservacion") + 1)
    if _has(df, "Triage"):
        out["Flag_TriageCritico"] = flag(c("Triage") <= 2)
    return df.withColumns(out) if out else df


def features_archive(df: DataFrame, sat: str = "Saturacion_O2") -> DataFrame:
    """F2: archive feature set (weighted severity score, hypotension at PAS < 100)."""
    c = F.col
    hipo = flag(c("PAS") < 100)
    hiper = flag(c("PAS") > 180)
    hipox = flag(c(sat) < 92)
    taqui = flag(c("FR") > 24)
    glas = flag(c("Glasgow") < 13)
    return df.withColumns({
        "Ratio_SatO2_FR": safe_div(c(sat), c("FR") + 1),
        "Ratio_PAS_Glasgow": safe_div(c("PAS"), c("Glasgow") + 1),
        "Presion_Pulso": c("PAS") - c("PAD"),
        "Presion_Media_Calc": (c("PAS") + 2 * c("PAD")) / 3,
        "Flag_Hipotension": hipo,
        "Flag_Hipertension_Critica": hiper,
        "Flag_Hipoxemia": hipox,
        "Flag_Taquipnea": taqui,
        "Flag_Glasgow_Bajo": glas,
        "Score_Gravedad": hipo * 2 + hiper * 1.5 + hipox * 2 + taqui * 1.5 + glas * 2,
        "SatO2_x_Glasgow": c(sat) * c("Glasgow"),
        "PA_x_FR": c("PAS") * c("FR"),
    })


def _as_int(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("int"), F.lit(0))


def features_interaction(df: DataFrame) -> DataFrame:
    """clinical interaction features (optional set); ±inf -> NULL."""
    c = F.col
    out: dict[str, Column] = {}
    if _has(df, "PA_Sistolica", "FC"):
        out["Shock_Index_Inv"] = safe_div(c("PA_Sistolica"), c("FC") + 1)
    if _has(df, "SatO2", "FR"):
        out["Eficiencia_Resp"] = finite(c("SatO2") * c("FR"))
    if _has(df, "SatO2", "FiO2"):
        out["Indice_Oxigenacion"] = safe_div(c("SatO2"), c("FiO2") + 0.01)
    if _has(df, "Glasgow", "FC"):
        out["Neuro_Cardiaco"] = finite(c("Glasgow") * c("FC"))
    if _has(df, "Hemoglobina", "Transfusiones"):
        out["Severidad_Anemia"] = finite(c("Hemoglobina") * _as_int(df, "Transfusiones"))
    if _has(df, "DVA", "PA_Sistolica"):
        out["Shock_Refractario"] = finite(_as_int(df, "DVA") * c("PA_Sistolica"))
    if _has(df, "BUN", "Creatinina"):
        out["Funcion_Renal"] = finite(c("BUN") * c("Creatinina"))
    if _has(df, "Temperatura", "FC"):
        out["Respuesta_Inflam"] = finite(c("Temperatura") * c("FC"))
    if _has(df, "FiO2", "SatO2"):
        out["Severidad_Hipoxemia"] = finite(c("FiO2") * (100 - c("SatO2")))
    if _has(df, "PA_Media", "Glasgow"):
        out["Perfusion_Cerebral"] = finite(c("PA_Media") * c("Glasgow"))
    if _has(df, "flag_resp_grave", "flag_circ_grave"):
        out["Fallo_Multiorganico"] = _as_int(df, "flag_resp_grave") * _as_int(df, "flag_circ_grave")
    if _has(df, "alert_shock", "DVA"):
        out["Shock_Distributivo"] = _as_int(df, "alert_shock") * _as_int(df, "DVA")
    if _has(df, "flag_resp_grave", "Glasgow"):
        out["Resp_Neuro_Combo"] = finite(_as_int(df, "flag_resp_grave") * c("Glasgow"))
    if _has(df, "PA_Sistolica", "PA_Diastolica"):
        out["Presion_Pulso"] = finite(c("PA_Sistolica") - c("PA_Diastolica"))
    interv = [_as_int(df, n) for n in ("Cirugia_mismo_dia", "Hemodinamia_mismo_dia",
                                       "Endoscopia_mismo_dia") if n in df.columns]
    if interv:
        out["Carga_Intervenciones"] = _sum(interv)
    return df.withColumns(out) if out else df


ALERT_COLUMNS = [f"alert_{slug}" for _, slug in schema.TEXT_ALERTS]


def text_alerts(df: DataFrame, text: str = "Texto_Libre") -> DataFrame:
    """13 regex alerts over the cleaned free text, as boolean ``alert_<slug>`` columns.

    The cleaned text is materialised once as a helper column, so the 13 ``rlike`` share it
    instead of re-running the accent/regex cleaning per alert.
    """
    src = F.col(text) if text in df.columns else F.lit("")
    tmp = "__clean_text"
    df = df.withColumn(tmp, clean_text(src))
    df = df.withColumns({f"alert_{slug}": F.col(tmp).rlike(pattern)
                         for pattern, slug in schema.TEXT_ALERTS})
    return df.drop(tmp)


def alert_list(df: DataFrame) -> Column:
    """Names of the text alerts that fired, as ARRAY<STRING>."""
    present = [c for c in ALERT_COLUMNS if c in df.columns]
    return F.array_compact(F.array(*[F.when(F.col(c), F.lit(c[len("alert_"):])) for c in present]))
