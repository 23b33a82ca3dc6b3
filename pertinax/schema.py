"""Canonical names, header maps and other fixed values.

Everything in the FIXED VALUES block must equal what the original application used so
that results agree (column names, token lists, patterns, labels).  They are stated as
plain text in their natural order.
"""

from __future__ import annotations

# =====================================================================================
# FIXED VALUES (must match the original application's behaviour)
# =====================================================================================

# Labels.
LABEL_POS = "PERTINENTE"
LABEL_NEG = "NO PERTINENTE"
LABEL_UNDETERMINED = "INDETERMINADO - Requiere revisión manual"
INT_TO_LABEL = {0: "NO PERTINENTE", 1: "PERTINENTE"}
# Label cleaning (exact, untrimmed): these become null, RECHAZO becomes NO PERTINENTE.
LABEL_NULL_TOKENS = ["ND", "Nd", "nd", "#N/D"]
LABEL_REJECT_TOKEN = "RECHAZO"

# Yes/no parsers.
BIN_MAP_YES = ["si", "sí", "s", "1"]
BIN_MAP_NO = ["no", "n", "0"]
BIN_EXACT_YES = ["Si", "Sí", "si", "sí"]
BIN_EXACT_NO = ["No", "no", "NO"]
TO_BOOL_TRUE = ["si", "sí", "s", "y", "x", "true", "1", "t", "yes", "verdadero"]
NULLISH_TOKENS = ["", "null", "none", "nan"]

# Text alerts: (pattern over cleaned text, slug).
TEXT_ALERTS = [
    (r"paro\s*card|arresto", "paro_cardiorrespiratorio"),
    (r"shock", "shock"),
    (r"sepsis|septico", "sepsis"),
    (r"acv|ictus|stroke|ataque cerebro|accidente cerebro|hsa|hcia", "acv"),
    (r"convulsion|status epilept", "convulsiones"),
    (r"coma|inconsciente|no responde", "coma"),
    (r"infarto|iam|stemi|scacest|scai|coronario agudo", "sindrome_coronario"),
    (r"dolor torac", "dolor_toracico"),
    (r"disnea|insuficiencia respiratoria|sdra|broncoaspir|crisis asma", "disnea"),
    (r"embol.? pulmon|tromboembolismo pulmon|\btep\b", "tep"),
    (r"hemorragia|sangrado|hematemesis|melena|hemoptisis", "hemorragia"),
    (r"trauma|politrauma|tce|accidente", "trauma"),
    (r"neumon", "neumonia"),
]

# Patient age category keywords (whole words, over lower-cased bed type + free text).
NEO_KEYWORDS = ["neo", "rn", "recien nacido", "prematuro", "incubadora", "cuna"]
PED_KEYWORDS = ["ped", "pediat", "infantil", "niño", "escolar", "lactante", "cuna"]

# Normalised header -> canonical column (normalised = accents stripped, blanks collapsed,
# lower-cased).
HEADER_MAP = {
    "id": "ID",
    "fecha formulario": "Fecha_Formulario",
    "episodio": "Episodio",
    "antecedentes cardiacos": "Antecedente_Cardiaco",
    "antecedentes diabeticos": "Antecedente_Diabetico",
    "antecedentes de hipertension arterial": "Antecedente_HTA",
    "triage": "Triage",
    "presion arterial sistolica": "PA_Sistolica",
    "presion arterial diastolica": "PA_Diastolica",
    "presion arterial media": "PA_Media",
    "temperatura en c": "Temperatura",
    "temperatura en °c": "Temperatura",
    "saturacion oxigeno": "SatO2",
    "frecuencia cardiaca": "FC",
    "frecuencia respiratoria": "FR",
    "tipo de cama": "Tipo_Cama",
    "glasgow": "Glasgow",
    "fio2": "FiO2_raw",
    "fio2 > o igual a 50%": "FiO2_ge50_flag",
    "fio2 >= o igual a 50%": "FiO2_ge50_flag",
    "ventilacion mecanica": "Ventilacion_Mecanica",
    "cirugia realizada": "Cirugia",
    "cirugia mismo dia ingreso": "Cirugia_mismo_dia",
    "hemodinamia realizada": "Hemodinamia",
    "hemodinamia mismo dia ingreso": "Hemodinamia_mismo_dia",
    "endoscopia": "Endoscopia",
    "endoscopia mismo dia ingreso": "Endoscopia_mismo_dia",
    "dialisis": "Dialisis",
    "trombolisis": "Trombolisis",
    "trombolisis mismo dia ingreso": "Trombolisis_mismo_dia",
    "pcr": "PCR",
    "hemoglobina": "Hemoglobina",
    "creatinina": "Creatinina",
    "nitrogeno ureico": "BUN",
    "sodio": "Sodio",
    "potasio": "Potasio",
    "dreo": "DREO",
    "troponinas alteradas": "Troponinas_Alteradas",
    "ecg alterado": "ECG_Alterado",
    "rnm protocolo stroke": "RNM_Stroke",
    "dva": "DVA",
    "transfusiones": "Transfusiones",
    "compromiso conciencia": "Compromiso_Conciencia",
    "texto libre": "Texto_Libre",
    "resolucion": "Resolucion",
}

# Form-file rename preset (training path).
RENAME_FORM = {
    "Frecuencia Cardiaca": "FC",
    "Frecuencia Respiratoria": "FR",
    "Presión Arterial Sistólica": "PAS",
    "Presión Arterial Diastólica": "PAD",
    "Saturación de Oxígeno": "SatO2",
    "Temperatura en °C": "Temp",
    "Escala de Dolor (EVA)": "Dolor",
    "Glasgow": "Glasgow",
    "Triage": "Triage",
    "Diagnóstico de Ingreso": "Diagnostico",
    "Horas de Observación": "HorasObservacion",
    "Número de Exámenes de Laboratorio": "NumExamenes",
    "Número de Procedimientos Realizados": "NumProcedimientos",
    "Número de Diagnósticos de Ingreso": "NumDiagnosticos",
    "Número de Diagnósticos de Egreso": "NumDiagnostEgreso",
    "Antecedentes Mórbidos": "AntMorbidos",
    "Cantidad de Medicamentos administrados": "CantMedicamentos",
    "Diagnóstico Cardiovascular": "DiagnosticoCardiovascular",
    "Diagnóstico Respiratorio": "DiagnosticoRespiratorio",
    "Diagnóstico Digestivo": "DiagnosticoDigestivo",
    "Diagnóstico Neurológico": "DiagnosticoNeurologico",
    "Diagnóstico Traumatológico": "DiagnosticoTraumatologico",
    "Diagnóstico Infeccioso": "DiagnosticoInfeccioso",
    "Diagnóstico Oncológico": "DiagnosticoOncologico",
    "Diagnóstico Psiquiátrico": "DiagnosticoPsiquiatrico",
    "Diagnóstico Ginecológico": "DiagnosticoGinecologico",
    "Diagnóstico Urológico": "DiagnosticoUrologico",
    "Diagnóstico Dermatológico": "DiagnosticoDermatologico",
    "Diagnóstico Oftalmológico": "DiagnosticoOftalmologico",
    "Antecedentes de Hipertensión Arterial": "HipertencionArterial",
    "Antecedentes Diabéticos": "DiabetesMellitus",
    "Antecedentes Cardíacos": "Cardiopatia",
    "Asma": "Asma",
    "Epilepsia": "Epilepsia",
    "Artrosis": "Artrosis",
    "Tabaquismo": "DislipidemiaTabaquismo",
    "Cirugía Previa": "CirugiaPrevia",
    "Alergias a Medicamentos": "AlergiasMedicamentos",
    "Hospitalización Reciente": "HospitalizacionReciente",
}

# Base-file rename preset.
RENAME_BASE = {
    "Saturacion_O2": "SatO2",
    "Temperatura en °C": "Temp",
    "Horas_Observacion": "HorasObservacion",
    "Numero_Examenes": "NumExamenes",
    "Numero_Procedimientos": "NumProcedimientos",
    "Numero_Diagnosticos_Ingreso": "NumDiagnosticos",
    "Numero_Diagnosticos_Egreso": "NumDiagnostEgreso",
    "Antecedentes_Morbidos": "AntMorbidos",
    "Cantidad_Medicamentos": "CantMedicamentos",
    "Resolucion": "Validacion",
}

# Evaluation rename preset (note the different accents from RENAME_FORM).
RENAME_EVAL = {
    "Frecuencia Cardíaca": "FC",
    "Frecuencia Respiratoria": "FR",
    "Presión Arterial Sistólica": "PAS",
    "Presión Arterial Diastólica": "PAD",
    "Saturación Oxígeno": "SatO2",
    "Temperatura en °C": "Temp",
    "Glasgow": "Glasgow",
    "Triage": "Triage",
    "Antecedentes de Hipertensión Arterial": "HipertencionArterial",
    "Antecedentes Diabéticos": "DiabetesMellitus",
    "Antecedentes Cardíacos": "Cardiopatia",
}

# Production feature candidates, in order.
PRODUCTION_FEATURES = [
    "FC", "FR", "PAS", "PAD", "SatO2", "Temp", "Dolor", "Glasgow", "Triage",
    "HorasObservacion", "NumExamenes", "NumProcedimientos", "NumDiagnosticos",
    "NumDiagnostEgreso", "CantMedicamentos",
    "DiagnosticoCardiovascular", "DiagnosticoRespiratorio", "DiagnosticoDigestivo",
    "DiagnosticoNeurologico", "DiagnosticoTraumatologico", "DiagnosticoInfeccioso",
    "DiagnosticoOncologico", "DiagnosticoPsiquiatrico", "DiagnosticoGinecologico",
    "DiagnosticoUrologico", "DiagnosticoDermatologico", "DiagnosticoOftalmologico",
    "HipertencionArterial", "DiabetesMellitus", "Cardiopatia", "Asma",
    "Epilepsia", "Artrosis", "DislipidemiaTabaquismo", "AntMorbidos",
    "CirugiaPrevia", "AlergiasMedicamentos", "HospitalizacionReciente",
    "Ratio_SatO2_FR", "Flag_Hipotension", "Flag_Taquicardia", "Flag_Fiebre",
    "Flag_DolorSevero", "Flag_GlasgowBajo", "Score_Gravedad", "Ratio_PAM",
    "TotalActividad", "Flag_AltaActividad", "Ratio_Examen_Hora", "Flag_TriageCritico",
]
PRODUCTION_NUMERIC = [
    "FC", "FR", "PAS", "PAD", "SatO2", "Temp", "Dolor", "Glasgow", "Triage",
    "HorasObservacion", "NumExamenes", "NumProcedimientos", "NumDiagnosticos",
    "NumDiagnostEgreso", "CantMedicamentos",
]
PRODUCTION_BINARY = [
    "DiagnosticoCardiovascular", "DiagnosticoRespiratorio", "DiagnosticoDigestivo",
    "DiagnosticoNeurologico", "DiagnosticoTraumatologico", "DiagnosticoInfeccioso",
    "DiagnosticoOncologico", "DiagnosticoPsiquiatrico", "DiagnosticoGinecologico",
    "DiagnosticoUrologico", "DiagnosticoDermatologico", "DiagnosticoOftalmologico",
    "HipertencionArterial", "DiabetesMellitus", "Cardiopatia", "Asma",
    "Epilepsia", "Artrosis", "DislipidemiaTabaquismo", "AntMorbidos",
    "CirugiaPrevia", "AlergiasMedicamentos", "HospitalizacionReciente",
]

# Clinical (decree) path: numeric and boolean canonical columns.
CLINICAL_NUMERIC = [
    "PA_Sistolica", "PA_Diastolica", "PA_Media", "Temperatura", "SatO2", "FC", "FR",
    "Glasgow", "PCR", "Hemoglobina", "Creatinina", "BUN", "Sodio", "Potasio", "DREO",
    "FiO2_raw",
]
CLINICAL_BOOL = [
    "FiO2_ge50_flag", "Ventilacion_Mecanica", "Cirugia", "Cirugia_mismo_dia", "Hemodinamia",
    "Hemodinamia_mismo_dia", "Endoscopia", "Endoscopia_mismo_dia", "Dialisis", "Trombolisis",
    "Trombolisis_mismo_dia", "DVA", "Transfusiones", "Troponinas_Alteradas", "ECG_Alterado",
    "RNM_Stroke", "Compromiso_Conciencia", "Antecedente_Cardiaco", "Antecedente_Diabetico",
    "Antecedente_HTA",
]

# Bulk-scoring contract: required columns, grouped.
REQUIRED_VITALS = ["FC", "FR", "PAS", "PAD", "SatO2", "Temp", "Glasgow", "Triage"]
REQUIRED_ANTECEDENTS = ["HipertencionArterial", "DiabetesMellitus", "Cardiopatia"]

# Clinical variables searched by name when profiling a new source (target, aliases).
VARIABLE_ALIASES = [
    ("Presión Arterial Sistólica", ["pa sistolica", "pas", "presion arterial sistolica", "sistolica", "pa_sistolica", "presión sistolica"]),
    ("Presión Arterial Diastólica", ["pa diastolica", "pad", "presion arterial diastolica", "diastolica", "pa_diastolica", "presión diastolica"]),
    ("Temperatura", ["temperatura", "temp", "temperatura en °c", "temperatura c", "t°"]),
    ("Saturación Oxígeno", ["saturacion", "sato2", "sat o2", "saturacion oxigeno", "saturación", "spo2"]),
    ("Frecuencia Cardíaca", ["fc", "frecuencia cardiaca", "frecuencia cardíaca", "freq cardiaca", "pulso"]),
    ("Frecuencia Respiratoria", ["fr", "frecuencia respiratoria", "freq respiratoria", "respiratoria"]),
    ("Glasgow", ["glasgow", "escala glasgow", "gcs"]),
    ("FiO2", ["fio2", "fio2", "fi o2", "fraccion inspirada"]),
    ("Ventilación Mecánica", ["ventilacion mecanica", "ventilación", "vm", "ventilacion"]),
    ("Cirugía", ["cirugia", "cirugía", "cx", "cirugia realizada"]),
    ("Hemodinamia", ["hemodinamia", "hemodinamica", "hd"]),
    ("Diálisis", ["dialisis", "diálisis", "hemodialisis"]),
    ("PCR", ["pcr", "proteina c reactiva"]),
    ("Hemoglobina", ["hemoglobina", "hb", "hgb"]),
    ("Creatinina", ["creatinina", "creat"]),
    ("Validación", ["validacion", "validación", "pertinente", "resolucion", "etiqueta", "clasificacion"]),
]
QUALITY_VITALS = ["Presión Arterial Sistólica", "Presión Arterial Diastólica", "Temperatura",
                  "Saturación Oxígeno", "Frecuencia Cardíaca", "Frecuencia Respiratoria", "Glasgow"]
QUALITY_PROCEDURES = ["Ventilación Mecánica", "Cirugía", "Hemodinamia", "Diálisis"]
QUALITY_LABEL = "Validación"

# Decision thresholds and method names.
HYBRID_CONFIDENCE = 0.55
DEFAULT_UNDETERMINED_PCT = 65.0
METHOD_HIGH_CONF = "ML (alta confianza)"
METHOD_DECREE = "Decreto 34"
METHOD_CONSERVATIVE = "ML (conservador)"
METHOD_PURE = "ML puro"
# Accuracy of the previous model version on the external set (for regression deltas).
PREVIOUS_ACCURACY = 0.6971
PREVIOUS_HITS = 366

# =====================================================================================
# Library naming (ours)
# =====================================================================================

ROW_ID = "row_id"

# Short encounter-extract headers -> canonical clinical columns.
RENAME_ENCOUNTERS = {
    "episodio": "Episodio",
    "fecha_alta": "Fecha_Alta",
    "fc": "FC",
    "fr": "FR",
    "pas": "PA_Sistolica",
    "pad": "PA_Diastolica",
    "sato2": "SatO2",
    "temp": "Temperatura",
    "glasgow": "Glasgow",
    "triage": "Triage",
    "fio2": "FiO2_raw",
    "hemoglobina": "Hemoglobina",
    "hta": "Antecedente_HTA",
    "dva": "DVA",
    "ventilacion_mecanica": "Ventilacion_Mecanica",
    "transfusiones": "Transfusiones",
    "compromiso_conciencia": "Compromiso_Conciencia",
    "tipo_cama": "Tipo_Cama",
    "texto_libre": "Texto_Libre",
    "validacion": "Resolucion",
}
