"""Decree criteria: one row per branch and its nearest non-matching neighbour."""

from pertinax.functions.rules import decree_flags
from pertinax.plans.clinical import prepare_clinical

SCHEMA = ("id int, Tipo_Cama string, Texto_Libre string, FiO2 double, FiO2_ge50_flag boolean, "
          "SatO2 double, Glasgow double, PA_Sistolica double, Hemoglobina double, Triage double, "
          "Ventilacion_Mecanica boolean, Compromiso_Conciencia boolean, DVA boolean, "
          "Hemodinamia_mismo_dia boolean, Cirugia_mismo_dia boolean, Endoscopia_mismo_dia boolean, "
          "Transfusiones boolean, RNM_Stroke boolean, Trombolisis_mismo_dia boolean")


def row(i, bed="UCI Adulto", text=None, fio2=None, fflag=False, sat=None, gcs=None, pas=None,
        hb=None, triage=None, vm=False, comp=False, dva=False, hemo=False, ciru=False, endo=False,
        transf=False, rnm=False, tromb=False):
    def f(x):
        return None if x is None else float(x)
    return (i, bed, text, f(fio2), fflag, f(sat), f(gcs), f(pas), f(hb), f(triage), vm, comp, dva,
            hemo, ciru, endo, transf, rnm, tromb)


CASES = [
    # (row, expected category, resp, neuro, circ, triage)
    (row(1, vm=True), "ADULTO", True, False, False, False),
    (row(2, fio2=0.5, sat=90), "ADULTO", True, False, False, False),
    (row(3, fio2=0.5, sat=91), "ADULTO", False, False, False, False),
    (row(4, fio2=0.49, sat=80), "ADULTO", False, False, False, False),
    (row(5, fflag=True, sat=90), "ADULTO", True, False, False, False),
    (row(6, bed="Cuna", text="lactante", fio2=0.4, sat=92), "NEO", True, False, False, False),
    (row(7, bed="Cuna", fflag=True, sat=80), "NEO", False, False, False, False),
    (row(8, bed="x", text="escolar", fio2=0.5, sat=91.9), "PEDIATRICO", True, False, False, False),
    (row(9, bed="x", text="escolar", fio2=0.5, sat=92), "PEDIATRICO", False, False, False, False),
    (row(10, bed="x", text="escolar", gcs=12), "PEDIATRICO", False, True, False, False),
    (row(11, gcs=12), "ADULTO", False, False, False, False),
    (row(12, gcs=8), "ADULTO", False, True, False, False),
    (row(13, gcs=12, comp=True), "ADULTO", False, True, False, False),
    (row(14, gcs=13, comp=True), "ADULTO", False, False, False, False),
    (row(15, rnm=True), "ADULTO", False, True, False, False),
    (row(16, tromb=True), "ADULTO", False, True, False, False),
    (row(17, pas=89), "ADULTO", False, False, True, False),
    (row(18, pas=90), "ADULTO", False, False, False, False),
    (row(19, bed="x", text="escolar", pas=60), "PEDIATRICO", False, False, False, False),
    (row(20, dva=True), "ADULTO", False, False, True, False),
    (row(21, hemo=True), "ADULTO", False, False, True, False),
    (row(22, ciru=True), "ADULTO", False, False, True, False),
    (row(23, endo=True), "ADULTO", False, False, False, False),
    (row(24, endo=True, transf=True), "ADULTO", False, False, True, False),
    (row(25, transf=True, hb=6.9), "ADULTO", False, False, True, False),
    (row(26, transf=True, hb=7), "ADULTO", False, False, False, False),
    (row(27, triage=2), "ADULTO", False, False, False, True),
    (row(28, triage=3), "ADULTO", False, False, False, False),
    # accents are kept: 'pediátrico' is not the whole word 'pediat' (original behaviour)
    (row(29, bed="UCI Pediátrico"), "ADULTO", False, False, False, False),
    (row(30, bed="Sala", text="niño con fiebre"), "PEDIATRICO", False, False, False, False),
    (row(31, bed=None, text=None), "ADULTO", False, False, False, False),
]


def test_decree_branches(spark):
    df = spark.createDataFrame([c[0] for c in CASES], SCHEMA)
    got = {r["id"]: r for r in decree_flags(df).collect()}
    for case in CASES:
        r = got[case[0][0]]
        assert r["Categoria_Inferida"] == case[1], case[0][0]
        assert (r["flag_resp_grave"], r["flag_neuro_grave"], r["flag_circ_grave"],
                r["flag_triage_critico"]) == case[2:], case[0][0]
        assert r["CUMPLE_CRITERIO_DECRETO"] == (case[2] or case[3] or case[4])


def test_all_vitals_null_gives_no_flag(spark):
    df = spark.createDataFrame([row(1)], SCHEMA)
    r = decree_flags(df).first()
    assert not r["CUMPLE_CRITERIO_DECRETO"] and not r["flag_triage_critico"]


def test_accent_insensitive_option(spark):
    df = spark.createDataFrame([row(1, bed="UCI Pediátrico")], SCHEMA).drop("Texto_Libre")
    assert decree_flags(df, accent_insensitive=True).first()["Categoria_Inferida"] == "ADULTO"
    df2 = spark.createDataFrame([row(1, bed="Pediat. 2")], SCHEMA)
    assert decree_flags(df2).first()["Categoria_Inferida"] == "PEDIATRICO"


def test_prepare_clinical_from_raw_headers(spark):
    raw = spark.createDataFrame(
        [("EP1", "85%", "0,6", "Sí", "RECHAZO", "UCI Adulto", "Paro cardiaco y shock"),
         (None, "99", "21", "No", "ND", None, None)],
        "`Episodio` string, `Saturación Oxígeno` string, `FIO2` string, "
        "`Ventilación  Mecánica` string, `Resolución` string, `Tipo de Cama` string, `Texto libre` string")
    out = prepare_clinical(raw).collect()
    assert len(out) == 1                                 # P7: no key -> dropped
    r = out[0]
    assert r["SatO2"] == 85.0 and r["FiO2"] == 0.6 and r["Ventilacion_Mecanica"] is True
    assert r["Resolucion"] == "NO PERTINENTE"            # P15
    assert r["alert_paro_cardiorrespiratorio"] and r["alert_shock"]
    assert r["flag_resp_grave"] and r["CUMPLE_CRITERIO_DECRETO"]
