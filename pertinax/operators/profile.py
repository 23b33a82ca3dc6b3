"""Profiling and schema matching (Q1–Q5).

Column names become rows (a tiny DataFrame per source); column *contents* are profiled in
one distributed pass per source (value counts with map-side combine, exact order
statistics from :mod:`stats`).  Name matching is a single ``CASE`` projection over the
fixed alias table, so no join against it is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pertinax import schema
from pertinax.functions.clean import normalize_name, plain_key, to_number
from pertinax.operators import order, stats
from pertinax.session import written

YES_NO_TOKENS = ["si", "sí", "no", "s", "n"]
NUMBER_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}
LABEL_COLUMNS = ["VALIDACIÓN", "Validacion", "validacion", "PERTINENTE"]


def columns_as_rows(spark: SparkSession, df: DataFrame, source: str | None = None) -> DataFrame:
    """``(source, position, column)`` — one row per column of ``df``."""
    rows = [(source, i, c) for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "source string, position int, column string")


def name_match(name: Column, normalized: bool = False) -> Column:
    """Q2: first target whose alias is inside the normalised name, or whose alias contains
    it (so an empty name matches the first target and 'f' matches 'fc', as in the
    original).  NULL when no alias matches.  Pass an already normalised column with
    ``normalized=True`` (the alias tests then reference one column, not a nested
    expression per test)."""
    n = name if normalized else normalize_name(name)
    expr = None
    for target, aliases in reversed(schema.VARIABLE_ALIASES):
        cond = None
        for a in aliases:
            c = n.contains(F.lit(a)) | F.lit(a).contains(n)
            cond = c if cond is None else cond | c
        expr = F.when(cond, F.lit(target)) if expr is None else F.when(cond, F.lit(target)).otherwise(expr)
    return expr


def match_by_name(cols: DataFrame, data: DataFrame | None = None) -> DataFrame:
    """Q2 over a columns-as-rows frame: adds ``variable`` and ``method='nombre'``; with
    ``data`` (the source itself) also the completeness (%) of each column, as reported next
    to every detected variable."""
    out = cols.withColumn("__n", normalize_name("column"))
    out = out.withColumn("variable", name_match(F.col("__n"), normalized=True))
    out = out.withColumn("method", F.when(F.col("variable").isNotNull(), F.lit("nombre"))).drop("__n")
    if data is not None:
        from pertinax.operators.aggregate import completeness
        comp = completeness(data, data.columns).select("column", F.col("pct").alias("completeness"))
        out = out.join(comp, "column", "left")
    return out


def _names_matched(spark: SparkSession, names: list[str]) -> set[str]:
    """The column names that match a variable by name (a local relation: no job)."""
    rows = spark.createDataFrame([(c,) for c in names], "column string")
    return {r["column"] for r in rows.where(name_match(F.col("column")).isNotNull()).collect()}


def _contents(df: DataFrame, source: str, matched: set[str]) -> DataFrame:
    """One wide aggregate: per column its counts, and for columns that no name matched the
    number of unparsable values, the range and whether yes/no or label words occur."""
    aggs, rows, kinds = [F.count(F.lit(1)).alias("t")], [], dict(df.dtypes)
    for i, c in enumerate(df.columns):
        text = F.col(f"`{c}`") if kinds[c] in NUMBER_TYPES else F.col(f"`{c}`").cast("string")
        aggs.append(F.count(text).alias(f"n{i}"))
        facts = {"non_num": F.lit(0).cast("long"), "min": F.lit(None).cast("double"),
                 "max": F.lit(None).cast("double"), "yes": F.lit(False), "label": F.lit(False)}
        if c not in matched:
            kind = kinds[c]
            if kind in NUMBER_TYPES or kind.startswith("decimal"):   # typed: nothing to parse
                value = F.col(f"`{c}`").cast("double")
                num, yes, label = F.when(F.abs(value) < float("inf"), value), F.lit(False), F.lit(False)
            elif kind in ("date", "timestamp", "timestamp_ntz", "boolean"):
                num, yes, label = F.lit(None).cast("double"), F.lit(False), F.lit(False)
            else:
                num, yes = to_number(text), F.lower(text).isin(*YES_NO_TOKENS)
                label = F.upper(text).contains("PERTINENTE")
            aggs += [F.count_if(text.isNotNull() & num.isNull()).alias(f"x{i}"), F.min(num).alias(f"lo{i}"),
                     F.max(num).alias(f"hi{i}"), F.max(yes).alias(f"y{i}"), F.max(label).alias(f"l{i}")]
            facts = {"non_num": F.col(f"x{i}"), "min": F.col(f"lo{i}"), "max": F.col(f"hi{i}"),
                     "yes": F.coalesce(F.col(f"y{i}"), F.lit(False)),
                     "label": F.coalesce(F.col(f"l{i}"), F.lit(False))}
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col("t").alias("total"),
                             F.col(f"n{i}").alias("n"), (facts["non_num"] == 0).alias("numeric"),
                             facts["min"].alias("min"), facts["max"].alias("max"),
                             facts["yes"].alias("has_yes_no"), facts["label"].alias("has_pertinente")))
    return df.agg(*aggs).select(F.lit(source).alias("source"), F.inline(F.array(*rows)))


def column_profiles(sources: dict[str, DataFrame]) -> DataFrame:
    """Per source and column ``(source, position, column, total, n, numeric, min, max,
    has_yes_no, has_pertinente, n_distinct, median)``.

    Two phases.  First one wide aggregate per source, all in one job: nothing of it is
    shuffled but one row per task, and one row per column reaches the driver.  Columns that
    their name identifies are only counted.  Exact distinct counts and medians are then taken
    for the few columns whose rules still need them: yes/no or label words in the content, or
    a name that hints at a saturation.  ``numeric``: every non-null value parses as a number.
    """
    spark = next(iter(sources.values())).sparkSession
    keys = ["source", "column"]
    parts, hinted = [], {}
    matched = _names_matched(spark, sorted({c for df in sources.values() for c in df.columns}))
    for name, df in sources.items():
        hinted[name] = [c for c in _needs_median(df.columns) if c not in matched]
        parts.append(_contents(df, name, matched))
    facts = parts[0]
    for p in parts[1:]:
        facts = facts.unionByName(p)
    rows = facts.collect()
    facts = spark.createDataFrame(rows, facts.schema)
    longs = []
    for name, df in sources.items():
        words = [r["column"] for r in rows if r["source"] == name and (r["has_yes_no"] or r["has_pertinente"])]
        wanted = [c for c in df.columns if c in words or c in hinted[name]]
        if wanted:
            cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"),
                              F.lit(c in hinted[name]).alias("hint")) for c in wanted]
            longs.append(df.select(F.lit(name).alias("source"), F.inline(F.array(*cells))))
    if not longs:
        return facts.withColumns({"n_distinct": F.lit(0).cast("long"), "median": F.lit(None).cast("double")})
    long = longs[0]
    for x in longs[1:]:
        long = long.unionByName(x)
    counts = written(stats.value_counts(long, [*keys, "hint"]), "column-counts")
    distinct = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))
    facts = facts.join(distinct, keys, "left")  # one row per column on both sides
    if not any(hinted.values()):
        return facts.withColumn("median", F.lit(None).cast("double"))
    numbers = (counts.where("hint").withColumn("value", to_number("value")).where(F.col("value").isNotNull())
               .groupBy(*keys, "value").agg(F.sum("c").alias("c")))
    return facts.join(stats.exact_median(numbers, keys), keys, "left")


def content_match(p: DataFrame, name: Column | None = None) -> Column:
    """Q3 rules over a :func:`column_profiles` row (applied when no name matched);
    ``name`` is the normalised column name if already computed."""
    name = normalize_name(F.col("column")) if name is None else name
    has = lambda *subs: _any([name.contains(s) for s in subs])
    lo, hi, med = F.col("min"), F.col("max"), F.col("median")
    num = F.col("numeric") & (F.col("n") > 0)
    yes_no = (F.col("n_distinct") <= 3) & F.col("has_yes_no")
    return (F.when(F.col("n") == 0, F.lit(None))
            .when(yes_no & has("cirug", "cx"), F.lit("Cirugía"))
            .when(yes_no & has("ventil", "vm"), F.lit("Ventilación Mecánica"))
            .when(yes_no & has("dialisis", "hd"), F.lit("Diálisis"))
            .when(num & (lo >= 34) & (hi <= 42) & (hi - lo < 10) & has("temp"), F.lit("Temperatura"))
            .when(num & (lo >= 50) & (hi <= 100) & (med > 90) & has("sat", "o2", "ox"),
                  F.lit("Saturación Oxígeno"))
            .when(num & (lo >= 80) & (hi <= 250) & has("sist", "pas"), F.lit("Presión Arterial Sistólica"))
            .when(num & (lo >= 40) & (hi <= 150) & has("diast", "pad"), F.lit("Presión Arterial Diastólica"))
            .when(num & (lo >= 30) & (hi <= 200) & has("fc", "card", "pulso"), F.lit("Frecuencia Cardíaca"))
            .when(num & (lo >= 8) & (hi <= 60) & (hi - lo < 50) & has("fr", "respir"),
                  F.lit("Frecuencia Respiratoria"))
            .when(num & (lo >= 3) & (lo <= 15) & (hi <= 15) & has("glas", "gcs"), F.lit("Glasgow"))
            .when((F.col("n_distinct") < 10) & F.col("has_pertinente"), F.lit("Validación")))


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _needs_median(cols: list[str]) -> list[str]:
    """The median feeds one content rule only (names with sat / o2 / ox): plan-time subset."""
    return [c for c in cols if any(k in plain_key(c) for k in ("sat", "o2", "ox"))]


def detect_variables_many(sources: dict[str, DataFrame]) -> DataFrame:
    """Q2 + Q3 for several sources at once: ``(source, position, column, variable, method,
    completeness)`` — name match first, content rules otherwise."""
    prof = column_profiles(sources).withColumn("__n", normalize_name("column"))
    prof = prof.withColumns({"__by_name": name_match(F.col("__n"), normalized=True),
                             "__by_content": content_match(prof, F.col("__n"))})
    by_name, by_content = F.col("__by_name"), F.col("__by_content")
    return prof.select(
        "source", "position", "column",
        F.coalesce(by_name, by_content).alias("variable"),
        F.when(by_name.isNotNull(), F.lit("nombre"))
        .when(by_content.isNotNull(), F.lit("contenido")).alias("method"),
        F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0)).alias("completeness"))


def detect_variables(df: DataFrame, source: str | None = None) -> DataFrame:
    """Q2 + Q3 for one source."""
    out = detect_variables_many({source or "_": df})
    return out if source else out.withColumn("source", F.lit(None).cast("string"))


def quality_score(detected: DataFrame) -> DataFrame:
    """Q4: per source ``0.5·vitals(7) + 0.3·procedures(4) + 0.2·label`` in percent."""
    v = F.col("variable")
    agg = detected.groupBy("source").agg(
        F.count_distinct(F.when(v.isin(*schema.QUALITY_VITALS), v)).alias("vitals"),
        F.count_distinct(F.when(v.isin(*schema.QUALITY_PROCEDURES), v)).alias("procedures"),
        F.count_distinct(v).alias("variables"),
        F.max(v == schema.QUALITY_LABEL).alias("has_label"))
    has_label = F.coalesce(F.col("has_label"), F.lit(False))
    score = (F.col("vitals") / len(schema.QUALITY_VITALS) * 100 * 0.5
             + F.col("procedures") / len(schema.QUALITY_PROCEDURES) * 100 * 0.3
             + F.when(has_label, F.lit(100.0)).otherwise(F.lit(0.0)) * 0.2)
    return agg.select("source", "variables", "vitals", "procedures",
                      has_label.alias("has_label"), score.alias("score"))


def quality_ranking(scores: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Q5: rank sources by score; verdict at >= 70 (with / without labels)."""
    ranked = order.leaderboard(scores, "score", "source")
    verdict = (F.when((F.col("score") >= threshold) & F.col("has_label"), F.lit("excelente"))
               .when(F.col("score") >= threshold, F.lit("bueno_sin_validacion"))
               .otherwise(F.lit("moderada")))
    return ranked.withColumn("verdict", verdict)


def compat_ranking(sources: dict[str, DataFrame], reference: list[str],
                   label_cols: list[str] | None = None) -> DataFrame:
    """Q1: per source ``(source, rows, cols, common, missing, extra, compat, has_label,
    verdict, rank)`` against the reference column list (label columns excluded).

    Column arithmetic is plan-time; ``rows`` comes from one count per source, all in the
    same union so Spark runs the scans as one job.
    """
    label_cols = schema_label_columns() if label_cols is None else label_cols
    expected = [c for c in reference if c not in label_cols]
    parts = []
    for name, df in sources.items():
        cols = set(df.columns)
        common = len(cols & set(expected))
        compat = common / len(expected) * 100 if expected else 0.0
        has_label = any(c in cols for c in LABEL_COLUMNS)
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("source"), "rows", F.lit(len(df.columns)).alias("cols"),
            F.lit(common).alias("common"), F.lit(len(set(expected) - cols)).alias("missing"),
            F.lit(len(cols - set(reference))).alias("extra"), F.lit(float(compat)).alias("compat"),
            F.lit(has_label).alias("has_label")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lab = F.col("has_label")
    verdict = (F.when((F.col("compat") >= 100.0) & lab, F.lit("listo"))
               .when((F.col("compat") >= 90.0) & lab, F.lit("ajustes_menores"))
               .when(F.col("compat") >= 90.0, F.lit("sin_validaciones"))
               .otherwise(F.lit("baja_compatibilidad")))
    return order.leaderboard(out.withColumn("verdict", verdict), "compat", "source")


def schema_label_columns() -> list[str]:
    """Validation columns added to the reference form (excluded from compatibility)."""
    return ["validaciona", "validacion2", "validacion 3", "validacion4", "validacion5",
            "validacion6", "Validacion"]
