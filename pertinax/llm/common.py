"""Helpers shared by the operators of this package."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a word separator and of a word, as the contracts of the queries define them.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other character is kept."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with any column of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def tie_break(df: DataFrame) -> Column:
    """A hash over all hashable columns: orders rows that are equal in every key."""
    plain = [col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("long")


_STATE: dict = {}


def worker_state(owner: str) -> dict:
    """What an operator keeps between the batches of a Python worker.  Workers are used again for
    other operators; the one that runs drops what the one before has left."""
    if _STATE.get("owner") != owner:
        _STATE.clear()
        _STATE["owner"] = owner
    return _STATE


#: Rows of an Arrow batch, unless the session sets its own number: texts can be long.
BATCH_ROWS = 1_000


def map_batches(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches that stay small for rows of texts."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_ROWS))
    return rows.mapInArrow(run, schema)
