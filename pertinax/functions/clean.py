"""Scalar cleaning expressions.

Every function maps ``Column | str -> Column`` and uses built-in Spark functions only, so
the whole cleaning stage stays inside whole-stage codegen (no Python UDF).

Missing-value policy: NaN and ±inf never leave this module — unparsable text, ``nan``,
``Infinity`` and division by zero all become SQL NULL, and every comparison used as a flag
goes through :func:`flag` (NULL -> 0), which is what the pandas original got from
``NaN < x == False``.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pertinax import schema

NUMERIC_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_EDGE_WS = " \t\r\n\f"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()`` for the ASCII blanks found in extracts (no regex)."""
    return F.btrim(col(c).cast("string"), F.lit(_EDGE_WS))


def flag(cond: Column) -> Column:
    """Boolean condition -> 0/1 int where a NULL comparison counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def finite(c: Column | str) -> Column:
    """C17: NaN / ±inf -> NULL."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL instead of raising (ANSI) or producing ±inf."""
    return finite(F.try_divide(num, den))


# ---------------------------------------------------------------------------- numbers

def _number_of(s: Column) -> Column:
    # surrounding blanks pass the guard; the cast itself trims them
    return F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))


def to_number(c: Column | str) -> Column:
    """Parse text as a double, NULL when it is not a plain decimal number.

    A regex guard comes before ``try_cast`` because Spark accepts ``'5d'``, ``'nan'`` and
    ``'Infinity'`` as doubles while the original treated them as unparsable.
    """
    return _number_of(col(c).cast("string"))


def parse_decimal(c: Column | str) -> Column:
    """Tolerant decimal parser for spreadsheet extracts.

    trim; '' / null / none / nan -> NULL; drop '%'; with both '.' and ',' the dots are
    thousands separators and the comma is the decimal mark; with only ',' it is the
    decimal mark; then parse or NULL.  ('1,234.56' therefore parses as 1.23456.)

    Compact on purpose (many columns are parsed in one generated method, which must stay
    small enough to be JIT-compiled): the null-like tokens need no test of their own since
    they fail the numeric guard, and one ``translate`` maps ',' -> '.' while deleting '.'.
    """
    t = F.translate(col(c).cast("string"), "%", "")
    t = F.when(t.contains(","), F.translate(t, ",.", ".")).otherwise(t)
    return _number_of(t)


def comma_to_dot(c: Column | str) -> Column:
    """Replace every ',' by '.', then parse or NULL."""
    return to_number(F.translate(col(c).cast("string"), ",", "."))


def fio2_fraction(c: Column | str) -> Column:
    """C4: FiO2 given as a percentage (> 1) becomes a fraction."""
    x = col(c)
    return F.when(x > 1.0, x / 100.0).otherwise(x)


# ---------------------------------------------------------------------------- yes / no

def _token(c: Column | str) -> Column:
    return F.lower(strip_ws(c))


def bin_map(c: Column | str) -> Column:
    """trim+lower; si/sí/s/1 -> 1, no/n/0 -> 0, anything else (incl. '1.0') -> NULL."""
    t = _token(c)
    return (F.when(t.isin(*schema.BIN_MAP_YES), F.lit(1))
            .when(t.isin(*schema.BIN_MAP_NO), F.lit(0))
            .cast("int"))


def bin_map_zero(c: Column | str) -> Column:
    """:func:`bin_map`, then NULL -> 0."""
    return F.coalesce(bin_map(c), F.lit(0))


def bin_exact(c: Column | str, numeric: bool = False) -> Column:
    """Exact-spelling parser (archive path).

    Text columns: only Si/Sí/si/sí -> 1 and No/no/NO -> 0, everything else -> 0 (so 'SI'
    gives 0).  Numeric columns (``numeric=True``): the number is kept, NULL -> 0.
    """
    if numeric:
        return F.coalesce(to_number(c), F.lit(0.0)).cast("int")
    x = col(c)
    return (F.when(x.isin(*schema.BIN_EXACT_YES), F.lit(1))
            .when(x.isin(*schema.BIN_EXACT_NO), F.lit(0))
            .otherwise(F.lit(0)))


def to_bool(c: Column | str, numeric: bool = False) -> Column:
    """Permissive boolean.  NULL -> false; numbers: != 0; text: one of
    si, sí, s, y, x, true, 1, t, yes, verdadero (after trim + lower)."""
    x = col(c)
    if numeric:
        return F.when(x.isNull() | F.isnan(x), F.lit(False)).otherwise(x != 0)
    return F.coalesce(_token(x).isin(*schema.TO_BOOL_TRUE), F.lit(False))


# ---------------------------------------------------------------------------- text

def _accent_table() -> tuple[str, str]:
    """Translation table built by rule: every Latin letter U+00C0–U+024F whose canonical
    decomposition is one base letter plus non-spacing marks maps to that base letter."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", ch)
                       if unicodedata.category(x) != "Mn")
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENT_SRC, _ACCENT_DST = _accent_table()


def plain_key(header: str) -> str:
    """Plan-time form of C10's header key, from the same accent table."""
    letters = header.translate(str.maketrans(_ACCENT_SRC, _ACCENT_DST))
    return " ".join("".join(x for x in letters if unicodedata.category(x) != "Mn").split()).lower()


def strip_accents(c: Column | str) -> Column:
    """NFD + drop non-spacing marks (ñ -> n, é -> e); NULL stays NULL."""
    return F.regexp_replace(F.translate(col(c), _ACCENT_SRC, _ACCENT_DST), r"\p{Mn}+", "")


def normalize_header(c: Column | str) -> Column:
    """Collapse runs of whitespace to one blank and trim."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalize_key(c: Column | str) -> Column:
    """Header key = normalize_header(strip_accents(h)).lower()."""
    return F.lower(normalize_header(strip_accents(c)))


def normalize_name(c: Column | str) -> Column:
    """C11: lower, trim, '_' -> ' ', drop '°', one pass of double -> single blank."""
    s = strip_ws(F.lower(F.coalesce(col(c), F.lit(""))))
    s = F.translate(s, "_", " ")
    s = F.translate(s, "°", "")
    return F.replace(s, F.lit("  "), F.lit(" "))


def join_key(c: Column | str) -> Column:
    """upper(trim(str(c))).  NULL keys stay NULL and therefore never match."""
    return F.upper(strip_ws(col(c)))


def clean_text(c: Column | str) -> Column:
    """NULL -> ''; strip accents; lower; runs outside [a-z0-9 whitespace] -> ' '."""
    s = F.lower(strip_accents(F.coalesce(col(c), F.lit(""))))
    return F.regexp_replace(s, r"[^a-z0-9\s]+", " ")


# ---------------------------------------------------------------------------- dates

def try_date(c: Column | str, fmt: str | None = None) -> Column:
    """C14: text -> timestamp, unparsable -> NULL.  Timestamps pass through."""
    x = col(c)
    return F.try_to_timestamp(x.cast("string"), F.lit(fmt)) if fmt else F.try_to_timestamp(x.cast("string"))


def month_period(ts: Column | str) -> Column:
    """C14: first instant of the month."""
    return F.date_trunc("month", col(ts))


def month_range(ts: Column | str, year: int, month: int) -> Column:
    """Range predicate for one calendar month (kept as a range so it pushes down)."""
    start = f"{year:04d}-{month:02d}-01 00:00:00"
    ny, nm = (year + 1, 1) if month == 12 else (year, month + 1)
    end = f"{ny:04d}-{nm:02d}-01 00:00:00"
    x = col(ts)
    return (x >= F.lit(start).cast("timestamp_ntz")) & (x < F.lit(end).cast("timestamp_ntz"))


def stamp(now: str | None = None) -> Column:
    """C15: '%Y-%m-%d %H:%M:%S' stamp; pass ``now`` for a deterministic literal."""
    if now is not None:
        return F.lit(now)
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def pct_round(c: Column | str, scale: int = 2) -> Column:
    """X * 100 rounded half-even (numpy semantics)."""
    return F.bround(col(c) * 100.0, scale)
