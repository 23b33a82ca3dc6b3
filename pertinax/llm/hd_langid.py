"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded by its code point.
A trigram is bound from the permuted vectors of its letters: ``roll(a, 2) * roll(b, 1) * c``.  A
document is the bundle (sum) of the trigrams of its words, a language prototype the bundle of its
training documents, and a document gets the language whose prototype has the largest cosine; the
cosine (0 if negative) is its score.

A text is lower-cased, every run of other characters than letters is a word border, and trigrams
are taken inside words with a border on both sides.  Whole texts are used; long ones are worked on
piece by piece with the last two symbols carried over, so the pieces never show in the result.

Prototypes are integer sums: each task sends one partial bundle per language, Spark adds them up,
and the driver gets languages x DIM numbers.  The order of the rows does not matter.

Defined results: a text that is null or has no letter gets ``und`` and score 0; ties between
languages go to the smaller name; rows without a language, or held out, are not learned from; if
there is nothing to learn from, every text is ``und``; repeated rows give one result row each; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pertinax.llm.common import col, map_batches, worker_state

DIM = 1024
#: Work at a time: characters, and cells of the table of counts (documents x trigrams).
SLICE_CHARS = 400_000
CELLS = 2_000_000
#: Trigrams whose vectors a Python worker keeps.
KEPT_VECTORS = 20_000
BORDER = 32
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or BORDER.  Built once per worker."""
    state = worker_state("hd_langid")
    if "letters" not in state:
        table = np.full(0x110000, BORDER, np.int64)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        state["letters"] = table
    return state["letters"]


def letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIM)
    return (2 * bits - 1).astype(np.float32)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of packed trigrams, one row each."""
    kept = worker_state("hd_langid").setdefault("vectors", {})
    if len(kept) > KEPT_VECTORS:
        kept.clear()
    out = np.empty((len(grams), DIM), np.float32)
    for k, g in enumerate(grams.tolist()):
        if (v := kept.get(g)) is None:
            a, b, c = (letter_cached(x) for x in (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))
            v = kept[g] = (np.roll(a, 2) * np.roll(b, 1) * c).astype(np.int8)
        out[k] = v
    return out


def letter_cached(code: int) -> np.ndarray:
    kept = worker_state("hd_langid").setdefault("letter_vectors", {})
    if code not in kept:
        kept[code] = letter_vector(code)
    return kept[code]


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def _grams(symbols: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed trigrams of a run of symbols and the rows they belong to; then the symbols and rows
    without repeated borders."""
    again = np.zeros(len(symbols), bool)
    again[1:] = (symbols[1:] == BORDER) & (symbols[:-1] == BORDER) & (row[1:] == row[:-1])
    symbols, row = symbols[~again], row[~again]
    if len(symbols) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), symbols, row
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    inside = (row[:-2] == row[2:]) & (b != BORDER)
    return ((a << 42) | (b << 21) | c)[inside], row[:-2][inside], symbols, row


def _long(text: str) -> Iterator[np.ndarray]:
    """The packed trigrams of one long text, piece by piece."""
    carry = np.array([BORDER], np.int64)
    for at in range(0, len(text), SLICE_CHARS):
        piece = text[at:at + SLICE_CHARS] + (" " if at + SLICE_CHARS >= len(text) else "")
        symbols = np.concatenate([carry, _codes(piece)])
        grams, _, symbols, _ = _grams(symbols, np.zeros(len(symbols), np.int64))
        yield grams
        carry = symbols[-2:]


def counted(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, grams, counts)``: distinct trigrams, and their counts in each of some rows.  The
    rows of all parts together are all texts with a letter; a long text may come in parts."""
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (chars == 0 or chars + len(texts[end]) <= SLICE_CHARS):
            chars += len(texts[end])
            end += 1
        if end == start + 1 and chars > SLICE_CHARS:
            parts = ((g, np.full(len(g), start)) for g in _long(texts[start]))
        else:
            some = texts[start:end]
            symbols = _codes(" " + "  ".join(some) + " ")
            row = np.repeat(np.arange(start, end), [len(t) + 2 for t in some])
            parts = [_grams(symbols, row)[:2]]
        for grams, row in parts:
            if not len(grams):
                continue
            distinct, which = _distinct(grams)
            step = max(1, CELLS // len(distinct))
            for lo in range(int(row[0]), int(row[-1]) + 1, step):
                a, b = np.searchsorted(row, (lo, lo + step))
                rows = np.arange(lo, min(lo + step, int(row[-1]) + 1))
                cells = (row[a:b] - lo) * len(distinct) + which[a:b]
                yield rows, distinct, np.bincount(cells, minlength=len(rows) * len(distinct)).reshape(
                    len(rows), len(distinct))
        start = end


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, without sorting where the alphabet is small."""
    parts = [grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF]
    seen = np.zeros(0x110000, bool)
    for p in parts:
        seen[p] = True
    alphabet = np.flatnonzero(seen)
    if len(alphabet) > 100:
        return np.unique(grams, return_inverse=True)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    n = len(alphabet)
    small = (number[parts[0]] * n + number[parts[1]]) * n + number[parts[2]]
    there = np.zeros(n ** 3, bool)
    there[small] = True
    found = np.flatnonzero(there)
    place = np.zeros(n ** 3, np.int64)
    place[found] = np.arange(len(found))
    return (alphabet[found // n // n] << 42) | (alphabet[found // n % n] << 21) | alphabet[found % n], place[small]


def bundles(texts: list[str]) -> np.ndarray:
    """One bundle per text, zero where it has no letter."""
    out = np.zeros((len(texts), DIM))
    for rows, grams, counts in counted(texts):
        out[rows] += counts.astype(np.float32) @ gram_vectors(grams)
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language -> prototype, from every row of ``docs`` whose language is not null."""
    rows = docs.where(col(lang_col).isNotNull()).select(
        col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for some, grams, counts in counted(texts):
                vectors = gram_vectors(grams)
                here = langs[some]
                for lang in set(here.tolist()):
                    part = counts[here == lang].sum(axis=0).astype(np.float64) @ vectors
                    sums[lang] = sums.get(lang, 0) + np.rint(part).astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIM, pa.string()), pa.array(range(DIM), pa.int32()), pa.array(total)],
                names=["lang", "dim", "total"])

    parts = map_batches(rows, run, "lang string, dim int, total long")
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "dim").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r["lang"], np.zeros(DIM))[r["dim"]] = r["total"]
    return {lang: out[lang] for lang in sorted(out)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``."""
    rows = docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"),
                       col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(prototypes)
        for batch in batches:
            langs, scores = classify([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=schema.names)

    return map_batches(rows, run, schema)


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text has no language, all columns kept."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(prototypes)
        for batch in batches:
            langs, _ = classify([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([lang != UNKNOWN for lang in langs], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def classifier(prototypes: dict[str, np.ndarray]):
    """texts -> (languages, scores)."""
    names = np.array([*prototypes, UNKNOWN])
    unit = np.array([p / max(np.linalg.norm(p), 1e-12) for p in prototypes.values()]).reshape(-1, DIM)

    def classify(texts: list[str]) -> tuple[list[str], np.ndarray]:
        best, score = np.full(len(texts), len(unit)), np.zeros(len(texts))
        if len(unit):
            for lo in range(0, len(texts), 1000):
                some = bundles(texts[lo:lo + 1000])
                length = np.linalg.norm(some, axis=1)
                cosine = some @ unit.T / np.maximum(length, 1e-12)[:, None]
                known = length > 0
                best[lo:lo + 1000][known] = cosine[known].argmax(axis=1)
                score[lo:lo + 1000][known] = np.clip(cosine[known].max(axis=1), 0.0, 1.0)
        return names[best].tolist(), score

    return classify
