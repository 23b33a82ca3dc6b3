"""Personal data: patterns, and information-theoretic sanitisation of what surrounds them.

The patterns (email, ip, card, phone) find the protected entities.  A term that stands near the
same entity again and again tells who or what it is even after the entity is masked.  How much it
tells is estimated from the corpus: with ``n_te`` documents in which the term stands near the
entity (in a window of WINDOW words to each side), ``n_t`` documents that hold the term anywhere,
``n_e`` terms in all windows of the entity and ``N`` words in all,

    disclosure = log2(n_te * N / (n_t * n_e)) / log2(N / n_e)

is the pointwise mutual information of the two as a share of the entity's own information: 1 if
the term occurs with the entity only, 0 if it is independent of it.  Documents are counted, so a
name that a document uses often and puts beside its entity once still tells all, and a signature
counts as often as it was copied.  Every pair of entity and term is scored.  It counts unless it may
be chance: that a term of ``n_t`` documents meets the entity in ``n_te`` of them, at the rate
``q = n_e / N`` of the entity's windows among all words, has a probability of at most
``2 ** (-n_t * KL(n_te / n_t, q))`` (Chernoff's bound).  Of all pairs those are taken whose expected share
of chance meetings is CHANCE or less (Benjamini and Hochberg's rule, on a histogram of the pairs' bits).
So one meeting of a term that occurs nowhere else is enough where ``q`` is small, and tells as little or as
much of an ordinary rare word as of a name.  Terms whose disclosure
reaches GENERALISE are generalised wherever they stand in the corpus, those that reach REMOVE are
removed.

Three scans of the texts: windows of the mentions; occurrences of the terms that can still reach
a threshold; spans.  Terms travel to the tasks as a bit map of 16 bits a term, at most 16 MB (a fuller
map only lets more words through to the join), so what is broadcast has a fixed bound; what passes the map is joined with the terms
themselves, so a collision never shows in the result.

Defined results: a term is a run of letters and digits of any length and script (in text without
spaces, what stands between punctuation), other than an English function word of one or two letters
in lower case; a window takes its words wherever the nearest ones stand; a null text counts as empty; without any mention no term is sanitised; spans of
different kinds may overlap, as the patterns are independent; repeated rows give one result row
each; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pertinax.llm.bpe import slices
from pertinax.llm.common import col, map_batches
from pertinax.session import written

WINDOW = 8
#: Characters that are searched first for the words before a mention; more if they hold too few.
REACH = 200
#: English function words of one or two letters, no terms where written in lower case.
FUNCTION_WORDS = frozenset("a an as at be by do he i if in is it me my no of on or so to up us we".split())
GENERALISE = 0.95
REMOVE = 0.98
#: Greatest probability of a pair by chance.
CHANCE = 0.01
#: The bit map has MAP_LOAD places a term, and at least 2^MIN_MAP_BITS, at most 2^MAX_MAP_BITS (16 MB).
MAP_LOAD, MIN_MAP_BITS, MAX_MAP_BITS = 16, 20, 27
KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Numbers joined by dots: every four of them are one match of the ip pattern.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            length = sum(map(len, four)) + 3
            if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in four):
                yield start, start + length
            start += length + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the patterns, by kind and start."""
    out = [("email", *s) for s in _emails(text)]
    out += [("ip", *s) for s in _ips(text)]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> int:
    """A hash of what a mention stands for: spelling and separators do not count."""
    plain = value.lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", value)
    return term_hash(f"{kind}:{plain}")


def term_hash(term: str) -> int:
    """Spark's xxhash64 of a string, as a signed long."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def terms(text: str) -> list[str]:
    lowered = text.lower()
    return TERM.findall(lowered) if len(lowered) == len(text) else [t.lower() for t in TERM.findall(text)]


def _before(text: str, start: int) -> deque:
    """The last WINDOW words that end before ``start``, however far back they stand."""
    reach = REACH
    while True:
        lo = max(0, start - reach)
        # a word that the reach cuts is not seen whole yet; one that touches the mention is none
        found = deque((m for m in TERM.finditer(text, lo, start)
                       if (m.start() > lo or lo == 0) and m.end() < start), WINDOW)
        if lo == 0 or len(found) == WINDOW:
            return found
        reach *= 4


def _after(text: str, end: int) -> list[re.Match]:
    """The first WINDOW words that start after ``end``, however far on they stand."""
    return list(islice((m for m in TERM.finditer(text, end) if m.start() > end), WINDOW))


class Cover:
    """The stretches that mentions cover, merged, for look-ups by place."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted((a, b) for _, a, b in spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return k < len(self.ends) and self.starts[k] < end


def window(text: str, start: int, end: int, cover: Cover) -> list[str]:
    """The terms around a mention, without those inside any mention."""
    near = [*_before(text, start), *_after(text, end)]
    return [m[0].lower() for m in near if m[0] not in FUNCTION_WORDS and not cover.meets(m.start(), m.end())]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.lit(0).alias("row"), col(text_col).cast("string").alias("text"))


def co_occurrences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``entity, term, n_te, n_words`` over all mentions: documents, and words in the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch):
                found: dict[tuple[int, str], list[int]] = {}
                for text in texts:
                    spans, near = base_spans(text), Counter()
                    cover = Cover(spans)
                    for kind, a, b in spans:
                        who = entity(kind, text[a:b])
                        near.update((who, t) for t in window(text, a, b, cover))
                    for pair, n in near.items():
                        seen = found.setdefault(pair, [0, 0])
                        seen[0] += 1
                        seen[1] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.string()),
                     pa.array([n[0] for n in found.values()], pa.int64()),
                     pa.array([n[1] for n in found.values()], pa.int64())],
                    names=["entity", "term", "docs", "words"])

    seen = map_batches(_texts(docs, text_col), run, "entity long, term string, docs long, words long")
    return seen.groupBy("entity", "term").agg(F.sum("docs").alias("n_te"), F.sum("words").alias("n_words"))


def term_map(table: DataFrame) -> np.ndarray:
    """The bit map of the terms in a table, by their number; its non-zero words reach the driver."""
    count = table.agg(F.approx_count_distinct("term")).first()[0]
    size = min(max((MAP_LOAD * count).bit_length(), MIN_MAP_BITS), MAX_MAP_BITS)
    place = F.xxhash64("term").bitwiseAND(F.lit((1 << size) - 1))
    words = (table.select(F.shiftright(place, 6).alias("word"),
                          F.expr("shiftleft(1L, CAST(xxhash64(term) & 63 AS INT))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits"))).toArrow()
    out = np.zeros(1 << size - 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


class Wanted(dict):
    """term -> whether it may be in the map; a bounded memory of answers."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, 64 * len(bits) - 1

    def __missing__(self, term: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        place = term_hash(term) & self.mask
        self[term] = out = bool(int(self.bits[place >> 6]) >> (place & 63) & 1)
        return out


def occurrences(docs: DataFrame, bits: np.ndarray, text_col: str = "text") -> DataFrame:
    """``term, n_t``: documents of each term in the map, and all words under a null term."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(sent.value)
        for batch in batches:
            for _, texts in slices(batch):
                found, total = Counter(), 0
                for text in texts:
                    words = terms(text)
                    total += len(words)
                    found.update(set(words))
                kept = [t for t in found if wanted[t]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*kept, None], pa.string()),
                     pa.array([*(found[t] for t in kept), total], pa.int64())], names=["term", "n"])

    return (map_batches(_texts(docs, text_col), run, "term string, n long")
            .groupBy("term").agg(F.sum("n").alias("n_t")))


def least_bits(scored: DataFrame, pairs: int, chance: float = CHANCE) -> float:
    """The fewest bits at which ``chance`` of the taken pairs at most meet by chance: with ``r`` pairs of
    ``b`` bits or more, ``pairs * 2 ** -b <= chance * r``.  Bits are counted in steps of 1/16, up to 128."""
    step = F.least(F.floor(F.col("bits") * 16), F.lit(2048)).cast("int")
    counts = dict(scored.groupBy(step.alias("step")).agg(F.count(F.lit(1))).collect())
    taken, best = 0, float("inf")
    for k in sorted(counts, reverse=True):
        taken += counts[k]
        if pairs * 2.0 ** (-k / 16) <= chance * taken:
            best = k / 16
    return max(best, -np.log2(chance).item())


def disclosing_terms(docs: DataFrame, text_col: str = "text", threshold: float = GENERALISE) -> DataFrame:
    """``term, disclosure`` of the terms that reach the threshold for some entity; written."""
    pairs = written(co_occurrences(docs, text_col), "pii-pairs")
    sizes = pairs.groupBy("entity").agg(F.sum("n_words").alias("n_e"))
    counts = written(occurrences(docs, term_map(pairs), text_col), "pii-terms")
    total = counts.where(F.col("term").isNull()).agg(F.sum("n_t").alias("n")).scalar()
    scored = pairs.join(counts, "term").join(sizes, "entity").withColumn("n", total)
    own = F.when(F.col("n_e") < F.col("n"), F.log2(F.col("n") / F.col("n_e")))
    p, q = F.col("n_te") / F.col("n_t"), F.col("n_e") / F.col("n")
    share = F.least(F.lit(1.0), F.log2(p / q) / own)
    bits = F.col("n_te") * F.log2(p / q) + F.when(
        p < 1, (F.col("n_t") - F.col("n_te")) * F.log2((1 - p) / (1 - q))).otherwise(0.0)
    scored = written(scored.where(p > q).select("term", share.alias("share"), bits.alias("bits")), "pii-scored")
    table = scored.where(F.col("bits") >= least_bits(scored, pairs.count())).groupBy("term").agg(F.max("share").alias("disclosure")) \
        .where(F.col("disclosure") >= threshold)
    return written(table, "pii-disclosing")


def _mark(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         with_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and
    ``terms`` (array of term, start, end, disclosure), with the text if asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(term_map(table))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    hit = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    fields = [rows.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
              T.StructField("base_sha256", T.StringType()), T.StructField("base", T.StringType())]
    schema = T.StructType([*fields, T.StructField("hits", T.ArrayType(T.StructType([
        T.StructField("term", T.StringType()), T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType())])))])
    if with_text:
        schema = schema.add("text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, some = Wanted(sent.value), sent.value.any()
        for batch in batches:
            for part, texts in slices(batch):
                spans = [base_spans(t) for t in texts]
                marks = [_mark(s) for s in spans]
                hits = [[{"term": t, "start": m.start(), "end": m.end()} for m in TERM.finditer(text)
                         if wanted[t := m[0].lower()]]
                        if some and any(wanted[t] for t in set(terms(text))) else [] for text in texts]
                columns = [part.column(0),
                           *(pa.array([sum(x[0] == k for x in s) for s in spans], pa.int64()) for k in KINDS),
                           pa.array([hashlib.sha256(m.encode()).hexdigest() for m in marks], pa.string()),
                           pa.array(marks, pa.string()), pa.array(hits, pa.list_(hit))]
                if with_text:
                    columns.append(part.column(1))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = written(map_batches(rows, run, schema).withColumn("row_id", F.monotonically_increasing_id()), "pii-spans")
    confirmed = (found.where(F.size("hits") > 0).select("row_id", F.inline("hits"))
                 .join(table, "term").groupBy("row_id")
                 .agg(F.array_sort(F.collect_list(F.struct("start", "end", "term", "disclosure"))).alias("terms")))
    marked = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    return found.join(confirmed, "row_id", "left").withColumn(
        "spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), marked)).drop("hits", "row_id", "base")


def redact(text: str, spans: str, removed: set[tuple[int, int]]) -> str:
    """A text with its spans masked: patterns and generalised terms by their kind, removed terms
    by nothing; of overlapping spans the first, then longest, counts."""
    out, at = [], 0
    parsed = [(int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
    for a, b, kind in sorted(parsed):
        if a >= at:
            word = text[a:-b]
            mask = kind.upper() if kind != "term" else "NUMBER" if word.isdigit() else "NAME" if word[0].isupper() else "TERM"
            out += [text[at:a], "" if (a, -b) in removed else f"[{mask}]"]
            at = -b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``doc_id, text`` (masked), ``spans`` of every row."""
    table = disclosing_terms(docs, text_col, generalise)
    found = find(docs, table, id_col, text_col, with_text=True)
    gone = F.transform(F.filter(F.coalesce("terms", F.array()), lambda t: t["disclosure"] >= remove),
                       lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    rows = found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "spans", gone.alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t, s, {(g["start"], g["end"]) for g in gone}) for t, s, gone in zip(
                *(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)],
                                             names=["doc_id", "text", "spans"])

    return map_batches(rows, run, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType()),
                                              T.StructField("spans", T.StringType())]))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of every row, patterns and disclosing terms of the whole corpus."""
    return find(docs, disclosing_terms(docs, text_col), id_col, text_col).drop("terms")
