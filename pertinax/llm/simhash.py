"""SimHash near-dedup by a byte-position inverted index with count filtering.

A fingerprint is eight bytes.  Two fingerprints that differ in at most four bits agree in at least
four bytes, so four shared positional bytes are the guaranteed minimum of a pair that links.

The index lists, for each set of four positions and the bytes there, the fingerprints that have
them.  So the count filter is in the key: a pair stands in some list exactly if it shares the minimum of
positional bytes, and every pair below it is never formed.  Lists of single positional bytes, with
a tally across lists, would find the same pairs, but only after forming those that share one byte: of
``N`` evenly spread fingerprints ``8 * N^2 / 512`` pairs instead of ``70 * N^2 / 2^33``, a million times
as many.  Lists with one member go at once (a count aggregated on the map side).

* Lists of up to ``SHORT`` fingerprints are worked on one at a time: the bits of all pairs are compared.
  Of the links found, a list sends one per member, to the smallest member that links reach inside
  the list: what is shuffled afterwards grows with the lists, not with their squares.
* Fingerprints on a longer list (a large group of near copies) are never paired.  Each of them
  names all points at most two bits away.  Two fingerprints at most four bits apart share such a
  point, and any two that share one are at most four bits apart: all who name a point are linked,
  so one link from each to the smallest of them keeps every component.  The work is linear in the
  number of these fingerprints.  (For an odd distance one of the two is a bit nearer: the links
  then go to the smallest of the nearer ones.)

Equal fingerprints count once, whatever the number of their documents.  Components are found by
alternating stars, distributed.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is
linked like any other; a text of fewer words than a shingle is one shingle; the smallest doc_id
names a component, null only if all its ids are null; repeated rows give one result row each; an
empty table gives an empty result; other columns are carried or ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pertinax.llm.common import col, fresh, map_batches, tie_break, worker_state
from pertinax.llm.components import components
from pertinax.session import written

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Longest list whose members are compared with each other.
SHORT = 1024
#: Keys that the fingerprints of one component are spread over.
SALTS = 32
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: The bits of each set of four bytes.
MASKS = [_signed(sum(0xFF << 8 * p for p in four)) for four in combinations(range(8), 4)]


def _flips(bits: int) -> list[int]:
    """All masks of so many bits."""
    return [_signed(sum(1 << b for b in some)) for some in combinations(range(64), bits)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a text in UTF-8, as an unsigned integer."""
    words = text.lower().split()  # on bytes: A-Z only, and the six white space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    last = min(shingle, len(words)) - 1
    ends = (starts + lengths)[last:].tolist()
    starts = starts[:len(ends)].tolist()
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_digest
    for lo in range(0, len(ends), BLOCK):
        raw = b"".join([h(joined[a:b], SEED) for a, b in zip(starts[lo:lo + BLOCK], ends[lo:lo + BLOCK])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row (``fp`` as a signed long), written once."""
    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("text_hash"),
                       col(text_col).cast("string").cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text_hash", T.LongType()),
                           T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))],
                names=schema.names)

    return written(map_batches(rows, run, schema), "fingerprints")


def list_links(members: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of the members of one list: each to the smallest member that links inside the list
    reach from it."""
    members = np.unique(members)
    differ = (members[:, None] ^ members[None]).view(np.uint64)
    linked = np.bitwise_count(differ) <= max_bits
    least = np.arange(len(members))
    while True:
        lower = np.where(linked, least[None], len(members)).min(axis=1, initial=len(members))
        lower = lower[lower] if len(members) else lower
        if (lower == least).all():
            break
        least = lower
    moved = least != np.arange(len(members))
    return members[least[moved]], members[moved]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, short: int = SHORT) -> DataFrame:
    """``fp`` (distinct) -> ``a, b``: links that join exactly the fingerprints that a chain of
    steps of at most ``max_bits`` joins; at most 4."""
    if not 0 <= max_bits <= 4:
        raise ValueError("four shared bytes are guaranteed up to a distance of four bits")
    fp = F.col("fp")
    # the table is narrow, its entries are not: dealt out before they are made, to a fixed number of
    # partitions, as Spark would merge them by the size of the narrow rows
    spark = distinct.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    entries = distinct.repartition(parts, "fp").select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m)) for m in MASKS]))
                              .alias("positions", "bytes"))
    # joined by shuffle whatever the estimate: Spark sizes entries as the narrow rows they are made of, and would
    # send tens of millions of them through the driver
    sizes = (entries.groupBy("positions", "bytes").agg(F.count(F.lit(1)).alias("size"))
             .where("size > 1"))
    listed = written(entries.join(sizes.hint("merge"), ["positions", "bytes"]), "posting-lists")

    members = (listed.where(F.col("size") <= short).groupBy("positions", "bytes")
               .agg(F.collect_list("fp").alias("members")).select("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list_links(np.array(m.values, np.int64), max_bits) for m in batch.column(0)]
            a, b = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    paired = members.mapInArrow(run, "a long, b long").distinct()
    crowd = listed.where(F.col("size") > short).select("fp").distinct()
    return paired.union(_crowd_links(crowd, max_bits))


def _crowd_links(crowd: DataFrame, max_bits: int) -> DataFrame:
    """The links of fingerprints on long lists, through the points between them."""
    inner = [m for n in range(max_bits // 2 + 1) for m in _flips(n)]
    outer = _flips(max_bits // 2 + 1) if max_bits % 2 else []

    def around(masks: list[int], nearer: bool) -> DataFrame:
        return crowd.select("fp", F.explode(F.transform(
            F.array(*[F.lit(m) for m in masks]), lambda m: m.bitwiseXOR(F.col("fp")))).alias("point"),
            F.lit(nearer).alias("nearer"))

    named = around(inner, True).union(around(outer, False)) if outer else around(inner, True)
    points = (named.groupBy("point")
              .agg(F.min(F.when(F.col("nearer"), F.col("fp"))).alias("first"),
                   F.min("fp").alias("least"), F.max("fp").alias("most"))
              .where(F.col("first").isNotNull() & (F.col("least") != F.col("most"))))
    near = named.join(points.select("point", "first").hint("merge"), "point").where(F.col("fp") != F.col("first"))
    return near.select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
           max_bits: int = MAX_BITS, prints: DataFrame | None = None) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (hex), ``component_id, text_hash, fp,
    component`` (the smallest fingerprint of the component)."""
    prints = fingerprints(docs, id_col, text_col, shingle) if prints is None else prints
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    joined = components(links(distinct.select("fp"), max_bits))
    marked = written(distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left"), "components")
    # a component may hold a third of all fingerprints: its smallest id is looked up through SALTS keys
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    linked = marked.where(F.col("component").isNotNull())
    named = linked.groupBy("component").agg(F.min("first_id").alias("component_id")).select(
        "component", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    classes = linked.select("fp", "component", salt.alias("salt")).join(named.hint("merge"), ["component", "salt"]).select(
        "fp", "component", "component_id").unionAll(
        marked.where(F.col("component").isNull()).select("fp", F.col("fp").alias("component"), F.col("first_id").alias("component_id")))
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        "text_hash", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component (its smallest doc_id, null last; of rows equal in
    id and text, one), all columns kept.

    The rows that something happens to are written as a narrow table.  All rows are joined to it by shuffle
    whatever its size, as it grows with the table: texts are shuffled once."""
    found = report(docs, id_col, text_col, shingle, max_bits)
    keys = found.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    best = keys.groupBy("component").agg(F.min(order).alias("least"))
    # the row that stays is looked up by its whole key, so a component's rows spread
    best = best.select(F.col("component").alias("in"), F.col("least.doc_id").alias("best_id"), F.col("least.text_hash").alias("best_hash"))
    same = ((F.col("component") == F.col("in")) & F.col("doc_id").eqNullSafe(F.col("best_id"))
            & F.col("text_hash").eqNullSafe(F.col("best_hash")))
    touched = keys.join(best, same, "left").select(
        F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "copies", F.col("in").isNotNull().alias("kept"))
    touched = written(touched.where(~F.col("kept") | (F.col("copies") > 1)), "near-copies")
    text_hash, tie, rank = fresh(docs, "text_hash", "tie", "rank")
    rows = docs.withColumn(text_hash, F.xxhash64(col(text_col)))

    def joined(table: DataFrame, how: str) -> DataFrame:
        return rows.join(table, col(id_col).eqNullSafe(table["of_id"]) & (col(text_hash) == table["of_hash"]), how)

    once = Window.partitionBy(col(id_col), col(text_hash)).orderBy(col(tie))
    repeated = joined(touched.where("kept"), "left_semi").withColumn(tie, tie_break(docs))
    repeated = repeated.withColumn(rank, F.row_number().over(once)).where(col(rank) == 1)
    columns = [col(c) for c in docs.columns]
    return joined(touched.hint("merge"), "left_anti").select(*columns).unionAll(repeated.select(*columns))
