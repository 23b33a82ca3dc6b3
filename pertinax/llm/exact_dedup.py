"""Exact dedup by a heavy-hitter split (DataFrame functions only).

1. One scan turns every text into a SHA-256 digest of its A-Z-lower-cased form and writes the
   narrow table ``(doc_id, digest, row_id)`` to the shared folder.
2. ``freqItems`` (Spark's Misra-Gries summary: ``1 / support`` counters per task, merged)
   lists every digest that may hold more than ``support`` of all rows.
3. The listed digests are counted exactly; those that really reach ``support`` are the
   verified winners.  There are at most ``1 / support`` of them, so they are broadcast and the
   hot rows are settled on the map side, without a shuffle.
4. The remaining digests hold at most ``support`` of the rows each.  Their winners and sizes are
   aggregated, combined on the map side, and joined to the rows by digest.

Defined results: a null text counts as empty; the largest doc_id of equal texts stays (a null
doc_id is smaller than any other); of rows equal in text and doc_id exactly one stays; an empty
table gives an empty result; columns other than id and text are carried (``drop_duplicates``) or
ignored (``report``) whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pertinax.llm.common import col, fresh, lower_ascii, tie_break
from pertinax.session import written

#: A digest is frequent if it holds this share of all rows: far below an even shuffle
#: partition's share, and at most 1,000 digests are broadcast.
SUPPORT = 0.001


def digest_hex(text: Column) -> Column:
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow table of digests, written once; ``row_id`` tells repeated rows apart."""
    narrow = docs.select(col(id_col).alias("doc_id"), digest_hex(col(text_col)).alias("digest"),
                         F.monotonically_increasing_id().alias("row_id"))
    return written(narrow, "digests")


def winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``(digest, best struct(doc_id, row_id), group_size)`` of the digests that hold at least
    ``support`` of all rows: Misra-Gries candidates, verified by an exact count.  At most
    ``1 / support`` rows."""
    candidates = digests.freqItems(["digest"], support).select(
        F.explode("digest_freqItems").alias("digest"))
    exact = (digests.join(F.broadcast(candidates), "digest", "left_semi")
             .groupBy("digest")
             .agg(F.max(F.struct("doc_id", "row_id")).alias("best"),
                  F.count(F.lit(1)).alias("group_size")))
    total = digests.agg(F.count(F.lit(1)).alias("n")).scalar()
    return exact.where(F.col("group_size") >= total * support)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    digests = digest_table(docs, id_col, text_col)
    hot = winners(digests, support).select("digest", F.col("best").alias("hot_best"),
                                           F.col("group_size").alias("hot_size"))
    rows = digests.join(F.broadcast(hot), "digest", "left")
    settled = rows.where(F.col("hot_size").isNotNull()).select(
        "doc_id", "row_id", "digest", F.col("hot_best").alias("best"),
        F.col("hot_size").alias("group_size"))
    rest = rows.where(F.col("hot_size").isNull()).select("doc_id", "row_id", "digest")
    groups = rest.groupBy("digest").agg(F.max(F.struct("doc_id", "row_id")).alias("best"),
                                        F.count(F.lit(1)).alias("group_size"))
    shuffled = rest.join(groups, "digest").select("doc_id", "row_id", "digest", "best", "group_size")
    return settled.unionByName(shuffled).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    support: float = SUPPORT) -> DataFrame:
    """``docs`` without its duplicate rows, all columns kept.

    Rows of a frequent digest other than its winner leave on the map side.  What else has to go is
    found on the narrow table of ids and digests.  Rows equal in id and text are merged by an aggregate, which
    combines them on the map side; what it returns is joined to the list by the aggregate's own key, and by shuffle
    whatever the list's size, as that grows with the table.  So texts are shuffled once."""
    digest, hot_digest, best, row, key, of_key = fresh(docs, "digest", "hot_digest", "best", "row", "key", "of_key")
    digests = digest_table(docs, id_col, text_col)
    hot = written(winners(digests, support).select("digest", F.col("best.doc_id").alias("best_id")), "winners")
    rest = digests.join(F.broadcast(hot), "digest", "left_anti").select("digest", "doc_id")
    largest = rest.groupBy("digest").agg(F.max("doc_id").alias("best_id"))
    losers = rest.join(largest, "digest").where(~F.col("doc_id").eqNullSafe(F.col("best_id"))).select("digest", "doc_id")
    # a struct equals another of equal fields, nulls too, and is one key for the aggregate and the join
    listed = written(losers.distinct().select(F.struct("digest", "doc_id").alias(of_key)), "exact-copies")
    merged = (docs.withColumn(digest, digest_hex(col(text_col)))
              .join(F.broadcast(hot.select(F.col("digest").alias(hot_digest), F.col("best_id").alias(best))),
                    col(digest) == col(hot_digest), "left")
              .where(col(hot_digest).isNull() | col(id_col).eqNullSafe(col(best)))
              .groupBy(F.struct(col(digest).alias("digest"), col(id_col).alias("doc_id")).alias(key))
              .agg(F.min_by(F.struct(*[col(c) for c in docs.columns]), tie_break(docs)).alias(row)))
    # the condition on the merged row, always true, keeps the join behind the aggregate: before it, a row that is
    # repeated very often would go to one task
    of_list = (col(key) == col(of_key)) & col(row).isNotNull()
    return merged.join(listed.hint("merge"), of_list, "left_anti").select(
        *[col(row).getField(c).alias(c) for c in docs.columns])
