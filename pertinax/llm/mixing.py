"""Mixing sources to target weights (DataFrame functions only).

Every row gets a hash-random key.  The top bits of the key are a range bucket, so the buckets of
a source, in order, are the source range-sorted by key, and a source that holds a third of all
rows is spread over all buckets.  Word totals per (source, bucket), aggregated on the map side,
give the distributed prefix sums.  The bucket in which a source's budget ends is the only one
whose rows have to be sorted; the prefix sums inside it give the exact cut.  One row per source
then decides every document: whole epochs first, one more for keys before the cut, the words
that are left for the document at the cut, nothing more behind it.

Target weights: sources in code-point order (null last) weigh 1, 2, 3, repeating.  A target
stops at ``max_epochs`` times its source's words; the excess is shared again by weight until
none is above.  With the sources sorted by cap over weight that limit has a closed form: a
level L with ``target = min(cap, L * weight)`` and the targets adding up to all words.

Defined results: a null text has 0 words; a source without words has target 0; documents that
are equal in id and text share what is left at the cut evenly (rounded down, so at most their
number of words is lost); the key depends on the id only, so reruns agree; an empty table gives
an empty result.  The table of sources (one row each) passes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pertinax.llm.common import WORD, col, fresh
from pertinax.session import written

#: Range buckets per source, as bits of the 60-bit key.
BUCKET_BITS = 12
KEY_BITS = 60
SEED = "mix"
#: Above so many sources the table of cuts is joined by shuffle, salted, instead of broadcast.
MAX_BROADCAST_SOURCES = 100_000
SALTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 bits of MD5 over seed and id, as a long >= 0."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def bucket(key: Column) -> Column:
    return F.shiftright(key, KEY_BITS - BUCKET_BITS)


def targets(totals: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``(source, source_size)`` -> ``+ weight, target``; one row per source."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    capped = (totals
              .withColumn("weight", ((F.row_number().over(by_source) - 1) % 3 + 1).cast("long"))
              .withColumn("cap", F.col("source_size") * max_epochs)
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if exactly the sources before this one (in ratio order) stop at their cap; it
    # rises while the next source is below the level and falls afterwards, so it is the largest
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / F.sum("weight").over(after))
    return (capped.withColumn("level", level)
            .withColumn("level", F.max("level").over(everything))
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
            .select("source", "source_size", "weight", "target"))


def _per_source(rows: DataFrame, source: Column, key: Column, table: DataFrame, n: int) -> DataFrame:
    """Left join of a table with one row per source (its key column is ``of``): broadcast up to
    MAX_BROADCAST_SOURCES rows, beyond that a shuffle in which every source is salted."""
    if n <= MAX_BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), source.eqNullSafe(F.col("of")), "left")
    (salt,) = fresh(rows, "salt")
    salted = table.withColumn(salt + "_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn(salt, F.pmod(key, F.lit(SALTS)).cast("int"))
            .join(salted.hint("merge"), source.eqNullSafe(F.col("of")) & (F.col(salt) == F.col(salt + "_of")), "left")
            .drop(salt, salt + "_of"))


def cuts(keyed: DataFrame, max_epochs: int = 3) -> tuple[DataFrame, int]:
    """One row per source (and their number): target, whole epochs, and the place where the next
    epoch is cut.  ``keyed``: ``source, doc_id, size, key, tie`` of every row."""
    totals = written(keyed.groupBy("source", bucket(F.col("key")).alias("bucket"))
                     .agg(F.sum("size").alias("words")), "mix-totals")
    per_source = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), max_epochs)
    plan = (per_source
            .withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget DIV source_size"))
                        .otherwise(F.lit(0)).cast("long"))
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
            .withColumnRenamed("source", "of").drop("weight", "budget"))
    plan = written(plan, "mix-plan")
    n = plan.count()

    def holds_cut(words: str) -> Column:
        return (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col(words))

    running = Window.partitionBy("source").orderBy("bucket")
    spots = (totals.withColumn("before", F.sum("words").over(running) - F.col("words"))
             .join(plan.select("of", "rest"), F.col("source").eqNullSafe(F.col("of")))
             .where(holds_cut("words"))
             .select("of", F.col("bucket").alias("cut_bucket"), "before", "rest"))
    # the rows of each source's cut bucket, sorted by key; equal rows stand together
    edge = (_per_source(keyed, F.col("source"), F.col("key"), spots, n)
            .where(bucket(F.col("key")) == F.col("cut_bucket"))
            .groupBy("of", "before", "rest", "key", "doc_id", "tie")
            .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies")))
    inside = Window.partitionBy("of").orderBy("key", "doc_id", "tie")
    cut = (edge.withColumn("before", F.col("before") + F.sum("words").over(inside) - F.col("words"))
           .where(holds_cut("words"))
           .select("of", F.struct("key", "doc_id", "tie").alias("cut"),
                   F.expr("(rest - before) DIV copies").alias("cut_words")))
    mine, other = plan.alias("p"), cut.alias("c")
    table = mine.join(other, F.col("p.of").eqNullSafe(F.col("c.of")), "left").select(
        "p.of", "source_size", "target", "epochs", "cut", "cut_words")
    return written(table, "mix-cuts"), n


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The narrow table the plan works on, written once: one scan of the texts."""
    return written(docs.select(
        col(source_col).alias("source"), col(id_col).alias("doc_id"),
        n_words(col(text_col)).alias("size"), random_key(col(id_col), seed).alias("key"),
        F.xxhash64(col(text_col)).alias("tie")), "mix-keys")


def _taken(size: Column, place: Column) -> Column:
    """Words the mix takes of a document: whole epochs, and its share of the cut one."""
    extra = (F.when(place < F.col("cut"), size)
             .when(place == F.col("cut"), F.col("cut_words"))
             .otherwise(F.lit(0)))
    return (F.col("epochs") * size + F.coalesce(extra, F.lit(0))).cast("long")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source", max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``."""
    keyed = keyed_rows(docs, id_col, text_col, source_col, seed)
    table, n = cuts(keyed, max_epochs)
    place = F.struct("key", "doc_id", "tie")
    return (_per_source(keyed, F.col("source"), F.col("key"), table, n)
            .select("doc_id", "size", "source_size", "target",
                    _taken(F.col("size"), place).alias("taken")))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word (separators kept as they are)."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each starts before a word
    return F.array_join(F.slice(pieces, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """The mixed corpus, in the columns of ``docs``: every document once per epoch that takes
    it, the document at a source's cut up to its last taken word, documents that are not taken
    left out."""
    table, n = cuts(keyed_rows(docs, id_col, text_col, source_col, seed), max_epochs)
    # the documents travel as one struct, so no name of theirs can clash
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("doc"))
    text, doc_id = F.col("doc").getField(text_col), F.col("doc").getField(id_col)
    rows = rows.select("doc", n_words(text).alias("size"), random_key(doc_id, seed).alias("key"),
                       F.xxhash64(text).alias("tie"))
    joined = _per_source(rows, F.col("doc").getField(source_col), F.col("key"), table, n)
    joined = joined.withColumn("taken", _taken(
        F.col("size"), F.struct(F.col("key"), doc_id.alias("doc_id"), F.col("tie"))))
    # one element per copy: the words of that copy
    copies = F.when(F.col("taken") > 0, F.transform(
        F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) DIV size")),
        lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size"))))
    cut_text = F.when(F.col("part") < F.col("size"), first_words(text, F.col("part"))).otherwise(text)
    return (joined.withColumn("part", F.explode(copies))
            .select(*[(cut_text if c == text_col else F.col("doc").getField(c)).alias(c)
                      for c in docs.columns]))
