"""Token ids in shard files: a shared zstandard dictionary, one frame per document.

A store is a folder on storage that all nodes see:

* ``dictionary``: a zstandard dictionary trained on serialized id arrays of a bounded sample;
* ``shard-NNNNN``: magic, version and SHA-256 of the dictionary, then one compressed frame per
  document, then the index (doc ids, null flags, ends of the frames, token counts), then the place
  of the index, the number of documents and the magic again.  Documents ascend by id inside a
  shard and from shard to shard, so a document is found by two binary searches and only its own
  frame is read;
* ``manifest``: JSON with the dictionary's hash and, per shard, its first id, its documents, its
  tokens and the tokens of all shards before it.

Writing: one scan encodes and compresses (the texts are never shuffled), the frames are range
partitioned by id, sorted, and each task writes its shard under a temporary name and renames it,
so a task that runs again replaces its shard with an equal one.  The driver sees one summary row
per shard.

Defined results: a null text counts as empty and holds the end id alone; null ids come first; rows
with equal ids stand next to each other, by token count and frame; an empty table gives a store
without shards; ids must be integers; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pertinax.llm.bpe import codec, slices
from pertinax.llm.common import col, map_batches, worker_state
from pertinax.session import written

MAGIC, VERSION = b"PTXTOK\x00\x01", 1
HEAD, HEAD_SIZE = "<8sI32s", 44
FOOT, FOOT_SIZE = "<QQ8s", 24
#: The sample that trains the dictionary: documents, and ids of each at most.
SAMPLE_DOCS = 1_000
SAMPLE_IDS = 4_096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, data: bytes) -> None:
    where, path = _open(uri)
    with where.open_output_stream(path) as out:
        out.write(data)


def _get(uri: str) -> bytes:
    where, path = _open(uri)
    with where.open_input_file(path) as f:
        return f.read()


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str,
            dictionary: bytes | None = None, most: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, frame``: the ids with the end id, compressed if there is a dictionary,
    cut to ``most`` ids for a sample."""
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"the store needs integer ids, {id_col!r} is {kind}")
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        pack = compressor(dictionary).compress if dictionary is not None else bytes
        for batch in batches:
            for part, texts in slices(batch):
                ids = [e + end for e in c.encode(texts)]
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                frames = pa.array([pack(drawn_blocks(i, most) if most else i) for i in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, frames],
                                                 names=["doc_id", "n_tokens", "frame"])

    return map_batches(rows, run, "doc_id long, n_tokens long, frame binary")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))


def drawn_blocks(ids: bytes, most: int, block: int = 256) -> bytes:
    """At most ``most`` ids of a document: blocks from all over it, chosen by a hash of its ids."""
    if len(ids) <= 4 * most:
        return ids
    places = np.random.default_rng(zlib.crc32(ids)).choice(-(-len(ids) // (4 * block)), most // block, replace=False)
    return b"".join(ids[4 * block * k:4 * block * (k + 1)] for k in sorted(places.tolist()))


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> bytes:
    """A dictionary from the id arrays of SAMPLE_DOCS documents, those with the smallest hashes, and of
    each at most SAMPLE_IDS ids; as raw content where there are too few of them to train on, empty for an
    empty table.  The same table gives the same dictionary."""
    of_id = "__id"
    # narrow: ids alone are hashed, and the texts are read again for the few that are drawn
    drawn = docs.select(col(id_col).alias(of_id)).distinct().orderBy(F.xxhash64(of_id), of_id).limit(SAMPLE_DOCS)
    few = docs.join(F.broadcast(drawn), col(id_col).eqNullSafe(F.col(of_id))).groupBy(F.col(of_id).alias(id_col)).agg(
        F.min_by(col(text_col).cast("string"), F.struct(F.xxhash64(col(text_col)), col(text_col))).alias(text_col))
    sample = encoded(few, tokenizer, end_id, id_col, text_col, most=SAMPLE_IDS)
    arrays = sorted(bytes(r["frame"]) for r in sample.select("frame").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[-DICTIONARY_BYTES:]


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
          text_col: str = "text") -> str:
    """Encode ``docs`` into a new store under ``folder`` (a URI or an absolute path)."""
    where, root = _open(folder)
    where.create_dir(root, recursive=True)
    dictionary = train_dictionary(docs, tokenizer, end_id, id_col, text_col)
    _put(f"{folder}/dictionary", dictionary)
    digest = hashlib.sha256(dictionary).digest()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("token_store")  # the tokenizer is not needed any more
        task = TaskContext.get()
        name = f"shard-{task.partitionId():05d}"
        ids, ends, counts, out, at = [], [], [], None, HEAD_SIZE
        where, root = _open(folder)
        hidden = f"{root}/.{name}-{task.taskAttemptId()}"
        for batch in batches:
            if out is None and batch.num_rows:
                out = where.open_output_stream(hidden)
                out.write(struct.pack(HEAD, MAGIC, VERSION, digest))
            ids += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            for frame in batch.column(2):
                out.write(frame.as_buffer())
                at += len(frame.as_buffer())
                ends.append(at)
        if out is None:
            return
        out.write(np.array([i or 0 for i in ids], "<i8").tobytes())
        out.write(np.array([i is None for i in ids], "u1").tobytes())
        out.write(np.array(ends, "<u8").tobytes())
        out.write(np.array(counts, "<u8").tobytes())
        out.write(struct.pack(FOOT, at, len(ids), MAGIC))
        out.close()
        where.move(hidden, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()),
             pa.array([sum(counts)], pa.int64())], names=["name", "first_id", "docs", "tokens"])

    frames = written(encoded(docs, tokenizer, end_id, id_col, text_col, dictionary), "token-frames")
    shards = (frames.repartitionByRange(F.col("doc_id").asc_nulls_first())
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "frame")
              .mapInArrow(shard, "name string, first_id long, docs long, tokens long").collect())
    listed, start = [], 0
    for s in sorted(shards, key=lambda s: (s["first_id"] is not None, s["first_id"] or 0)):
        listed.append(s.asDict() | {"start": start})
        start += s["tokens"]
    _put(f"{folder}/manifest", json.dumps({"version": VERSION, "dictionary": digest.hex(), "end_id": end_id,
                                           "tokens": start, "shards": listed}).encode())
    return folder


class Shard:
    """Random access to the documents of one shard file."""

    def __init__(self, uri: str, dictionary: bytes):
        where, path = _open(uri)
        self.file = where.open_input_file(path)
        magic, version, digest = struct.unpack(HEAD, self.file.read(HEAD_SIZE))
        size = self.file.size()
        index_at, n, tail = struct.unpack(FOOT, self.file.read_at(FOOT_SIZE, size - FOOT_SIZE))
        if magic != MAGIC or tail != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is no token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        index = self.file.read_at(size - FOOT_SIZE - index_at, index_at)
        self.ids = np.frombuffer(index, "<i8", n)
        self.null = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.ends = np.concatenate([[HEAD_SIZE], np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)])
        self.counts = np.frombuffer(index, "<u8", n, 17 * n).astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, k: int) -> bytes:
        """The ids of the shard's k-th document; no other frame is read."""
        frame = self.file.read_at(int(self.ends[k + 1] - self.ends[k]), int(self.ends[k]))
        return self.unpack(frame, max_output_size=4 * int(self.counts[k]))

    def find(self, doc_id: int) -> bytes | None:
        """The ids of a document by its id."""
        nulls = int(self.null.sum())
        k = nulls + int(np.searchsorted(self.ids[nulls:], doc_id))
        return self.document(k) if k < len(self.ids) and self.ids[k] == doc_id else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What the files of a store hold: ``doc_id, start, n_tokens, ids_crc32``."""
    manifest = json.loads(_get(f"{folder}/manifest"))
    shards = manifest["shards"]
    listed = spark.createDataFrame([(s["name"], s["start"]) for s in shards], "name string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("token_store")
        dictionary = _get(f"{folder}/dictionary")
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = Shard(f"{folder}/{name}", dictionary)
                starts = start + np.cumsum(s.counts) - s.counts
                for lo in range(0, len(s), 1_000):
                    hi = min(len(s), lo + 1_000)
                    ids = [s.document(k) for k in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.ids[lo:hi], pa.int64(), mask=s.null[lo:hi]),
                         pa.array(starts[lo:hi], pa.int64()),
                         pa.array([len(i) // 4 for i in ids], pa.int64()),
                         pa.array([zlib.crc32(i) for i in ids], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (listed.repartition(max(1, len(shards)))
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))
