"""Quality classifier: a byte-level convolutional network in numpy.

Input: one vector of CHANNELS numbers per byte of the UTF-8 text: a learned embedding of the byte,
a flag for "the last GRAM bytes also stand 2 to MAX_LAG bytes before", and a flag for padding.
FILTERS learned filters slide over WIDTH bytes at a time.  The text is cut into chunks of four
cells of 64 bytes that overlap by one cell and cover it from end to end; each filter is max-pooled
over a chunk.  The probability is a logistic function of two vectors: the mean of the pooled values
over all chunks, and their maximum.

Windows start at every byte.  Cells are a multiple of WIDTH bytes, so the windows that start at
``r, r + WIDTH, ...`` are the rows of a reshaped view, and pooling needs no copy of the input.

Training (Adam, seeded) takes a bounded sample, drawn by hash: SAMPLE_DOCS labelled documents at
most, SAMPLE_CHUNKS evenly spaced chunks of each.  Scoring reads every byte of every document;
long ones are worked on in blocks with a cell of context on both sides, so blocks never show.

Defined results: a null or empty text has no chunk, all its pooled values are 0; if there is
nothing to learn from, every score is 0.5; repeated rows give one result row each; an empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pertinax.llm.common import col, map_batches, worker_state
from pertinax.llm.hd_langid import held_out

EMBEDDING, CHANNELS, WIDTH, FILTERS = 6, 8, 8, 24
REPEATED, PADDED = 6, 7
PAD = 256
CELL, CHUNK_CELLS = 64, 4
CHUNK = CELL * CHUNK_CELLS
GRAM, MAX_LAG = 5, 24
#: Padding behind every document: no flag and no window reaches across it.
GAP = 32
BLOCK = 1 << 19
SAMPLE_DOCS, SAMPLE_CHUNKS = 3_000, 8
EPOCHS, BATCH_DOCS, RATE, DECAY, SEED = 12, 64, 0.01, 1e-4, 7
THRESHOLD = 0.3


def repeated(data: np.ndarray) -> np.ndarray:
    """Whether the GRAM bytes that end here also end 2 to MAX_LAG bytes before."""
    wide = data.astype(np.int64)
    gram = wide.copy()
    for k in range(1, GRAM):
        gram[k:] |= wide[:-k] << 9 * k
    out = np.zeros(len(data), bool)
    for lag in range(2, MAX_LAG + 1):
        out[lag:] |= gram[lag:] == gram[:-lag]
    out[:GRAM] = False  # no whole gram yet
    return out & (data != PAD)


def inputs(data: np.ndarray, table: np.ndarray, flags: np.ndarray) -> np.ndarray:
    x = table[data]
    x[:, REPEATED] = flags
    return x


def pooled_cells(data: np.ndarray, model: dict) -> np.ndarray:
    """Every filter's maximum over the windows that start in each cell.  ``data``: byte numbers,
    a multiple of CELL."""
    x = inputs(data, model["table"], repeated(data))
    x = np.concatenate([x, np.tile(model["table"][PAD], (WIDTH, 1))])
    cells, per = len(data) // CELL, CELL // WIDTH
    best = np.full((cells, FILTERS), -np.inf, np.float32)
    flat = x.reshape(-1)
    for r in range(WIDTH):
        rows = flat[r * CHANNELS:r * CHANNELS + cells * per * WIDTH * CHANNELS].reshape(-1, WIDTH * CHANNELS)
        np.maximum(best, (rows @ model["filters"]).reshape(cells, per, FILTERS).max(axis=1), out=best)
    return np.maximum(best + model["bias"], 0)


def _padded(text: bytes) -> np.ndarray:
    """The byte numbers of a text, padded by at least GAP to whole cells."""
    size = -(-(len(text) + GAP) // CELL) * CELL
    out = np.full(size, PAD, np.int16)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out


def _long_cells(data: np.ndarray, model: dict) -> np.ndarray:
    parts = []
    for at in range(0, len(data), BLOCK):
        lo, hi = max(0, at - CELL), min(len(data), at + BLOCK + CELL)
        cells = pooled_cells(data[lo:hi], model)
        parts.append(cells[(at - lo) // CELL:][:min(BLOCK, len(data) - at) // CELL])
    return np.concatenate(parts)


def features(texts: list[bytes], model: dict) -> np.ndarray:
    """Mean and maximum of the pooled chunks of each text."""
    out = np.zeros((len(texts), 2 * FILTERS), np.float32)
    start = 0
    while start < len(texts):
        end, size, some = start, 0, []
        while end < len(texts) and (not some or size + len(texts[end]) <= BLOCK):
            some.append(_padded(texts[end]))
            size += len(some[-1])
            end += 1
        data = np.concatenate(some)
        cells = _long_cells(data, model) if len(some) == 1 else pooled_cells(data, model)
        at = 0
        for k, own in zip(range(start, end), some):
            n = -(-len(texts[k]) // CELL)  # cells with text
            if n:
                mine = cells[at:at + n]
                out[k, FILTERS:] = mine.max(axis=0)
                starts = np.arange(0, max(1, n - 1), CHUNK_CELLS - 1)
                chunks = mine[starts]
                for c in range(1, CHUNK_CELLS):
                    np.maximum(chunks, mine[np.minimum(starts + c, n - 1)], out=chunks)
                out[k, :FILTERS] = chunks.mean(axis=0)
            at += len(own) // CELL
        start = end
    return out


def score(texts: list[bytes], model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    logit = features(texts, model).astype(np.float64) @ model["out"] + model["out_bias"]
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


# -- training -----------------------------------------------------------------------------------


def sample_chunks(text: bytes) -> list[tuple[bytes, bytes]]:
    """At most SAMPLE_CHUNKS chunks, evenly spaced, with the flags of their bytes: each as byte
    numbers and flags of CHUNK + WIDTH - 1 places."""
    data = _padded(text)
    if not text:
        return []
    n = -(-len(text) // CELL)
    starts = np.arange(0, max(1, n - 1), CHUNK_CELLS - 1)
    picked = starts[np.unique(np.linspace(0, len(starts) - 1, SAMPLE_CHUNKS).astype(int))]
    out = []
    for s in picked.tolist():
        lo, hi = s * CELL, s * CELL + CHUNK + WIDTH - 1
        context = max(0, lo - CELL)
        flags = repeated(data[context:hi])[lo - context:]
        piece = np.full(CHUNK + WIDTH - 1, PAD, np.int16)
        flag = np.zeros(CHUNK + WIDTH - 1, np.uint8)
        piece[:len(data[lo:hi])], flag[:len(flags)] = data[lo:hi], flags
        out.append((piece.tobytes(), flag.tobytes()))
    return out


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "quality") -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Byte numbers and flags of the chunks of each sampled document, and the labels."""
    known = (labels.where(col(label_col).isNotNull() & ~held_out(col(id_col)))
             .groupBy(col(id_col).alias("label_id")).agg(F.max(col(label_col)).cast("int").alias("label"))
             .orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE_DOCS))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    # one row an id: of several, the one whose text has the smallest hash
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("label", "text"), F.struct(F.xxhash64("text"), "text")).alias("r")).select(
        "doc_id", "r.label", "r.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [sample_chunks(t.as_py() or b"") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(d) for d in batch.column(0).to_pylist()], pa.string()), batch.column(1),
                 pa.array([b"".join(p for p, _ in c) for c in chunks], pa.binary()),
                 pa.array([b"".join(f for _, f in c) for c in chunks], pa.binary())],
                names=["id", "label", "data", "flags"])

    drawn = map_batches(rows, run, "id string, label int, data binary, flags binary").collect()
    drawn = sorted((r for r in drawn if r["data"]), key=lambda r: (r["id"], bytes(r["data"])))
    size = CHUNK + WIDTH - 1
    return ([np.frombuffer(r["data"], np.int16).reshape(-1, size) for r in drawn],
            [np.frombuffer(r["flags"], np.uint8).reshape(-1, size) for r in drawn],
            np.array([r["label"] for r in drawn], np.float64))


def fit(data: list[np.ndarray], flags: list[np.ndarray], labels: np.ndarray) -> dict | None:
    """The network that best tells the labels, by Adam on the log loss."""
    if not len(labels):
        return None
    rng = np.random.default_rng(SEED)
    table = np.zeros((PAD + 1, CHANNELS), np.float32)
    table[:PAD, :EMBEDDING] = rng.normal(0, 0.5, (PAD, EMBEDDING))
    table[PAD, PADDED] = 1
    filters = rng.normal(0, 0.15, (WIDTH, CHANNELS, FILTERS)).astype(np.float32)
    filters[:, PADDED] = 0
    rate = np.clip(labels.mean(), 0.01, 0.99)
    params = {"table": table, "filters": filters, "bias": np.zeros(FILTERS, np.float32),
              "out": rng.normal(0, 0.1, 2 * FILTERS), "out_bias": np.array(np.log(rate / (1 - rate)))}
    learned = {"table": (slice(0, PAD), slice(0, EMBEDDING)), "filters": (slice(None), slice(0, PADDED)),
               "bias": ..., "out": ..., "out_bias": ...}
    moments = {k: [np.zeros(v.shape), np.zeros(v.shape)] for k, v in params.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH_DOCS):
            some = order[lo:lo + BATCH_DOCS]
            grads = _gradients(params, [data[i] for i in some], [flags[i] for i in some], labels[some])
            step += 1
            pace = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, g in grads.items():
                m, v = moments[k]
                g = g + DECAY * params[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k][learned[k]] -= (pace * m / (np.sqrt(v) + 1e-8))[learned[k]].astype(params[k].dtype)
    filters = params["filters"].copy()
    filters[0, PADDED] = -1e4  # a window that starts in the padding never counts
    return params | {"filters": filters.reshape(WIDTH * CHANNELS, FILTERS), "out_bias": float(params["out_bias"])}


def _gradients(p: dict, data: list[np.ndarray], flags: list[np.ndarray], labels: np.ndarray) -> dict:
    sizes = np.array([len(d) for d in data])
    owner = np.repeat(np.arange(len(data)), sizes)
    starts = np.cumsum(sizes) - sizes
    bytes_, flag = np.concatenate(data), np.concatenate(flags)
    x = p["table"][bytes_]
    x[:, :, REPEATED] = flag
    windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, :CHUNK]  # chunk, place, channel, offset
    windows = windows.transpose(0, 1, 3, 2).reshape(len(x), CHUNK, WIDTH * CHANNELS)
    value = windows @ p["filters"].reshape(-1, FILTERS)
    value[bytes_[:, :CHUNK] == PAD] = -1e4
    best = value.argmax(axis=1)
    top = np.take_along_axis(value, best[:, None], axis=1)[:, 0] + p["bias"]
    pooled = np.maximum(top, 0)
    mean = np.add.reduceat(pooled, starts) / sizes[:, None]
    peak = np.maximum.reduceat(pooled, starts)
    joint = np.concatenate([mean, peak], axis=1)
    chance = 1 / (1 + np.exp(-np.clip(joint @ p["out"] + p["out_bias"], -500, 500)))
    error = (chance - labels) / len(labels)
    back = error[:, None] * p["out"]
    first = pooled == peak[owner]
    g = back[owner, :FILTERS] / sizes[owner, None] + first * back[owner, FILTERS:]
    g = np.where(top > 0, g, 0).astype(np.float32)  # chunk, filter
    at = np.take_along_axis(windows, best[:, :, None], axis=1)  # chunk, filter, cell of the window
    d_filters = np.einsum("cf,cfw->wf", g, at).reshape(p["filters"].shape)
    d_window = g[:, :, None, None] * p["filters"].transpose(2, 0, 1)[None]  # chunk, filter, offset, channel
    places = best[:, :, None] + np.arange(WIDTH)
    hit = bytes_[np.arange(len(x))[:, None, None], places].ravel()
    d_table = np.stack([np.bincount(hit, d_window[..., c].ravel(), PAD + 1) for c in range(CHANNELS)], axis=1)
    return {"table": d_table, "filters": d_filters, "bias": g.sum(axis=0), "out": error @ joint,
            "out_bias": error.sum()}


def train(docs: DataFrame, labels: DataFrame, **columns: str) -> dict | None:
    return fit(*training_sample(docs, labels, **columns))


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
            threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``."""
    rows = docs.select(col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"),
                       col(text_col).cast("string").cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("byte_cnn")
        for batch in batches:
            scores = score([t.as_py() or b"" for t in batch.column(2)], model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32))], names=schema.names)

    return map_batches(rows, run, schema)
