"""BPE encoding and decoding by tree concatenation.

The tokenizer cuts a text into pieces (runs of letters, digits, other marks), drops white space
and encodes each piece for itself.  Texts of Latin letters are cut here by the same rule; others
are cut at white space only, and the library normalises and cuts their parts.  Ids of short
pieces and parts are kept in a bounded dictionary, so the library encodes a frequent one once.

Text that nothing splits and that is longer than ``LEAF`` characters goes through the tree:

* the piece is halved until the leaves are short, and all leaves are encoded in
  one batch call.  The library's own threads are off (``codec``), as the cores belong to other
  tasks, so the leaves and joins of one text run one after another in one task;
* neighbours are joined pair by pair.  A window of tokens around the join is encoded again and
  grows until one of its tokens equals a token of the left side and a later one equals a token of
  the right side, in id and place.  Tokens before the one and behind the other are kept from the
  sides.  Every two neighbours of the result then stand side by side in some real encoding, which
  is what makes a sequence of BPE tokens the encoding of its text, so the join is exact; a window
  that reaches both ends is the encoding itself.

Decoding takes the ids alone: a tokenizer without a decoder joins its tokens by a space.

A tokenizer that does not split like the word-BPE file gets whole texts and the library's decoder.

Defined results: a null text counts as empty and gives no ids; the strings of special tokens in a
text are encoded as the library does; repeated rows give one result row each; an empty table gives
an empty result; columns other than id and text are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pertinax.llm.common import col, map_batches, worker_state

#: Longest part, in characters, that is encoded in one go.
LEAF = 512
#: Texts are worked on so many characters at a time, and so many parts kept encoded.
SLICE_CHARS = 1_000_000
CACHE_PARTS = 250_000
BATCH_PARTS = 10_000
#: Fixed value: the split of a tokenizer that drops white space and never joins across it.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of these characters are cut by PLAIN_SPLIT, once lower-cased: they have nothing to
#: normalise, and their letters, digits and white space are the same in every Unicode version.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-įĲ-ňŊ-ž]*")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-zß-öø-ž0-9\t\n\r ]+")
WHITE = re.compile(r"[\t\n\r ]+")


class Known(dict):
    """The ids of units by unit; a unit that is not long stays once it has been encoded.  A full
    dictionary becomes the older one, from which units that are still in use come back."""

    def __init__(self, encode: Callable[[str], bytes], leaf: int):
        self.encode, self.leaf, self.older = encode, leaf, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.encode(unit)
        if len(unit) <= self.leaf:
            self[unit] = ids
        return ids

    def age(self) -> None:
        if len(self) > CACHE_PARTS:
            self.older = dict(self)
            self.clear()


#: Byte -> its letter in a byte-level vocabulary: printable bytes stand for themselves, the others
#: follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SPELLING = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - _PRINTABLE))}


class Codec:
    """A tokenizer file with its encoder and decoder."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.piece = Tokenizer(self.tokenizer.model)  # one piece in, its tokens out
        self.leaf = leaf
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_parts = (splits[0].get("pattern") == {"Regex": WORD_SPLIT} and splits[0].get("invert")
                         and splits[0].get("behavior") == "Removed" and not spec.get("post_processor"))
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        size = max(self.tokenizer.get_vocab(True).values()) + 1
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.joined = spec.get("decoder") is None
        self.pieces, self.parts = Known(self.encode_piece, leaf), Known(self.encode_part, leaf)

    # -- encoding ---------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_parts:
            return [array("I", e.ids).tobytes()
                    for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out = []
        self.pieces.age()
        self.parts.age()
        for text in texts:
            if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                out.append(b"".join(map(self.pieces.__getitem__, PLAIN_SPLIT.findall(text.lower()))))
            else:
                out.append(b"".join(map(self.parts.__getitem__, WHITE.split(text))))
        return out

    def encode_piece(self, piece: str) -> bytes:
        """The ids of a piece as the splitter gives it."""
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SPELLING)
        if len(spelled) > self.leaf:
            return array("I", self.tree(spelled)[0].tolist()).tobytes()
        return array("I", self.piece.encode(spelled).ids).tobytes()

    def encode_part(self, part: str) -> bytes:
        """The ids of a part of a text that was cut at white space."""
        if len(part) > self.leaf:
            return self.encode_unsplit(part)
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode_unsplit(self, part: str) -> bytes:
        """The ids of a long part without white space."""
        if any(s in part for s in self.special):  # the library cuts these out before all else
            return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        text = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        out = array("I")
        for at in range(0, len(pieces), BATCH_PARTS):
            some = [p for p, _ in pieces[at:at + BATCH_PARTS]]
            short = iter(self.piece.encode_batch([p for p in some if len(p) <= self.leaf]))
            for p in some:
                out.extend(next(short).ids if len(p) <= self.leaf else self.tree(p)[0].tolist())
        return out.tobytes()

    def _tokens(self, texts: list[str], starts: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text, and the places where its tokens end, counted from its start."""
        return [(np.array(e.ids, np.int64), np.array([b for _, b in e.offsets], np.int64) + at)
                for e, at in zip(self.piece.encode_batch(texts), starts)]

    def tree(self, piece: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and token ends of one piece: leaves in one batch, then joins level by level."""
        cuts = [0, len(piece)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:]))})
        nodes = self._tokens([piece[a:b] for a, b in zip(cuts, cuts[1:])], cuts)
        starts = cuts[:-1]
        while len(nodes) > 1:
            merged = [self.join(piece, starts[i], *nodes[i], *nodes[i + 1])
                      for i in range(0, len(nodes) - 1, 2)]
            nodes = merged + nodes[2 * len(merged):]
            starts = starts[::2]
        return nodes[0]

    def join(self, piece: str, start: int, left: np.ndarray, left_end: np.ndarray,
             right: np.ndarray, right_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The encoding of two neighbours' text, from their encodings."""
        middle = left_end[-1]
        left_at = np.concatenate([[start], left_end[:-1]])
        right_at = np.concatenate([[middle], right_end[:-1]])
        reach = 4
        while True:
            lo, hi = max(0, len(left) - reach), min(len(right), reach)
            a, b = left_at[lo], right_end[hi - 1]
            ((ids, end),) = self._tokens([piece[a:b]], [a])
            if lo == 0 and hi == len(right):
                return ids, end
            at = np.concatenate([[a], end[:-1]])
            window = {(s, e, t): k for k, (s, e, t) in enumerate(zip(at.tolist(), end.tolist(), ids.tolist()))}
            first = next(((k, window[key]) for k in range(lo, len(left))
                          if (key := (int(left_at[k]), int(left_end[k]), int(left[k]))) in window), None)
            last = next(((k, window[key]) for k in range(hi - 1, -1, -1)
                         if (key := (int(right_at[k]), int(right_end[k]), int(right[k]))) in window), None)
            # an end of the window that is an end of the text needs no agreement
            i, wi = first or (-1, -1)
            j, wj = last or (len(right), len(ids))
            if (first or lo == 0) and (last or hi == len(right)):
                keep_left, keep_right = (i + 1 if first else 0), j
                return (np.concatenate([left[:keep_left], ids[wi + 1:wj], right[keep_right:]]),
                        np.concatenate([left_end[:keep_left], end[wi + 1:wj], right_end[keep_right:]]))
            reach *= 2

    # -- decoding ---------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8."""
        if self.joined:
            return b" ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()


def codec(path: str) -> Codec:
    """The codec of a file, loaded once per Python worker."""
    codecs = worker_state("bpe")
    if path not in codecs:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to other tasks
        codecs[path] = Codec(path)
    return codecs[path]


def slices(batch: pa.RecordBatch, text_at: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in parts of about SLICE_CHARS characters, with their texts (null as empty)."""
    from_row, chars, texts = 0, 0, []
    for row, value in enumerate(batch.column(text_at)):
        texts.append(value.as_py() or "")
        chars += len(texts[-1])
        if chars >= SLICE_CHARS:
            yield batch.slice(from_row, len(texts)), texts
            from_row, chars, texts = row + 1, 0, []
    if texts:
        yield batch.slice(from_row, len(texts)), texts


def roundtrip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
              with_ids: bool = False) -> DataFrame:
    """Encode every text and decode the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``
    and, if asked for, ``ids`` (array of int)."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType),
              T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part, texts in slices(batch):
                encoded = c.encode(texts)
                ids = [np.frombuffer(e, "<u4") for e in encoded]
                columns = [part.column(0), pa.array([len(i) for i in ids], pa.int64()),
                           pa.array([hashlib.sha256(e).hexdigest() for e in encoded], pa.string()),
                           pa.array([hashlib.sha256(c.decode(i)).hexdigest() for i in ids], pa.string())]
                if with_ids:
                    ends = np.cumsum([0, *(len(i) for i in ids)])
                    values = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return map_batches(rows, run, T.StructType(fields))
