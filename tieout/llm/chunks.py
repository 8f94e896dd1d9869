"""Byte-level BPE of whole texts from content-defined chunks, and back.

A rolling hash of the last 16 bytes cuts a text into chunks, so that passages shared by documents give
the same chunks wherever they stand. A worker encodes a chunk once and reuses its ids. Ids next to a cut
may differ from those of the uncut text: the tokenizer splits texts where white space begins and merges
within such stretches only. So a chunk keeps the ids between its first and last such place, and what lies
around a join, from the last place on the left to the first on the right, is encoded anew. A join without a
place on one side reaches on into the next chunk, up to the whole text, which makes the ids those of the
tokenizer for every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.common import slices
from tieout.llm.tokens import PieceIds, byte_characters, piece_ids, tokenizer_path

#: A cut follows each byte where these bits of the rolling hash are zero: every 128 bytes or so.
CUT_BITS = np.uint32(0x7F << 20)
#: Characters of chunks that a worker holds.
HELD_CHARS = 8 << 20
_GEAR = np.arange(1, 257, dtype=np.uint32) * np.uint32(2654435761)
_GEAR ^= _GEAR >> np.uint32(15)
#: White space begins after a character that is none.
_BEGINS = re.compile(r"(?<=\S)(?=[ \n])")
_PLAIN_PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")


def cut(text: str) -> list[str]:
    """The chunks of a text; together they are the text."""
    data = text.encode()
    if len(data) < 64:
        return [text]
    raw = np.frombuffer(data, np.uint8)
    rolled = _GEAR[raw]
    for step in (1, 2, 4, 8):
        longer = rolled.copy()
        longer[step:] += rolled[:-step] << np.uint32(step)
        rolled = longer
    ends = np.flatnonzero((rolled[15:-1] & CUT_BITS == 0) & (raw[16:] & 0xC0 != 0x80)) + 16
    places = [0, *ends.tolist(), len(data)]
    return [data[a:b].decode() for a, b in zip(places, places[1:], strict=False)]


def pieces(chunk: str) -> list[str]:
    """A chunk split wherever white space begins."""
    return _BEGINS.split(chunk) if _OTHER_SPACE.search(chunk) else _PLAIN_PIECES.findall(chunk)


class ChunkEncoder:
    """Encodes texts; ``encoded`` and ``reused`` count chunks."""

    def __init__(self, known: PieceIds, held_chars: int = HELD_CHARS):
        self.known, self.held_chars = known, held_chars
        self.chunks: dict[str, tuple[str, bytes, str] | None] = {}
        self.chars = self.encoded = self.reused = 0

    def _parts(self, chunk: str) -> tuple[str, bytes, str] | None:
        """Text before the first place, ids from there to the last place, text after it."""
        if chunk in self.chunks:
            self.reused += 1
            return self.chunks[chunk]
        self.encoded += 1
        found = pieces(chunk)
        parts = None
        if len(found) > 1:
            parts = found[0], b"".join(map(self.known.__getitem__, found[1:-1])), found[-1]
        if self.chars > self.held_chars:
            self.chunks.clear()
            self.chars = 0
        if len(chunk) <= 4096:
            self.chunks[chunk] = parts
            self.chars += len(chunk)
        return parts

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        out, pending = [], []
        for chunk in cut(text):
            parts = self._parts(chunk)
            if parts is None:
                pending.append(chunk)
                continue
            head, middle, tail = parts
            pending.append(head)
            out += map(self.known.__getitem__, pieces("".join(pending)))
            out.append(middle)
            pending = [tail]
        out += map(self.known.__getitem__, pieces("".join(pending)))
        return b"".join(out)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encode(documents: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the column ``ids`` (array of int): the tokenizer's ids of the whole text without special ones.

    The row's other columns stay as they are, whatever their names; a column called ``ids`` is replaced.
    Null and empty texts give no ids. Rows do not depend on one another, so repeated rows and ties need no
    rule. Memory is bounded by the worker's held chunks and pieces and the longest text.
    """
    path = tokenizer_path(tokenizer)
    kept = [field for field in documents.schema.fields if field.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = ChunkEncoder(piece_ids(path))
        encoder = _ENCODERS[path]
        for batch in slices(batches):
            coded = [encoder.encode(x or "") for x in batch.column(text).to_pylist()]
            starts = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in coded], out=starts[1:])
            ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(field.name) for field in kept), ids], [*(field.name for field in kept), out])

    return documents.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def id_bytes(path: str) -> list[bytes]:
    """The bytes each id stands for."""
    alphabet = {c: b for b, c in enumerate(byte_characters())}
    tokenizer = PieceIds(path).tokenizer
    special = {i for i, token in tokenizer.get_added_tokens_decoder().items()}
    table = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        table[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
    return table


_TABLES: dict[str, list[bytes]] = {}


def decode(coded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the column ``decoded``: the text of the ids, special ones included.

    Null or empty ids give an empty text; bytes that are no UTF-8 give replacement characters.
    """
    path = tokenizer_path(tokenizer)
    kept = [field for field in coded.schema.fields if field.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TABLES:
            _TABLES[path] = id_bytes(path)
        look = _TABLES[path].__getitem__
        for batch in slices(batches):
            flat = batch.column(ids).flatten().to_numpy()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy())
            texts = [b"".join(map(look, part.tolist())).decode("utf-8", "replace")
                     for part in np.split(flat, ends[:-1])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(field.name) for field in kept), pa.array(texts, pa.string())],
                [*(field.name for field in kept), out])

    return coded.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.StringType())]))


def joined_ids(ids: str) -> F.Column:
    """Decimal ids joined by commas."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")
