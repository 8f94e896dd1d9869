"""Token ids in binary shards, compressed by a grammar (Re-Pair), with random access.

A shard holds the ids of neighbouring documents. Frequent pairs of symbols are replaced by new symbols, round
after round; a shard stores the pairs (rules), how many ids each symbol stands for, the replaced sequence and
the ids' counts per document. With the expansion lengths any range of ids is decoded without the rest.

Layout, little-endian: ``RPG1``, five unsigned 32-bit numbers (base, rules, symbols, documents, width of a
symbol in bytes), then the rules (two unsigned 32-bit symbols each), expansion lengths of the rules (32-bit),
ids per document (64-bit), document keys (signed 64-bit, and a byte each that is 1 for null) and the symbols.
A symbol below base is an id; symbol base + r stands for rule r.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm import storage
from tieout.llm.common import slices, whole_text, write_scratch
from tieout.llm.tokens import piece_ids, tokenizer_path

MAGIC = b"RPG1"
_HEAD = struct.Struct("<4s5I")
#: A shard is closed when it holds this many ids.
SHARD_IDS = 1 << 22
#: A pair is replaced while it occurs at least this often in the shard, and while there is room for rules.
LEAST_PAIRS = 16
#: Pieces a worker holds, up to twice as many.
HELD_PIECES = 400_000
#: Pairs replaced in one round: each is at least this share as frequent as the round's most frequent one.
ROUND_SHARE = 256
_SLOTS = 18

SHARDS = "shard string, part int, seq int, documents long, tokens long"
DOCUMENT = "shard string, position int, doc_id long, start long, n_tokens long, ids binary"


def _frequent_pairs(codes: np.ndarray, most: int, least: int) -> np.ndarray:
    """The pairs to replace now, most frequent first."""
    ordered = np.sort(codes)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    counts = np.diff(np.append(starts, len(ordered)))
    often = np.flatnonzero(counts >= max(least, counts.max() // ROUND_SHARE))
    often = often[np.argsort(-counts[often], kind="stable")][:most]
    return ordered[starts[often]]


def compress(ids: np.ndarray, base: int, least: int = LEAST_PAIRS,
             most_rules: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Rules (n, 2) and the symbols left. Overlapping pairs are replaced from the left. With ``base`` below 60,000
    symbols have 16 bits, which leaves 65,535 - ``base`` rules."""
    symbols, rules = ids.astype(np.uint32), []
    # A pair is one number: of 32 bits where all symbols have 16.
    kind, half, factor = (np.uint32, 16, 0x9E3779B1) if base < 60_000 else (np.uint64, 32, 0x9E3779B97F4A7C15)
    if kind is np.uint32:
        most_rules = min(most_rules, (1 << 16) - 1 - base)
    shift, nothing = kind(2 * half - _SLOTS), np.iinfo(kind).max
    while len(symbols) >= 2:
        codes = (symbols[:-1].astype(kind) << kind(half)) | symbols[1:]
        pairs = _frequent_pairs(codes, min(4096, most_rules - len(rules)), least)
        _, first = np.unique((pairs * kind(factor)) >> shift, return_index=True)  # one pair to a slot
        pairs = pairs[np.sort(first)]
        if not len(pairs):
            break
        known, new = np.full(1 << _SLOTS, nothing, kind), np.zeros(1 << _SLOTS, np.uint32)
        slots = (pairs * kind(factor)) >> shift
        known[slots], new[slots] = pairs, np.arange(len(pairs), dtype=np.uint32) + np.uint32(base + len(rules))
        rules += zip((pairs >> kind(half)).tolist(), (pairs & kind((1 << half) - 1)).tolist(), strict=True)
        slots = (codes * kind(factor)) >> shift
        places = np.flatnonzero(known[slots] == codes)
        # In a run of overlapping hits every second one, from its first, is replaced.
        begins = np.flatnonzero(np.concatenate(([True], np.diff(places) > 1)))
        within = np.arange(len(places)) - np.repeat(begins, np.diff(np.append(begins, len(places))))
        places = places[within % 2 == 0]
        kept = np.ones(len(symbols), bool)
        kept[places + 1] = False
        symbols[places] = new[slots[places]]
        symbols = symbols[kept]
    return np.array(rules, np.uint32).reshape(-1, 2), symbols


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids each rule stands for; a rule only uses symbols made before it."""
    lengths = np.ones(base + len(rules), np.uint32)
    for r, (left, right) in enumerate(rules.tolist()):
        lengths[base + r] = lengths[left] + lengths[right]
    return lengths[base:]


def pack(keys: list[int | None], documents: list[np.ndarray], base: int) -> bytes:
    """A shard of documents' ids, all below ``base``."""
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    rules, symbols = compress(ids, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return b"".join([
        _HEAD.pack(MAGIC, base, len(rules), len(symbols), len(documents), width), rules.astype("<u4").tobytes(),
        expansion_lengths(rules, base).astype("<u4").tobytes(), np.array([len(d) for d in documents], "<u8").tobytes(),
        np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is None for k in keys),
        symbols.astype(f"<u{width}").tobytes()])


class Shard:
    """A packed shard: ``keys``, ``counts`` (ids per document) and ids by range."""

    def __init__(self, data: bytes):
        magic, self.base, n_rules, n_symbols, n_docs, width = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        lengths = take("<u4", n_rules)
        self.counts = take("<u8", n_docs).astype(np.int64)
        keys, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.keys = [None if null else key for key, null in zip(keys.tolist(), nulls.tolist(), strict=True)]
        self.symbols = take(f"<u{width}", n_symbols).astype(np.int64)
        self.flat, self.places = self._expansions(lengths)
        self.lengths = np.concatenate((np.ones(self.base, np.int64), lengths.astype(np.int64)))
        self.ends = np.cumsum(self.lengths[self.symbols])

    def _expansions(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids that symbols stand for, one after another, and where each symbol's begin."""
        places = self.base + np.cumsum(np.append(0, lengths[:-1])).astype(np.int64) if len(lengths) else np.empty(0, np.int64)
        flat = np.empty(self.base + int(lengths.sum()), np.uint32)
        flat[: self.base] = np.arange(self.base)
        where = [*range(self.base), *places.tolist()]
        sizes = [1] * self.base + lengths.tolist()
        for r, (left, right) in enumerate(self.rules.tolist()):
            at, n = where[self.base + r], sizes[left]
            flat[at: at + n] = flat[where[left]: where[left] + n]
            flat[at + n: at + n + sizes[right]] = flat[where[right]: where[right] + sizes[right]]
        return flat, np.concatenate((np.arange(self.base), places))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; only the symbols that cover them are expanded."""
        first, last = np.searchsorted(self.ends, (start, stop - 1), side="right") if stop > start else (0, -1)
        used = self.symbols[first: last + 1]
        sizes = self.lengths[used]
        before = np.cumsum(sizes) - sizes
        begin = int(self.ends[first] - sizes[0]) if len(used) else start
        found = self.flat[np.repeat(self.places[used] - before, sizes) + np.arange(int(sizes.sum()))]
        return found[start - begin: stop - begin]


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_pieces(text: str) -> list[bytes]:
    """A text in pieces that a lower-casing word tokenizer encodes one by one as it does the whole.

    Such a tokenizer drops white space, so stretches between blanks stand alone; capital A-Z count as small
    ones, but for a text that may hold the name of a special token.
    """
    data = text.encode()
    if b"<|" not in data:
        data = data.translate(_LOWER)
    return data.replace(b"\n", b" ").split(b" ")


def write_ids(documents: DataFrame, tokenizer: str, folder: str, end_id: int, base: int,
              shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode whole texts and write them as shards in ascending ``doc_id`` order; gives the table of shards.

    ``end_id`` follows each document; ``base`` is above every id. Null texts are empty; null ids come first;
    rows with equal ids stand next to each other by a hash of the text; an empty table gives no shard. A shard holds at
    most ``shard_ids`` ids, or one longer document. ``part`` and ``seq`` order the shards.
    """
    path = tokenizer_path(tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, part, seq = piece_ids(path, HELD_PIECES).__getitem__, TaskContext.get().partitionId(), 0
        keys, coded, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal keys, coded, size, seq
            name = storage.new_name(folder, ".rpg")
            with storage.create(name) as out:
                out.write(pack(keys, [np.frombuffer(x, "<u4") for x in coded], base))
            row = {"shard": name, "part": part, "seq": seq, "documents": len(keys), "tokens": size}
            keys, coded, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("shard", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("documents", pa.int64()),
                ("tokens", pa.int64())]))

        for batch in slices(batches):
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = b"".join(map(look, word_pieces(text))) + end
                if keys and size + len(ids) // 4 > shard_ids:
                    yield close()
                keys.append(key)
                coded.append(ids)
                size += len(ids) // 4
        if keys:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"), "text")
    return write_scratch(ordered.mapInArrow(write, SHARDS), "id-shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all shards before: a sum within each part, after those of earlier parts."""
    parts = sorted((r["part"], r["n"]) for r in
                   shards.groupBy("part").agg(F.sum("tokens").alias("n")).collect())  # one row for each writing task
    before, rows = 0, []
    for part, n in parts:
        rows.append((part, before))
        before += n
    offsets = shards.sparkSession.createDataFrame(rows, "part int, before long")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(
        F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def read_ids(shards: DataFrame) -> DataFrame:
    """One row per document of the shards, in whatever order: ``shard, position, doc_id, start, n_tokens, ids``;
    ``start`` counts the ids of all documents before."""
    schema = pa.schema([("shard", pa.string()), ("position", pa.int32()), ("doc_id", pa.int64()),
                        ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with storage.open_random(name) as source:
                    shard = Shard(source.read())
                ends = np.cumsum(shard.counts)
                for at in range(0, len(ends), 512):
                    to = min(at + 512, len(ends))
                    begins = ends[at:to] - shard.counts[at:to]
                    data = shard.ids(int(begins[0]), int(ends[to - 1])).astype("<u4", copy=False).tobytes()
                    cuts = pa.array(np.append(0, 4 * (ends[at:to] - begins[0])).astype(np.int32))
                    ids = pa.Array.from_buffers(pa.binary(), to - at, [None, cuts.buffers()[1], pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * (to - at)), pa.array(np.arange(at, to, dtype=np.int32)),
                        pa.array(shard.keys[at:to], pa.int64()), pa.array(begins + start),
                        pa.array(shard.counts[at:to]), ids], schema=schema)

    return storage.one_task_per_file(shard_starts(shards).select("shard", "start")).mapInArrow(read, DOCUMENT)
