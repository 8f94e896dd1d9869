"""Log probability of whole texts: all segmentations of every word into the pieces of a public vocabulary.

A text is its words, lower-cased, and one end. A word with the vocabulary's word mark before it can be put
together from pieces in many ways, and its probability is the sum over all of them, by a forward recursion in
log space. The vocabulary's scores decide which pieces there are and what each weighs before anything is learned: they
order the pieces, and the n-th weighs one over n + 10. By these weights the segmentations of the training words share
out the words' counts in the first round, and in every round the expected counts with the weights as a prior are the
pieces' probabilities, bytes for characters without a piece among them. One more segmentation of a training
word is the word as a whole, as frequent as in training. After each word a text ends or goes on.

Words are counted and weighed once for the corpus. The most frequent are broadcast, bounded in number and
length; the rest reach the documents that have them by a shuffle.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import BLANKS, ascii_lower, drop_scratch, slices, whole_text, words_between, write_scratch
from tieout.llm.tokens import tokenizer_path

MARK = "▁"
#: Weight of the vocabulary's own scores, in pieces, beside the expected counts.
PRIOR = 1_000.0
#: Rounds of sharing out the training words among the pieces.
ROUNDS = 2
#: Words broadcast to the tasks, and their greatest length.
HEAD_WORDS, HEAD_CHARS = 1 << 18, 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass
class Pieces:
    """A vocabulary: ``begun`` has the ids of pieces and -1 for mere beginnings of pieces; ``byte_ids``, log
    weight per id, length of the longest piece."""

    begun: dict[str, int]
    byte_ids: list[int]
    logs: np.ndarray
    longest: int


def load(path: str) -> Pieces:
    """Pieces with weights from their scores, bytes last: the n-th best has one over n + 10."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ids = {model.id_to_piece(i): i for i in usable if not model.is_byte(i)}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    weights = np.zeros(size)
    for place, i in enumerate(sorted(usable, key=lambda i: (model.is_byte(i), -model.get_score(i), i))):
        weights[i] = 1 / (place + 10)
    with np.errstate(divide="ignore"):
        logs = np.log(weights / weights.sum())
    begun = dict.fromkeys((piece[:n] for piece in ids for n in range(1, len(piece))), -1) | ids
    return Pieces(begun, byte_ids, logs, max(map(len, ids)))


def arcs(words: list[str], pieces: Pieces) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of every word, marked: how many arcs it has, and of each arc its start, its end and its piece. An arc is a piece
    that stands somewhere in the word; a character without a piece is one that stands for its bytes, as -1 less its
    code point."""
    find, longest = pieces.begun.get, pieces.longest
    counts, starts, ends, used = [], [], [], []
    for line in words:
        line, before = MARK + line, len(used)
        for start in range(len(line)):
            for end in range(start + 1, min(len(line), start + longest) + 1):
                piece = find(line[start:end])
                if piece is None or piece < 0:
                    if end > start + 1:
                        if piece is None:
                            break
                        continue
                    piece = -1 - ord(line[start])
                starts.append(start)
                ends.append(end)
                used.append(piece)
        counts.append(len(used) - before)
    return counts, starts, ends, used


class Lattices:
    """The segmentations of some words, from their arcs: ``word, start, end, used`` describe them, and characters
    without a piece are numbered from the vocabulary's size on."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray, used: np.ndarray,
                 pieces: Pieces):
        self.pieces, self.lengths = pieces, np.asarray(lengths, np.int64)
        self.word = np.repeat(np.arange(len(self.lengths)), counts)
        self.start, self.end, self.used = (np.array(x, np.int64) for x in (starts, ends, used))
        spelled = self.used < 0
        chars, place = np.unique(self.used[spelled], return_inverse=True)
        self.used[spelled] = len(pieces.logs) + place
        self.byte_lists = [[pieces.byte_ids[b] for b in chr(-1 - c).encode()] for c in chars.tolist()]

    @classmethod
    def of(cls, words: list[str], pieces: Pieces) -> Lattices:
        return cls(np.array([len(w) + 1 for w in words]), *map(np.array, arcs(words, pieces)), pieces)

    def _logs(self, logs: np.ndarray) -> np.ndarray:
        return np.concatenate((logs, [logs[b].sum() for b in self.byte_lists]))[self.used]

    def _reach(self, at: np.ndarray, other: np.ndarray, table: np.ndarray, logs: np.ndarray, order: range) -> None:
        """Fill a table of log sums, place by place, from arcs between ``other`` and ``at``."""
        sort = np.lexsort((self.word, at))
        bounds = np.searchsorted(at[sort], np.arange(table.shape[1] + 1))
        for place in order:
            arcs = sort[bounds[place]: bounds[place + 1]]
            if not len(arcs):
                continue
            values, words = table[self.word[arcs], other[arcs]] + logs[arcs], self.word[arcs]
            first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            top = np.maximum.reduceat(values, first)
            top[top == -np.inf] = 0
            shifted = np.exp(values - np.repeat(top, np.diff(np.append(first, len(arcs)))))
            with np.errstate(divide="ignore"):
                table[words[first], place] = top + np.log(np.add.reduceat(shifted, first))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log probability of reaching each place of each word over all segmentations."""
        table = np.full((len(self.lengths), self.lengths.max() + 1), -np.inf)
        table[:, 0] = 0
        self._reach(self.end, self.start, table, self._logs(logs), range(1, table.shape[1]))
        return table

    def totals(self, logs: np.ndarray) -> np.ndarray:
        """Log probability of each word."""
        return self.forward(logs)[np.arange(len(self.lengths)), self.lengths]

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in so many occurrences of the words."""
        forward, arcs = self.forward(logs), self._logs(logs)
        backward = np.full_like(forward, -np.inf)
        backward[np.arange(len(self.lengths)), self.lengths] = 0
        self._reach(self.start, self.end, backward, arcs, range(forward.shape[1] - 1, -1, -1))
        shares = np.exp(forward[self.word, self.start] + arcs + backward[self.word, self.end]
                        - forward[self.word, self.lengths[self.word]]) * counts[self.word]
        uses = np.bincount(self.used, shares, len(logs) + len(self.byte_lists))
        for n, ids in enumerate(self.byte_lists):
            np.add.at(uses, ids, uses[len(logs) + n])
        return uses[: len(logs)]


def _groups(sizes: np.ndarray, most: int = 1000, long: int = 48) -> Iterator[np.ndarray]:
    """Places of words to work on together, by their lengths; long words stand alone."""
    short = np.flatnonzero(sizes <= long)
    yield from (short[at: at + most] for at in range(0, len(short), most))
    yield from np.flatnonzero(sizes > long)[:, None]


def lattice_table(words: DataFrame, path: str) -> DataFrame:
    """The words with ``length`` (marked) and their arcs ``starts, ends, used``, looked up in the vocabulary once for all
    rounds and for the scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in slices(batches, 2048):
            texts = batch.column("word").to_pylist()
            counts, *lists = arcs(texts, pieces)
            ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len(t) + 1 for t in texts], pa.int32()),
                 *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in lists)],
                [*batch.schema.names, "length", "starts", "ends", "used"])

    return words.mapInArrow(run, "word string, n long, c long, length int, starts array<int>, ends array<int>, used array<int>")


def _lattices(batch: pa.RecordBatch, pieces: Pieces) -> Iterator[tuple[np.ndarray, Lattices]]:
    """Groups of rows of a lattice table, as places in the batch and their lattices."""
    lengths = batch.column("length").to_numpy()
    counts = batch.column("starts").value_lengths().to_numpy()
    before = np.cumsum(counts) - counts
    flat = [batch.column(c).flatten().to_numpy() for c in ("starts", "ends", "used")]
    for at in _groups(lengths - 1):
        own = counts[at]
        inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(before[at], own)
        yield at, Lattices(lengths[at], own, *(x[inside] for x in flat), pieces)


_HELD: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _HELD:
        _HELD[path] = load(path)
    return _HELD[path]


def word_counts(documents: DataFrame, teaches: Column) -> DataFrame:
    """``word, n, c``: occurrences in all documents and in those that ``teaches`` picks."""
    rows = documents.select(teaches.cast("long").alias("t"), words_between(ascii_lower(whole_text("text")), BLANKS).alias("words"))
    return rows.select("t", F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("t").alias("c"))


def learn(words: DataFrame, texts: int, path: str, prior: float = PRIOR,
          rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """Log probabilities of the pieces and of the end, and the share of words spelled by pieces.

    ``words`` is a lattice table with training counts ``c``; ``texts`` is the number of training texts. The share of spelled words
    is that of different words among all (Witten and Bell); the others are as frequent as in training.
    """
    pieces = _pieces(path)
    logs, known = pieces.logs, words.where("c > 0").select("c", "length", "starts", "ends", "used")
    for _ in range(rounds):
        sent = words.sparkSession.sparkContext.broadcast(logs)
        counted = known.mapInArrow(_sharing(sent, path), "piece long, uses double").groupBy("piece").agg(
            F.sum("uses").alias("uses")).toPandas()  # a row for each piece of the vocabulary at most
        uses = prior * np.exp(pieces.logs)
        uses[counted["piece"]] += counted["uses"]
        with np.errstate(divide="ignore"):
            logs = np.log(uses / uses.sum())
    total, distinct = known.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    return logs, math.log10((texts + 1) / (total + texts + 2)), (distinct + 1) / (total + distinct + 1)


def _sharing(sent, path: str):
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        sums = np.zeros(len(pieces.logs))
        for batch in batches:
            counts = batch.column("c").to_numpy().astype(float)
            for at, lattices in _lattices(batch, pieces):
                sums += lattices.expected(sent.value, counts[at])
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["piece", "uses"])

    return share


def weighed(words: DataFrame, learned: tuple[np.ndarray, float, float], path: str) -> DataFrame:
    """Add ``lp``, the log10 probability of each word and of going on after it.

    A word is spelled by pieces, over all segmentations, or taken whole with its frequency in training; both
    are added up.
    """
    logs, end, spelled = learned
    sent = words.sparkSession.sparkContext.broadcast(logs)
    total = max(1, words.agg(F.sum("c")).first()[0] or 0)
    on = math.log10(1 - 10 ** end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            found = np.empty(batch.num_rows)
            for at, lattices in _lattices(batch, pieces):
                found[at] = lattices.totals(sent.value)
            with np.errstate(divide="ignore"):
                whole = np.log(batch.column("c").to_numpy() * ((1 - spelled) / total))
            found = np.logaddexp(found + math.log(spelled), whole) / math.log(10) + on
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "n", "c")), pa.array(found)], ["word", "n", "c", "lp"])

    return words.mapInArrow(run, "word string, n long, c long, lp double")


def head(words: DataFrame, most: int = HEAD_WORDS, longest: int = HEAD_CHARS) -> DataFrame:
    """The most frequent words, at most ``most`` of them: those above a count found from a histogram."""
    short = words.where(F.length("word") <= longest)
    level = F.floor(F.log2("n") * 16)
    levels = sorted(((r["level"], r["count"]) for r in short.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, total = math.inf, 0
    for at, count in levels:  # at most 16 levels to each doubling
        total += count
        if total > most:
            break
        least = at
    return short.where(level >= least) if least < math.inf else short.where("false")


def score(documents: DataFrame, teaches: Column, vocabulary: str = "piece_bpe_32k.model",
          head_words: int = HEAD_WORDS) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per document.

    ``teaches``, over the documents' columns, picks what is learned from; null counts as false. Null and empty
    texts have only their end. Base is add-one over words. Rows that share ``doc_id`` and text get equal rows,
    one each; other columns are ignored; without training documents all counts are zero.
    """
    path = tokenizer_path(vocabulary)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"),
                            F.coalesce(teaches, F.lit(False)).alias("t"))
    counted = write_scratch(word_counts(rows, F.col("t")), "words")
    sums = counted.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    texts = rows.where("t").count()
    total, distinct = (sums[0] or 0) + texts, (sums[1] or 0) + (texts > 0)
    segmented = write_scratch(lattice_table(counted, path), "lattices")
    learned = learn(segmented, texts, path)
    words = write_scratch(weighed(segmented, learned, path), "weighed-words")
    drop_scratch(segmented)
    near = head(words, head_words).select("word", "c", "lp").toArrow()  # bounded by head_words
    sent = documents.sparkSession.sparkContext.broadcast((
        uuid.uuid4().hex, near.column("word").to_pylist(), near.column("c").to_numpy(), near.column("lp").to_numpy()))
    schema = "doc_id long, mark long, word string, copies long, tokens long, known long, base double, lp double"
    arrow = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("word", pa.string()), ("copies", pa.int64()),
                       ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lp", pa.float64())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, c, lp = _table(sent)
        for batch in slices(batches):
            out = []
            for doc, mark, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "mark", "text")), strict=True):
                used = Counter(text.encode().translate(_LOWER).split())
                at = np.fromiter(map(places.get, used, repeat(-1)), np.int64, len(used))
                n = np.fromiter(used.values(), np.int64, len(used))
                here = at >= 0
                held, times = at[here], n[here]
                # No word has a blank, so these rows meet no word and are dealt evenly.
                out.append((doc, mark, f" {mark}", 1, int(n.sum()) + 1, int(times[c[held] > 0].sum()),
                            float(times @ np.log10(c[held] + 1.0)), float(times @ lp[held])))
                if not here.all():
                    out += [(doc, mark, word.decode(), 0, times, 0, 0.0, 0.0)
                            for (word, times), known in zip(used.items(), here.tolist(), strict=True) if not known]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    found = rows.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(look, schema)
    rest = words.select(F.col("word").alias("w"), "c", F.col("lp").alias("word_lp"))
    times = F.when(F.col("copies") == 0, F.col("tokens")).otherwise(0)
    each = found.join(rest, F.col("word") == F.col("w"), "left").select(
        "doc_id", "mark", "copies", F.when(F.col("copies") > 0, F.col("tokens")).otherwise(0).alias("tokens"),
        (F.col("known") + F.when(F.col("c") > 0, times).otherwise(0)).alias("known"),
        (F.col("base") + F.coalesce(times * F.log10(F.col("c") + 1), F.lit(0.0))).alias("base"),
        (F.col("lp") + F.coalesce(times * F.col("word_lp"), F.lit(0.0))).alias("lp"))
    ends = 1 if texts else 0
    return each.groupBy("doc_id", "mark").agg(*(F.sum(c).alias(c) for c in ("copies", "tokens", "known", "base", "lp"))).select(
        "doc_id", F.explode(F.array_repeat(F.struct("copies", "tokens", "known", "base", "lp"), F.col("copies").cast("int"))).alias("x"),
    ).select(
        "doc_id", (F.col("x.tokens") / F.col("x.copies")).cast("long").alias("n_tokens"),
        (F.col("x.known") / F.col("x.copies") + ends).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("x.base") / F.col("x.copies") + math.log10(texts + 1)
         - F.col("x.tokens") / F.col("x.copies") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("x.lp") / F.col("x.copies") + learned[1]).alias("score"))


_TABLES: dict[str, tuple] = {}


def _table(sent) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Places of the broadcast words by their bytes, held by a worker for one broadcast at a time, known by its token."""
    token, words, c, lp = sent.value
    if token not in _TABLES:
        _TABLES.clear()
        _TABLES[token] = {w.encode(): i for i, w in enumerate(words)}, c, lp
    return _TABLES[token]
