"""Passages that documents share, exact or with few edits: seeds, collinear chains, alignment.

Seeds are runs of five words, of every 16 neighbouring ones the one with the smallest hash, so that 20 equal
words in a row always have a seed in common. Every place of a seed is joined with the seed's first place (by
document, then position), and with the first that has the same 34 words from there on as well. Each 50 words in a
row belong to the seed that their first 16 runs choose; those that the latter place does not have are joined with
the first place that has them. So 50 equal words are found whatever parts of them stand in documents before. That
makes 18 matches a place at most, two as a rule, however many documents share it. The matches of two
documents are chained in order: a chain gains for each seed and pays for the words between, and a Fenwick tree
over positions in the other document gives each seed's best predecessor. Chains that span enough words, or have a
match of 34 words, are aligned along their diagonals; a passage is where at least 0.8 of its runs of five words agree over 50 words or more.

Seeds outside of the passages found so far go on: where their first places are in documents without the passage, they
are compared with the first place of every different surrounding (45 words on either side) in the documents before, in
blocks for hot seeds, and linked with the first that holds a passage. What they give is aligned like the rest. That
step is quadratic in the different surroundings of a seed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.common import BLANKS, drop_scratch, free_name, slices, whole_text, words_between, write_scratch

RUN, WINDOW = 5, 16
LEAST_WORDS, LEAST_SIMILARITY = 50, 0.8
#: Words from a seed on that every passage has in common: it has a seed among its first 16 runs.
CONTEXT = LEAST_WORDS - WINDOW
#: Runs on either side of a seed that a passage of ``LEAST_WORDS`` words with the seed in it can have.
REACH = LEAST_WORDS - RUN
#: Runs of the shortest passage, and how many of them agree.
_LEAST_RUNS = LEAST_WORDS - RUN + 1
_ENOUGH = math.ceil(_LEAST_RUNS * LEAST_SIMILARITY)
#: Places of one seed are compared in blocks of about so many by as many.
_PLACES = 2048
#: Words between neighbours of a chain.
MOST_GAP = 40
#: What a chain pays for each word between two seeds, in either document; a seed gains one.
GAP_COST = 1 / 64
#: Passages are fetched in steps of so many words.
_STEP = 64
#: Chains that begin in so many words of either document are aligned together.
_BLOCK = 2048
#: Runs in a row that may disagree inside a passage; a changed word takes five.
_APART = 4 * RUN
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

FOUND = ("doc_id long, mark long, start int, end int, other_id long, other_mark long, other_start int, other_end int, "
         "similarity double")


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
#: Bytes that are hashed at once.
_PIECE = 1 << 18
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) >= size:
        return _POWERS
    size = max(size, _PIECE + 1)
    found = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, base, np.uint64))) for base in (_FACTOR, _INVERSE)]
    if size <= 4 * _PIECE:
        _POWERS[:] = found
    return found


def word_hashes(text: str) -> np.ndarray:
    """A hash of every word, small letters A-Z for capital ones."""
    return hashed_together([text])[0]


def hashed_together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, one after another, and where each text's words begin, with their number at the end.

    Hashes are sums of letters times powers of their place, taken from running sums, so that no word is handled by itself.
    """
    lines = [text.encode() for text in texts]
    line = np.frombuffer(b" ".join(lines).translate(_LOWER), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[line], [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + _PIECE, "right")))
        piece = line[base: ends[stop - 1]]
        powers, inverse = _powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_LETTERS[piece] * powers[:len(piece)], out=sums[1:])
        begin, end = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (sums[end] - sums[begin]) * inverse[begin]
        at = stop
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32)), np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in lines)]))


def groups_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts, first and last, that together are short; a long one is by itself."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > _PIECE:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if texts:
        yield begin, len(texts)


def runs_of(texts: list[str]) -> list[np.ndarray]:
    """The runs of every text."""
    out = []
    for begin, end in groups_of(texts):
        words, bounds = hashed_together(texts[begin:end])
        hashes = runs(words)
        out += [hashes[a: max(a, b - RUN + 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return out


def runs(words: np.ndarray, length: int = RUN) -> np.ndarray:
    """A hash of every run of ``length`` words: sums of powers, put together from runs half as long."""
    if len(words) < length:
        return words[:0]
    done, joined, double, size, step = 0, np.zeros(len(words), np.uint64), words, 1, np.array([_FACTOR])
    while True:
        if length & size:
            n = len(words) - done - size + 1
            joined = joined[:n] * step + double[done: done + n]
            done += size
        if 2 * size > length:
            break
        n = len(double) - size
        double = double[:n] * step + double[size:]
        size, step = 2 * size, np.multiply(step, step)
    joined = joined ^ (joined >> np.uint64(29))
    return joined * np.uint64(0xBF58476D1CE4E5B9)


def chosen(hashes: np.ndarray, window: int = WINDOW, places: np.ndarray | None = None) -> np.ndarray:
    """For every ``window`` neighbouring runs, the position of the smallest hash, of equal ones the first; rising.

    A key has the hash above and the position below; least keys of longer windows come from those half as long.
    ``places`` are the positions where they do not count from zero on.
    """
    if len(hashes) <= window and places is None:
        return np.array([int(hashes.argmin())] if len(hashes) else [], np.int64)
    places = np.arange(len(hashes)) if places is None else places
    low = np.uint64(0xFFFFFF)
    keys, size = (hashes & ~low) | (places.astype(np.uint64) & low), 1
    while size < window:
        step = min(size, window - size)
        keys = np.minimum(keys[:-step], keys[step:])
        size += step
    start = np.arange(len(keys))
    return start + (((keys & low).astype(np.int64) - places[:len(keys)]) & 0xFFFFFF)


def _seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the seeds of a document, their hashes, and of each 50 words in a row the seed they choose."""
    hashes = runs(words)
    places = chosen(hashes)
    first = np.append(True, places[1:] != places[:-1])
    at = places[first]
    return at, hashes[at], np.cumsum(first) - 1


def seeds_together(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another: which text each seed is in, its place among all words, and its hash. Texts of fewer than
    ``LEAST_WORDS`` words have none."""
    sizes = np.diff(bounds)
    if not len(sizes) or sizes.max() < LEAST_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.int64), words[:0]
    hashes = runs(words)
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(hashes)]
    inside = np.arange(len(hashes)) - bounds[text]
    # A window belongs to a text if all of its runs do.
    whole = (inside + RUN + WINDOW - 1 <= sizes[text]) & (sizes[text] >= LEAST_WORDS)
    places = chosen(hashes, places=inside)
    places = places[whole[:len(places)]]
    at = places[np.append(True, places[1:] != places[:-1])]
    return text[at], at, hashes[at]


def seed_places(documents: DataFrame) -> DataFrame:
    """``seed, context, around, wide, doc_id, at``: ``at`` has the document's mark in its upper and the word in its
    lower half; ``context`` hashes the ``CONTEXT`` words from there on, null near the end; ``around`` hashes those and
    as many words on either side as a passage can have beside them, as far as there are any; ``wide`` hashes all words
    that a passage of ``LEAST_WORDS`` words with the seed in it can have.

    Documents of fewer than ``LEAST_WORDS`` words hold no passage and have no seeds.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.arange(1, REACH + 1, dtype=np.uint64)  # the ends of a text differ from any words
        for batch in slices(batches):
            marks, texts = batch.column("mark").to_numpy(), batch.column("text").to_pylist()
            for begin, end in groups_of(texts):
                words, bounds = hashed_together(texts[begin:end])
                row, at, hashes = seeds_together(words, bounds)
                if not len(at):
                    continue
                sizes, inside = np.diff(bounds)[row], at - bounds[row]
                near = np.where(inside <= sizes - CONTEXT, np.append(runs(words, CONTEXT), np.zeros(CONTEXT, np.uint64))[at], np.uint64(0))
                # Every text between edges of its own.
                lead = REACH * (2 * np.arange(end - begin) + 1)
                padded = np.empty(len(words) + 2 * REACH * (end - begin), np.uint64)
                padded[np.arange(len(words)) + np.repeat(lead, np.diff(bounds))] = words
                padded[((bounds[:-1] + lead)[:, None] + np.arange(-REACH, 0)).ravel()] = np.tile(edge, end - begin)
                padded[((bounds[1:] + lead)[:, None] + np.arange(REACH)).ravel()] = np.tile(~edge, end - begin)
                first = bounds[row] + lead[row]
                around = (runs(padded, CONTEXT + 2 * WINDOW)[first + np.minimum(inside, sizes - CONTEXT) - WINDOW] >> np.uint64(32)).astype(np.uint32)
                wide = runs(padded, RUN + 2 * REACH)[first + inside - REACH]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(near.view(np.int64)), pa.array(around.view(np.int32)), pa.array(wide.view(np.int64)),
                     batch.column("doc_id").take(pa.array(begin + row)), pa.array(inside | (marks[begin + row] << 32))],
                    ["seed", "context", "around", "wide", "doc_id", "at"])

    rows = _marked(documents).mapInArrow(run, "seed long, context long, around int, wide long, doc_id long, at long")
    return rows.withColumn("context", F.nullif("context", F.lit(0).cast("long")))


def window_places(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``context, windows, doc_id, at`` of the wanted seeds ``context, doc_id, at``: ``windows`` hashes each
    ``LEAST_WORDS`` words whose first runs choose the seed. They all hold the context, so 32 bits tell them apart."""
    per = wanted.groupBy(F.col("doc_id").alias("d"), _mark("at").alias("m")).agg(
        F.sort_array(F.collect_set(_place("at"))).alias("seeds"))
    rows = _marked(documents).join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select(
        "doc_id", "mark", "text", "seeds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            near, whole, held, places, sizes = [], [], [], [], []
            for mark, text, seeds in zip(*(batch.column(c).to_pylist() for c in ("mark", "text", "seeds")), strict=True):
                words = word_hashes(text)
                at, _, owner = _seeds(words)
                windows = (runs(words, LEAST_WORDS) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                counts = np.bincount(owner[:len(windows)], minlength=len(at))
                ends = np.cumsum(counts)
                chosen_here = np.searchsorted(at, np.array(seeds, np.int64))
                own = counts[chosen_here]
                inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat((ends - counts)[chosen_here], own)
                whole.append(windows[inside])
                held.append(own)
                near.append(runs(words, CONTEXT)[at[chosen_here]].view(np.int64))
                places.append(at[chosen_here] | (mark << 32))
                sizes.append(len(chosen_here))
            if sizes:
                doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
                ends = pa.array(np.append(0, np.cumsum(np.concatenate(held))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(near)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(whole))), doc,
                     pa.array(np.concatenate(places))], ["context", "windows", "doc_id", "at"])

    # Repeated rows give the same places again.
    return rows.mapInArrow(run, "context long, windows array<int>, doc_id long, at long")


def with_first(places: DataFrame, *keys: str) -> DataFrame:
    """Add ``other_id, other_at``, the first place with the same keys, to the places whose keys are found twice."""
    known = places.where(F.col(keys[0]).isNotNull())
    first = known.groupBy(*keys).agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        *keys, F.col("first.doc_id").alias("other_id"), F.col("first.at").alias("other_at"))
    # Written, so that both sides of the join come from plain shuffles and Spark can split a hot key.
    first = write_scratch(first, f"first-{keys[-1]}")
    found = write_scratch(places.hint("merge").join(first, list(keys)), f"with-first-{keys[-1]}")
    drop_scratch(first)
    return found


def _marked(documents: DataFrame) -> DataFrame:
    """Documents with a 31-bit mark of their text, which tells rows with one id apart."""
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"),
    ).withColumn("mark", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)))


def _mark(at: str) -> Column:
    return F.shiftrightunsigned(at, 32)


def _place(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def matches(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each two documents with two or more seeds, or a context, in common: their places as
    ``pairs (x, y, sure)``, sure with the words of a context. And the places of all seeds that are found twice, with the
    first of each: ``seed, wide, doc_id, at, other_id, other_at``."""
    # Written without the text: the first places and the join with them read the same rows.
    seeds = write_scratch(seed_places(documents), "seeds")
    seeded = with_first(seeds.select("seed", "wide", "doc_id", "at"), "seed")
    near = with_first(seeds.select("context", "around", "doc_id", "at"), "context")
    # Where all places of a context have the same words around it, the first has every window of the others.
    mixed = write_scratch(near.groupBy("context").agg(F.min("around").alias("low"), F.max("around").alias("high")).where(
        "low <> high").select("context"), "mixed-contexts")
    wide = write_scratch(window_places(documents, near.join(mixed, "context").select("context", "doc_id", "at")), "windows")
    drop_scratch(seeds)
    firsts = write_scratch(near.select("context", "other_id", "other_at").distinct().join(mixed, "context"), "mixed-firsts")
    theirs = write_scratch(wide.select("context", F.col("doc_id").alias("o"), F.col("at").alias("p"), F.col("windows").alias("theirs")).join(
        firsts, ["context"]).where(F.col("o").eqNullSafe(F.col("other_id")) & (F.col("p") == F.col("other_at"))).select(
        "context", "theirs").dropDuplicates(["context"]), "first-windows")
    missing = wide.hint("merge").join(theirs, "context").select(
        "context", "doc_id", "at", F.array_except("windows", "theirs").alias("missing"))
    first = F.min(F.struct("doc_id", "at")).over(Window.partitionBy("context", "window"))
    rest = missing.where(F.size("missing") > 0).select("context", F.explode("missing").alias("window"), "doc_id", "at").select(
        "doc_id", "at", first.alias("first")).select("doc_id", "at", "first.*").toDF("doc_id", "at", "other_id", "other_at").where(
        ~(F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("at") == F.col("other_at"))))
    columns = ["doc_id", "at", "other_id", "other_at"]
    rest = write_scratch(rest.select(*columns).distinct(), "windows-elsewhere")
    for done in (mixed, wide, firsts, theirs):
        drop_scratch(done)
    linked = seeded.select(*columns, F.lit(False).alias("sure")).unionByName(
        near.select(*columns).unionByName(rest).withColumn("sure", F.lit(True)))
    return _by_documents(linked), seeded


def _by_documents(linked: DataFrame) -> DataFrame:
    """Linked places ``doc_id, at, other_id, other_at, sure`` of each two documents, as ``pairs``."""
    linked = linked.select(
        "doc_id", _mark("at").alias("mark"), "other_id", _mark("other_at").alias("other_mark"),
        F.struct(_place("at").alias("x"), _place("other_at").alias("y"), "sure").alias("pair"))
    linked = linked.where(~(F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("mark") == F.col("other_mark"))))
    span = F.max("pair.x") - F.min("pair.x")
    return linked.groupBy("doc_id", "mark", "other_id", "other_mark").agg(
        F.collect_list("pair").alias("pairs"), span.alias("span"), F.max("pair.sure").alias("sure"),
    ).where(F.col("sure") | (F.col("span") + RUN >= LEAST_WORDS - 2 * (WINDOW - 1))).drop("span", "sure")


def other_holders(documents: DataFrame, seeded: DataFrame, found: DataFrame) -> DataFrame:
    """Links ``doc_id, at, other_id, other_at, sure`` for seeds outside of all passages found so far.

    The first place of such a seed may be in a document without the passage. So the seed is compared, by the runs around
    it, with the first place of every different surrounding in earlier documents, and linked with the first that shares a
    passage. Places with equal surroundings have the same 50 words around the seed, so one stands for all of them.
    """
    kinds = write_scratch(seeded.groupBy("seed", "wide").agg(F.min(F.struct("doc_id", "at")).alias("kind")), "kinds")
    several = kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    later = seeded.where(~(F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("at") == F.col("other_at")))).select(
        "seed", "doc_id", "at").join(several, "seed")
    # Places and the starts of passages in the order of words: the furthest end so far tells whether a place is in a passage.
    ends = found.groupBy("doc_id", "mark", F.col("start").alias("place")).agg(F.max("end").alias("end"))
    both = later.withColumns({"mark": _mark("at"), "place": _place("at")}).unionByName(ends, allowMissingColumns=True)
    far = F.max("end").over(Window.partitionBy("doc_id", "mark").orderBy("place", F.col("end").desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    asked = write_scratch(both.withColumn("far", F.coalesce(far, F.lit(0))).where(
        F.col("at").isNotNull() & (F.col("far") < F.col("place") + RUN)).select("seed", "doc_id", "at").distinct(), "asked")
    last = asked.groupBy("seed").agg(F.max(F.struct("doc_id", "at")).alias("last"), F.count(F.lit(1)).alias("n_asked"))
    told = write_scratch(kinds.join(last, "seed").where("kind < last").select("seed", "kind.*", "n_asked"), "told")
    hot = write_scratch(told.groupBy("seed").agg(F.max("n_asked").alias("n_asked"), F.count(F.lit(1)).alias("n_told")).where(
        F.greatest("n_asked", "n_told") > _PLACES), "hot-seeds")
    rows = surroundings(documents, asked.select("doc_id", "at", F.lit(1).alias("asks")).unionByName(
        told.select("doc_id", "at", F.lit(0).alias("asks"))))

    def blocks(n: str) -> Column:
        return F.coalesce(F.ceil(F.col(n) / _PLACES), F.lit(1)).cast("int")

    # Every block of places that ask meets every block of places that are told of.
    own, others = (F.when(F.col("asks") == 1, F.lit(first)).otherwise(F.lit(not first)) for first in (True, False))
    rows = rows.join(hot, "seed", "left")
    for name, here, n in (("left", own, "n_asked"), ("right", others, "n_told")):
        block = F.pmod(F.xxhash64("doc_id", "at"), blocks(n)).cast("int")
        rows = rows.withColumn(name, F.explode(F.when(here, F.array(block)).otherwise(F.sequence(F.lit(0), blocks(n) - 1))))
    groups = rows.groupBy("seed", "left", "right").agg(
        F.sum("asks").alias("n"), F.collect_list(F.struct("asks", "doc_id", "at", "low", "runs")).alias("places")).where(
        (F.col("n") > 0) & (F.col("n") < F.size("places"))).select("places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat, ends = batch.column("places").flatten(), np.cumsum(batch.column("places").value_lengths().to_numpy())
            asks, at, low = (flat.field(n).to_numpy() for n in ("asks", "at", "low"))
            doc = flat.field("doc_id")
            known, ids = doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            around = numbered([np.frombuffer(x, np.uint16) for x in flat.field("runs").to_pylist()])
            mine, theirs, links = [], [], []
            for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                order = begin + np.lexsort((at[begin:end], ids[begin:end], known[begin:end]))
                for i, j, pairs in first_alike(order, asks, ids, known, at, low, around):
                    mine.append(i)
                    theirs.append(j)
                    links.append([{"x": x, "y": y} for x, y in pairs])
            if mine:
                left, right = pa.array(mine), pa.array(theirs)
                yield pa.RecordBatch.from_arrays(
                    [doc.take(left), flat.field("at").take(left), doc.take(right), flat.field("at").take(right),
                     pa.array(links, pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))],
                    ["doc_id", "at", "other_id", "other_at", "links"])

    best = groups.mapInArrow(run, "doc_id long, at long, other_id long, other_at long, links array<struct<x:int,y:int>>").groupBy(
        "doc_id", "at").agg(F.min(F.struct("other_id", "other_at", "links")).alias("best"))
    upper = F.lit(-(1 << 32))
    return best.select("doc_id", "at", "best.other_id", "best.other_at", F.explode("best.links").alias("p")).select(
        "doc_id", F.col("at").bitwiseAND(upper).bitwiseOR(F.col("p.x").cast("long")).alias("at"), "other_id",
        F.col("other_at").bitwiseAND(upper).bitwiseOR(F.col("p.y").cast("long")).alias("other_at"), F.lit(True).alias("sure"))


def surroundings(documents: DataFrame, places: DataFrame) -> DataFrame:
    """``seed, asks, doc_id, at, low, runs`` of the places ``doc_id, at, asks``: 16 bits of the hash of every run that a
    passage of ``LEAST_WORDS`` words with the seed in it can have, ``low`` the first one's word."""
    per = places.groupBy(F.col("doc_id").alias("d"), _mark("at").alias("m")).agg(
        F.sort_array(F.collect_set(_place("at").cast("long") * 2 + F.col("asks"))).alias("wanted"))
    rows = _marked(documents).join(per.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select(
        "doc_id", "mark", "text", "wanted").dropDuplicates(["doc_id", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seeds, asks, places, lows, around, sizes = [], [], [], [], [], []
            marks, texts, lists = (batch.column(c).to_pylist() for c in ("mark", "text", "wanted"))
            for mark, hashes, wanted in zip(marks, runs_of(texts), lists, strict=True):
                short = (hashes >> np.uint64(48)).astype(np.uint16).tobytes()
                codes = np.array(wanted, np.int64)
                at = codes >> 1
                low, high = np.maximum(at - REACH, 0), np.minimum(at + REACH + 1, len(hashes))
                seeds.append(hashes[at].view(np.int64))
                asks.append((codes & 1).astype(np.int32))
                places.append(at | (mark << 32))
                lows.append(low.astype(np.int32))
                around += [short[2 * a: 2 * b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                sizes.append(len(at))
            if sizes:
                doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), sizes)))
                seeds, asks, places, lows = (pa.array(np.concatenate(v)) for v in (seeds, asks, places, lows))
                yield pa.RecordBatch.from_arrays([seeds, asks, doc, places, lows, pa.array(around, pa.binary())],
                                                 ["seed", "asks", "doc_id", "at", "low", "runs"])

    return rows.mapInArrow(run, "seed long, asks int, doc_id long, at long, low int, runs binary")


def numbered(around: list[np.ndarray]) -> list[np.ndarray]:
    """Each row's runs in the upper bits and in the lower byte which of the row's equal runs one is, from zero on."""
    sizes = np.array([len(x) for x in around])
    values = np.concatenate(around).astype(np.int64) | (np.repeat(np.arange(len(around)), sizes) << 16)
    order = np.argsort(values, kind="stable")
    new = np.append(True, np.diff(values[order]) != 0)
    nth = np.empty(len(values), np.int64)
    nth[order] = np.arange(len(values)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.split(((values & 0xFFFF) << 8 | nth).astype(np.uint32), np.cumsum(sizes)[:-1])


def first_alike(order: np.ndarray, asks: np.ndarray, ids: np.ndarray, known: np.ndarray, at: np.ndarray, low: np.ndarray,
                around: list[np.ndarray]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """For places that ask, the first place told of, in a document before, with a passage in the runs around both, and
    places of the passage in both documents. ``order`` has the places as documents go.

    Runs that few places are told to have are looked up; those of many only for pairs that can have a passage with them.
    """
    asking = asks[order] == 1
    # Places told of in documents before; those of the same document have none of its passages to tell of.
    steps = [np.diff(v[order]) != 0 for v in (ids, known, at >> 32)]
    document = np.cumsum(np.append(False, steps[0] | steps[1] | steps[2]))
    earlier = np.searchsorted(document[~asking], document[asking])
    if not (earlier > 0).any():
        return
    asked, told, earlier = order[asking][earlier > 0], order[~asking][:earlier.max()], earlier[earlier > 0]
    n, many = len(told), max(16, len(told) // 8)
    values, owner = np.concatenate([around[j] for j in told]), np.repeat(np.arange(n), [len(around[j]) for j in told])
    sort = np.argsort(values, kind="stable")
    values, owner = values[sort], owner[sort]
    common, counts = np.unique(values, return_counts=True)
    common = np.append(common[counts > many], np.iinfo(np.uint32).max)
    place = np.searchsorted(common, values)
    has = np.zeros((n, len(common)), bool)
    has[owner[common[place] == values], place[common[place] == values]] = True
    step = max(1, (1 << 18) // n)
    for start in range(0, len(asked), step):
        some, before = asked[start: start + step], earlier[start: start + step]
        mine, sizes = np.concatenate([around[i] for i in some]), [len(around[i]) for i in some]
        rows, places = np.repeat(np.arange(len(some)), sizes), np.concatenate([np.arange(x) for x in sizes])
        begin = np.searchsorted(values, mine)
        size = np.searchsorted(values, mine, "right") - begin
        frequent = size > many
        first, last = np.full(len(some), 2 * REACH), np.zeros(len(some), np.int64)
        first[rows[frequent][::-1]], last[rows[frequent]] = places[frequent][::-1], places[frequent]
        least = np.maximum(_ENOUGH - np.bincount(rows[frequent], minlength=len(some)), last - first < _LEAST_RUNS - 1)
        size[frequent] = 0
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        pairs = np.repeat(rows * n, size) + owner[inside]
        seen = np.bincount(pairs, minlength=len(some) * n).reshape(len(some), n)
        found = np.flatnonzero((seen >= least[:, None]) & (np.arange(n) < before[:, None]))
        row = np.full(len(some) * n, -1, np.int32)
        row[found] = np.arange(len(found))
        kept = np.flatnonzero(row[pairs] >= 0)
        agree = np.zeros((len(found), 2 * REACH + 1), bool)
        agree[row[pairs[kept]], np.repeat(places, size)[kept]] = True
        ends, bounds = np.searchsorted(found, np.arange(len(some) + 1) * n), np.append(0, np.cumsum(sizes))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            here = bounds[k] + np.flatnonzero(frequent[bounds[k]: bounds[k + 1]])
            agree[ends[k]: ends[k + 1], places[here]] = has[np.ix_(
                found[ends[k]: ends[k + 1]] - k * n, np.searchsorted(common, mine[here]))]
        held = found[_may_hold(agree)]
        bounds = np.searchsorted(held, np.arange(len(some) + 1) * n)
        for k in np.flatnonzero(np.diff(bounds)).tolist():
            i = int(some[k])
            for j in told[held[bounds[k]: bounds[k + 1]] - k * n].tolist():
                shared = _shared(around[i], around[j], int(at[i] & 0xFFFFFFFF) - int(low[i]), int(at[j] & 0xFFFFFFFF) - int(low[j]))
                if shared:
                    yield i, j, [(int(low[i]) + x, int(low[j]) + y) for x, y in shared]
                    break


def _may_hold(agree: np.ndarray) -> np.ndarray:
    """Whether some stretch long enough for a passage begins and ends with runs that agree and has the share of them."""
    out = np.zeros(len(agree), bool)
    steps = np.array([-round(100 * LEAST_SIMILARITY), round(100 * (1 - LEAST_SIMILARITY))], np.int16)
    for start in range(0, len(agree), 1 << 14):
        part = agree[start: start + (1 << 14)]
        sums = np.zeros((len(part), part.shape[1] + 1), np.int16)
        np.cumsum(steps[part.astype(np.int8)], axis=1, dtype=np.int16, out=sums[:, 1:])
        lowest = np.minimum.accumulate(np.where(part, sums[:, :-1], np.iinfo(np.int16).max), axis=1)[:, :1 - _LEAST_RUNS]
        out[start: start + (1 << 14)] = (part[:, _LEAST_RUNS - 1:] & (sums[:, _LEAST_RUNS:] >= lowest)).any(axis=1)
    return out


def _shared(left: np.ndarray, right: np.ndarray, x: int, y: int) -> list[tuple[int, int]]:
    """The first and the last place of a passage in the numbered runs around two places of a seed, and the seed's; none if
    there is no passage. Tried are the seed's diagonal and chains of the runs with equal numbers."""
    _, xs, ys = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    left, right = left >> 8, right >> 8
    found = passages_of(left, right, [(np.array([x]), np.array([y]))])
    if not found:
        found = passages_of(left, right, [(xs[c], ys[c]) for c in chains(xs, ys)])
    return [p for start, end, other_start, other_end, _ in found
            for p in ((start, other_start), (x, y), (end - RUN, other_end - RUN))]


def chains(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Chains of matches, best first, each a list of places in ``x`` and ``y``, rising in both.

    The tree holds, for matches with a smaller ``x``, the best score at each ``y`` or below, with what the
    words up to it cost added, so that only a match's own place is left to subtract.
    """
    order = np.lexsort((-y, x))
    order = order[np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))]  # each match once
    if (np.diff(x[order]) > 0).all() and (np.diff(y[order]) > 0).all():
        return _one_chain(order, x[order], y[order])
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size = int(ranks.max())
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    for i in order.tolist():
        cost = GAP_COST * (int(x[i]) + int(y[i]))
        best, at = (-np.inf, -1), int(ranks[i]) - 1
        while at > 0:
            if tree[at] > best:
                best = tree[at]
            at -= at & -at
        gain = best[0] - cost
        score[i] = 1.0 + max(0.0, gain)
        if gain > 0:
            before[i] = best[1]
        entry, at = (score[i] + cost, i), int(ranks[i])
        while at <= size:
            if entry > tree[at]:
                tree[at] = entry
            at += at & -at
    used, found = [False] * len(x), []
    for i in sorted(order.tolist(), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and (x[chain[-1]] - x[i] > MOST_GAP or y[chain[-1]] - y[i] > MOST_GAP):
                found.append(chain[::-1])
                chain = []
            chain.append(i)
            i = before[i]
        if chain:
            found.append(chain[::-1])
    return found


def _one_chain(order: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Chains of matches that rise in both documents: each one's best predecessor is the one before it, which needs no
    tree. Any chain that ends earlier could go through it and gain one more seed for the same words between."""
    dx, dy = np.diff(x), np.diff(y)
    wide, costs = ((dx > MOST_GAP) | (dy > MOST_GAP)).tolist(), (GAP_COST * (dx + dy)).tolist()
    score, parts, tops = 1.0, [[0]], [1.0]
    for i, (gap, cost) in enumerate(zip(wide, costs, strict=True), 1):
        gain = score - cost
        score = 1.0 + max(0.0, gain)
        if gain <= 0 or gap:
            parts.append([])
            tops.append(score)
        parts[-1].append(i)
        tops[-1] = score
    return [order[parts[k]].tolist() for k in sorted(range(len(parts)), key=lambda k: -tops[k])]


def joined(found: list[list[int]], x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Chains in order of ``x``; one that begins behind the last one in both documents, within what is fetched for
    alignment anyway, goes on with it, so that a stretch is aligned once."""
    out: list[list[int]] = []
    for chain in sorted(found, key=lambda c: (x[c[0]], y[c[0]])):
        if out and 0 < x[chain[0]] - x[out[-1][-1]] <= _STEP and 0 < y[chain[0]] - y[out[-1][-1]] <= _STEP:
            out[-1] = out[-1] + chain
        else:
            out.append(chain)
    return out


def candidates(pairs: DataFrame) -> DataFrame:
    """Chains that may hold a passage, with their matches ``xs, ys``: those of two documents that begin in the same
    ``_BLOCK`` words of either are one row, with the stretch of words ``low`` to ``high`` of either that they are in."""
    names = ["doc_id", "mark", "other_id", "other_mark"]
    bounds = ["low", "high", "other_low", "other_high"]
    lists = T.ArrayType(T.ArrayType(T.IntegerType()))
    schema = T.StructType([*(pairs.schema[c] for c in names), *(T.StructField(c, T.IntegerType()) for c in bounds),
                           T.StructField("xs", lists), T.StructField("ys", lists)])
    reach = LEAST_WORDS - 2 * (WINDOW - 1) - RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            rows, out = [], []
            flat = batch.column("pairs").flatten()
            x_all, y_all, sure_all = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "sure"))
            at = 0
            for row, size in enumerate(batch.column("pairs").value_lengths().to_pylist()):
                # Sure ones first: of equal matches the first stays.
                order = at + np.argsort(~sure_all[at: at + size], kind="stable")
                x, y, sure = x_all[order], y_all[order], sure_all[order]
                at += size
                worth = [chain for chain in chains(x, y)
                         if sure[chain].any() or min(x[chain[-1]] - x[chain[0]], y[chain[-1]] - y[chain[0]]) >= reach]
                near: dict[tuple[int, int], list[list[int]]] = {}
                for chain in joined(worth, x, y):
                    near.setdefault((int(x[chain[0]]) // _BLOCK, int(y[chain[0]]) // _BLOCK), []).append(chain)
                for group in near.values():
                    ends = [(int(v[c[0]]), int(v[c[-1]])) for v in (x, y) for c in group]
                    xs, ys = ends[:len(group)], ends[len(group):]
                    rows.append(row)
                    out.append((*_steps(min(a for a, _ in xs), max(b for _, b in xs)), *_steps(min(a for a, _ in ys), max(b for _, b in ys)),
                                [x[c].tolist() for c in group], [y[c].tolist() for c in group]))
            if rows:
                kept = batch.take(pa.array(rows))
                types = [pa.int32()] * 4 + [pa.list_(pa.list_(pa.int32()))] * 2
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(c) for c in names), *(pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True))],
                    names=schema.names)

    return pairs.mapInArrow(run, schema)


def _steps(low: int, high: int) -> tuple[int, int]:
    """Words to fetch around places, in steps, so that neighbours ask for the same."""
    return max(0, low // _STEP - 1) * _STEP, (high // _STEP + 2) * _STEP


def agreeing(left: np.ndarray, right: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """For every run of the left words, its partner among the right runs along the chain, or -1.

    What agrees without a gap around a match is taken whole, whatever other matches of the chain lie in it.
    """
    found = np.full(len(left), -1, np.int64)
    edges = [0, *(xs[1:].tolist()), len(left)]
    shifts = ys - xs
    for shift in np.unique(shifts).tolist():
        low, high = max(0, -shift), min(len(left), len(right) - shift)
        if low < high:
            differs = np.flatnonzero(left[low:high] != right[low + shift: high + shift]) + low
            at = xs[(shifts == shift) & (xs >= low) & (xs < high)]
            after = np.unique(np.searchsorted(differs, at))
            begins, ends = np.append(low - 1, differs)[after] + 1, np.append(differs, high)[after]
            for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
                same = np.arange(begin, end)
                found[same] = np.where(found[same] < 0, same + shift, found[same])
    for k, shift in enumerate(shifts.tolist()):
        # Between two matches either diagonal may hold; the later one has the last word before its match.
        for begin, end in ((edges[k] if k == 0 else xs[k - 1], xs[k] + 1), (xs[k], edges[k + 1])):
            low, high = max(begin, -shift, 0), min(end, len(right) - shift, len(left))
            if low < high:
                at = np.arange(low, high)
                same = at[left[low:high] == right[low + shift: high + shift]]
                found[same] = np.where(found[same] < 0, same + shift, found[same])
    return found


def _longest(sums: np.ndarray) -> tuple[int, int]:
    """The longest stretch over which running sums do not fall."""
    lowest = np.minimum.accumulate(sums)
    begins = np.flatnonzero(np.append(True, lowest[1:] < lowest[:-1]))
    ahead = np.maximum.accumulate(sums[::-1])  # rising; the greatest sum from a place to the end
    ends = len(sums) - 1 - np.searchsorted(ahead, sums[begins] - 1e-9)
    k = int(np.argmax(ends - begins))
    return int(begins[k]), int(ends[k])


def best_stretches(agree: np.ndarray, least: int, similarity: float) -> list[tuple[int, int]]:
    """Stretches of ``least`` or more places of which at least the given share agree, the longest of a part first.

    What lies further apart than ``_APART`` places that do not agree is not one passage. Within such a part the longest
    stretch with the share is taken, without places at its ends that do not agree, and what is left on either side goes on.
    """
    places = np.flatnonzero(agree)
    if len(places) < least * similarity:
        return []
    breaks = np.flatnonzero(np.diff(places) > _APART)
    begins, ends = places[np.append(0, breaks + 1)], places[np.append(breaks, len(places) - 1)] + 1
    found, open_parts = [], list(zip(begins.tolist(), ends.tolist(), strict=True))
    steps = np.where(agree, 1.0 - similarity, -similarity)
    while open_parts:
        low, high = open_parts.pop()
        if high - low < least:
            continue
        begin, end = _longest(np.concatenate(([0.0], np.cumsum(steps[low:high]))))
        inside = np.flatnonzero(agree[low + begin: low + end])
        if not len(inside) or inside[-1] + 1 - inside[0] < least:
            continue
        begin, end = low + begin + int(inside[0]), low + begin + int(inside[-1]) + 1
        found.append((begin, end))
        open_parts += [(low, begin), (end, high)]
    return found


def passages_of(left: np.ndarray, right: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int, float]]:
    """Passages ``start, end, other start, other end, similarity`` along chains, given the runs of both stretches.

    Longer chains come first. One is left out if all its places, with the words that a passage can have around them, lie
    in a passage that is known already: a text that repeats itself has many places for one.
    """
    out: set[tuple[int, int, int, int, float]] = set()
    size, around, least = len(left) + RUN - 1, 2 * _STEP, LEAST_WORDS - RUN + 1
    reach = np.zeros(size + 1, np.int64)  # how far a known passage goes that begins here or before
    for xs, ys in sorted(found, key=lambda c: (-len(c[0]), int(c[0][0]))):
        if (reach[np.maximum(xs - WINDOW, 0)] >= np.minimum(xs + CONTEXT + WINDOW, size)).all():
            continue
        low, high = max(0, int(xs[0]) - around), min(len(left), int(xs[-1]) + around)
        shift = int(ys[0] - xs[0])
        if (ys - xs == shift).all():  # one diagonal: what is equal on it agrees
            low, high = max(low, -shift), min(high, len(right) - shift)
            equal = left[low:high] == right[low + shift: high + shift]
            if np.count_nonzero(equal) < least * LEAST_SIMILARITY:
                continue
            partner = np.where(equal, np.arange(low + shift, high + shift), -1)
        else:
            other_low = max(0, int(ys[0]) - around)
            partner = agreeing(left[low:high], right[other_low: int(ys[-1]) + around], xs - low, ys - other_low)
            partner = np.where(partner >= 0, partner + other_low, -1)
        for begin, end in best_stretches(partner >= 0, least, LEAST_SIMILARITY):
            mates = partner[begin:end]
            share = float((mates >= 0).mean())
            mates = mates[mates >= 0]
            begin, end = low + begin, low + end + RUN - 1
            out.add((begin, end, int(mates.min()), int(mates.max()) + RUN, share))
            np.maximum(reach[begin:], end, out=reach[begin:])
    return sorted(out)


def shared_passages(documents: DataFrame) -> DataFrame:
    """Passages of 50 words or more that a document shares with one before it (by ``doc_id``, null first).

    One row for each: ``doc_id, mark, start, end`` in words, the same of the other document, and
    ``similarity``, the share of five-word runs that agree. Whatever number of documents share a passage, each
    is matched with the first that has it. Rows with equal id and text are one document; rows that share only
    the id are two, told apart by ``mark``. Null, empty and short texts share nothing; other columns are
    ignored. Passages repeated inside one document only are not meant.
    """
    pairs, seeded = matches(documents)
    found = aligned(documents, pairs)
    return merged(found.unionByName(aligned(documents, _by_documents(other_holders(documents, seeded, found)))))


def aligned(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The passages along the chains of the matches of each two documents, written; what led to them goes."""
    chained = lines = write_scratch(candidates(pairs), "chains")
    wanted = lines.select("doc_id", "mark", "low", "high").unionByName(lines.select(
        F.col("other_id").alias("doc_id"), F.col("other_mark").alias("mark"), F.col("other_low").alias("low"),
        F.col("other_high").alias("high"))).distinct()
    texts = _marked(documents).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "text")
    cut = F.array_join(F.slice(words_between(F.col("text"), BLANKS), F.col("low") + 1, F.col("high") - F.col("low")), " ")
    parts = write_scratch(texts.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark"))).select(
        "doc_id", "mark", "low", "high", cut.alias("part")).dropDuplicates(["doc_id", "mark", "low", "high"]), "passage-texts")
    for side, prefix in (("left", ""), ("right", "other_")):
        own = parts.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "mark", "low", "high")), F.col("part").alias(side))
        key = "doc_id" if not prefix else "other_id"
        lines = lines.join(own, F.col(key).eqNullSafe(F.col("_doc_id")) & (F.col(f"{prefix}mark") == F.col("_mark"))
                           & (F.col(f"{prefix}low") == F.col("_low")) & (F.col(f"{prefix}high") == F.col("_high"))).drop(
            "_doc_id", "_mark", "_low", "_high")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t])
                            for n, t in (f.split() for f in FOUND.split(", "))])
        for batch in slices(batches):
            out, lines = [], batch.to_pylist()
            for r, left, right in zip(lines, *(runs_of([r[side] for r in lines]) for side in ("left", "right")), strict=True):
                found = [(np.array(x) - r["low"], np.array(y) - r["other_low"]) for x, y in zip(r["xs"], r["ys"], strict=True)]
                for start, end, other_start, other_end, share in passages_of(left, right, found):
                    out.append({
                        "doc_id": r["doc_id"], "mark": r["mark"], "start": r["low"] + start, "end": r["low"] + end,
                        "other_id": r["other_id"], "other_mark": r["other_mark"], "similarity": share,
                        "other_start": r["other_low"] + other_start, "other_end": r["other_low"] + other_end})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    found = write_scratch(lines.mapInArrow(align, FOUND), "passages")
    drop_scratch(chained)
    drop_scratch(parts)
    return found


def merged(found: DataFrame) -> DataFrame:
    """Rows of two documents that overlap in both, and not one behind the other, made one: from the first start to the
    last end, with the least similarity. Chains that lie near each other find parts of one stretch."""
    key = ["doc_id", "mark", "other_id", "other_mark"]
    spans = F.struct("start", "end", "other_start", "other_end", "similarity")
    one = "struct<start:int,end:int,other_start:int,other_end:int,similarity:double>"

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        over = (span["start"] < last["end"]) & (span["other_start"] < last["other_end"]) & (span["other_end"] > last["other_start"])
        both = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"),
            F.least(last["other_start"], span["other_start"]).alias("other_start"),
            F.greatest(last["other_end"], span["other_end"]).alias("other_end"),
            F.least(last["similarity"], span["similarity"]).alias("similarity"))
        return F.when((F.size(done) > 0) & over, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(
            F.concat(done, F.array(span)))

    grouped = found.groupBy(*key).agg(F.sort_array(F.collect_set(spans)).alias("spans"))
    return grouped.select(*key, F.explode(F.aggregate("spans", F.array().cast(f"array<{one}>"), add)).alias("s")).select(
        "doc_id", "mark", "s.start", "s.end", "other_id", "other_mark", "s.other_start", "s.other_end", "s.similarity")


def without_repeats(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, less the passages that they share with an earlier one; all rows and columns stay.

    ``found`` comes from ``shared_passages``. Words are taken out with the white space after them; ``n_chars``
    is counted anew where there is such a column. A document that is a passage as a whole has an empty text.
    """
    doc, own, held = (free_name(documents, n) for n in ("span_doc", "span_mark", "spans"))
    spans = found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias(held)).select(
        F.col("doc_id").alias(doc), F.col("mark").alias(own), held)
    mark = F.xxhash64(whole_text("text")).bitwiseAND(F.lit(0x7FFFFFFF))
    rows = documents.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (mark == F.col(own)), "left")
    kept = documents.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [text if spans is None else cut_words(text, [(s["start"], s["end"]) for s in spans])
                     for text, spans in zip(batch.column("text").to_pylist(), batch.column(held).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in kept], names=kept.names)

    out = rows.select(*documents.columns, held).mapInArrow(cut, kept)
    return out.withColumn("n_chars", F.length("text").cast(kept["n_chars"].dataType)) if "n_chars" in kept.names else out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans, which may overlap."""
    begins = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        start, end = begins[min(start, len(begins) - 1)], begins[min(end, len(begins) - 1)]
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])
