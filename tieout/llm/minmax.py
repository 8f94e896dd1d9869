"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A set of shingles is hashed under ``PERMUTATIONS`` functions, and both the least and the greatest value of each are kept:
either agrees for two sets with a probability that is their Jaccard similarity, so half the hash evaluations of a min-hash
signature give as many values, with less variance, as the two ends of one permutation vary against each other. Values
are banded; sets that agree in a band meet in a bucket.

Of equal sets one is signed. Within a bucket the sets themselves are compared: a matrix product of their incidence gives
all intersections, and a spanning forest of the true links leaves the task. A large bucket is dealt into blocks,
each with the bucket's most popular member, which connects nearly all that belongs together at a linear cost. What is
then still apart is compared across blocks, the few outside the bucket's largest class against all: nothing is skipped
but pairs that are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import slices, whole_text, write_scratch
from tieout.llm.components import components

SHINGLE = 5
#: Links: 100 times the intersection is at least so many times the union.
SIMILARITY = 85
PERMUTATIONS, ROWS = 72, 6
BANDS = 2 * PERMUTATIONS // ROWS
#: Members of a block of a bucket, and their shingles.
MEMBERS, SHINGLES = 96, 1_500_000
#: Columns of an incidence matrix at a time.
_WIDE = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_RANDOM = np.random.default_rng(85)
_FIRST, _SECOND = (_RANDOM.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))


class _Words(dict):
    """Hashes of words seen lately, of a bounded number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 50_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def shingle_set(text: str, length: int = SHINGLE) -> np.ndarray:
    """Rising 64-bit hashes of the distinct runs of ``length`` words, A-Z lowered; of fewer words the whole sequence,
    without words nothing."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(length, len(words))
    joined = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        joined = joined * _PRIME + hashes[k: k + len(joined)]
    joined ^= joined >> np.uint64(29)
    joined *= _MIX
    return np.unique(joined ^ (joined >> np.uint64(32)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least, then greatest value under each permutation, of a set that is not empty."""
    low = shingles.astype(np.uint32)[:, None]
    high = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    least, most = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(shingles), 512):
        values = low[at: at + 512] * _FIRST
        values ^= high[at: at + 512]
        values *= _SECOND
        np.minimum(least, values.min(0), out=least)
        np.maximum(most, values.max(0), out=most)
    return np.concatenate((least, most))


def _digest(shingles: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _marked(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def signed(documents: DataFrame) -> DataFrame:
    """``doc_id, key, set, n_shingles, bands`` per document: ``set`` is a 128-bit digest of its shingles, null without
    words, ``key`` hashes its id and text, ``bands`` has a hash for each band of the signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(1, ROWS + 1, dtype=np.uint64) * _PRIME
        for batch in slices(batches):
            sets = [shingle_set(x) for x in batch.column("text").to_pylist()]
            bands: list[np.ndarray | None] = []
            for found in sets:
                if len(found):
                    rows = signature(found).reshape(2, PERMUTATIONS).T.reshape(BANDS, ROWS).astype(np.uint64)
                    mixed = ((rows + places) * _MIX) ^ (rows << np.uint64(31))
                    bands.append((mixed * places).sum(1, dtype=np.uint64).view(np.int64))
                else:
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([_digest(s) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "key", "set", "n_shingles", "bands"])

    return _marked(documents).mapInArrow(run, "doc_id long, key long, set binary, n_shingles long, bands array<long>")


def _shingles_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``set, shingles`` of the documents named by ``key, set``."""
    rows = _marked(documents).join(wanted.select("key", "set").hint("merge"), "key").select("set", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(x) for x in batch.column("text").to_pylist()]
            # Two documents may share a key: the digest tells.
            keep = [k for k, (s, name) in enumerate(zip(found, batch.column("set").to_pylist(), strict=True)) if _digest(s) == name]
            yield pa.RecordBatch.from_arrays(
                [batch.column("set").take(pa.array(keep, pa.int64())),
                 pa.array([found[k].view(np.int64) for k in keep], pa.list_(pa.int64()))], ["set", "shingles"])

    # Repeated rows give a set as often as they stand there.
    return rows.mapInArrow(run, "set binary, shingles array<long>").groupBy("set").agg(F.first("shingles").alias("shingles"))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right ones, by products of their incidence; of a set with
    itself, where both sides are one list, less."""
    a, b = np.concatenate(left), np.concatenate(right)
    if left is right:  # what stands in one set only tells nothing about two
        values, times = np.unique(a, return_counts=True)
        common = values[times > 1]
    else:
        common = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    found = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for sets, flat in ((left, a), (right, b)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
        held = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        owner, at = owner[held], at[held]
        order = np.argsort(at, kind="stable")
        sides.append((len(sets), owner[order], at[order]))
    for begin in range(0, len(common), _WIDE):
        blocks = []
        for n, owner, at in sides:
            part = slice(*np.searchsorted(at, (begin, begin + _WIDE)))
            block = np.zeros((n, min(_WIDE, len(common) - begin)), np.float32)
            block[owner[part], at[part] - begin] = 1
            blocks.append(block)
        found += (blocks[0] @ blocks[1].T).astype(np.int64)
    return found


def true_links(left: list[np.ndarray], right: list[np.ndarray], similarity: int = SIMILARITY) -> np.ndarray:
    """Places (left, right) of all sets that are similar enough."""
    shared = intersections(left, right)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return np.argwhere(100 * shared >= similarity * (sizes - shared))


def _forest(links: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of links between places below ``n``, those that connect something new."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for a, b in links.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            kept.append((a, b))
    return kept


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _linked(table: pa.Table) -> pa.Table:
    """Links, enough to connect all, among the rows ``set, shingles`` of a block; with ``side`` only those between a row
    of side 1 and another, of different ``class``."""
    names = table.column("set").to_pylist()
    lengths = table.column("shingles").combine_chunks()
    ends = lengths.offsets.to_numpy()
    flat = lengths.values.to_numpy().view(np.uint64)
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    if "side" in table.column_names:
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if not len(left) or not len(right):
            return _LINKS.empty_table()
        found = true_links([sets[k] for k in left], [sets[k] for k in right])
        found = np.stack((left[found[:, 0]], right[found[:, 1]]), 1)
        known = np.unique(table.column("class").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        found = found[known[found[:, 0]] != known[found[:, 1]]]
    else:
        found = true_links(sets, sets)
        found = found[found[:, 0] < found[:, 1]]
    kept = _forest(found, len(sets))
    return pa.table({"a": [names[a] for a, _ in kept], "b": [names[b] for _, b in kept]}, schema=_LINKS)


def buckets(sets: DataFrame) -> DataFrame:
    """``bucket, set, n_shingles, blocks, popular`` for each set that meets another in a band.

    Of buckets with the same members one is kept, told by count and two sums of hashes. ``blocks`` is into how many parts
    the bucket is dealt; ``popular`` adds up the members of the set's large buckets.
    """
    banded = sets.select("set", "n_shingles", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "set", "n_shingles")
    met = banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), F.bit_xor(F.xxhash64("set")).alias("one"),
        F.bit_xor(F.xxhash64("set", F.lit(1))).alias("two")).where("n > 1")
    once = met.groupBy("n", "weight", "one", "two").agg(F.min("bucket").alias("bucket")).select(
        "bucket", F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("weight") / SHINGLES)).alias("blocks"), "n")
    # Written, so that both sides of the join come from plain shuffles and Spark can split a hot bucket.
    once = write_scratch(once, "minmax-met")
    return banded.hint("merge").join(once, "bucket")


def _blocked(members: DataFrame) -> DataFrame:
    return members.withColumn("block", F.pmod(F.xxhash64("set", F.lit(7)), "blocks"))


def _numbers(count: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)


def links(documents: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between set digests, enough to connect all sets that share a bucket and are similar.

    ``sets`` has the distinct sets with the ``key`` of a document of each.
    """
    members = write_scratch(buckets(sets), "minmax-members")
    shingles = write_scratch(_shingles_of(documents, sets.join(members.select("set").distinct().hint("merge"), "set", "left_semi")),
                             "minmax-shingles")
    large = members.where("blocks > 1")
    popular = large.groupBy("set").agg(F.sum("n").alias("popular"))
    hubs = large.join(popular.hint("merge"), "set").groupBy("bucket", "blocks").agg(
        F.max(F.struct("popular", "set")).alias("hub")).select("bucket", "blocks", F.col("hub.set").alias("set"))
    everywhere = hubs.select("bucket", "set", F.explode(_numbers("blocks")).alias("block"))
    first = _blocked(members).select("bucket", "set", "block").unionByName(everywhere).distinct().hint("merge").join(
        shingles, "set")
    found = write_scratch(first.groupBy("bucket", "block").applyInArrow(_linked, "a binary, b binary").distinct(), "minmax-links")
    if large.isEmpty():
        return found
    return found.unionByName(write_scratch(_across(large, shingles, found), "minmax-across"))


def _across(large: DataFrame, shingles: DataFrame, found: DataFrame) -> DataFrame:
    """Links between members of large buckets that ``found`` leaves in different classes."""
    known = components(found).select(F.col("node").alias("set"), F.col("root"))
    members = write_scratch(_blocked(large).hint("merge").join(known, "set", "left").select(
        "bucket", "set", "block", "blocks", F.coalesce("root", "set").alias("class")), "minmax-classes")
    sizes = members.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("most"), F.count(F.lit(1)).alias("classes")).where(
        "classes > 1").select("bucket", F.col("most.class").alias("main"))
    apart = write_scratch(members.hint("merge").join(main, "bucket"), "minmax-apart")
    outside = apart.where("class <> main")
    # The outside ones are dealt by themselves into blocks; every member meets each of those.
    counts = outside.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    dealt = apart.hint("merge").join(counts, "bucket")
    against = dealt.select("bucket", "set", "class", "block", F.lit(0).alias("side"),
                           F.explode(_numbers("parts")).alias("part"))
    asking = dealt.where("class <> main").select(
        "bucket", "set", "class", F.explode(_numbers("blocks")).alias("block"), F.lit(1).alias("side"),
        F.pmod(F.xxhash64("set", F.lit(11)), "parts").alias("part"))
    pairs = asking.unionByName(against).hint("merge").join(shingles, "set")
    return pairs.groupBy("bucket", "block", "part").applyInArrow(_linked, "a binary, b binary").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document: ``component_id`` is the smallest ``doc_id`` that links
    reach, itself included, and ``kept`` tells whether that is the document's own.

    Documents link when their sets of five-word shingles have a Jaccard similarity of 0.85 or more. Without words (null
    and empty texts) a document has no shingles and no links. Sets are found over whole texts of any length and
    compared as 64-bit hashes of their shingles; sets that agree in no band are not compared, which for a similarity of
    0.85 happens once in 85,000 pairs and less often above. Repeated rows stay rows; null ids are smallest only
    where all of a class are null. Other columns are ignored; an empty table gives an empty result.
    """
    prints = write_scratch(signed(documents), "minmax")
    worded = prints.where("set is not null")
    sets = write_scratch(worded.groupBy("set").agg(
        F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.max("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands")), "minmax-sets")
    roots = components(links(documents, sets)).withColumnRenamed("node", "set")
    linked = write_scratch(sets.select("set", "doc_id").join(roots, "set"), "minmax-linked")
    # Written, as below, so that both sides of the joins come from plain shuffles and Spark can split a hot class.
    least = write_scratch(linked.groupBy("root").agg(F.min("doc_id").alias("component_id")), "minmax-least")
    known = linked.join(least, "root").select("set", "component_id", F.lit(True).alias("held"))
    each = write_scratch(sets.select("set", "doc_id").join(known, "set", "left").select(
        "set", F.when(F.col("held"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "minmax-classes")
    joined = worded.select("doc_id", "n_shingles", "set").join(each, "set").select("doc_id", "n_shingles", "component_id")
    alone = prints.where("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
