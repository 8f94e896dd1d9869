"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two fingerprints at most four bits apart have a value in common that is at most two bits from either: every
fingerprint emits all values within half the radius, and equal values meet. Most of the 2,081 values of a
fingerprint meet nothing, so they are emitted in two steps. Four differing bits leave at most two in one
half of the 64 bits, one from each side of the middle value: a fingerprint emits the 33 values within one
bit of each half, and those are shuffled. Only where a half value meets another fingerprint is the other half
varied, by the bits that the radius leaves, and full values that are equal link. No group is compared pair by
pair beyond a fixed small size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import free_name, slices, whole_text, write_scratch
from tieout.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Groups up to this size are compared directly, each pair by its differing bits.
SMALL = 64
#: Half values met by more fingerprints than this are varied by a shuffle of their own.
MOST = 20_000
#: Fingerprints of which one task emits the half values.
DEALT = 10_000
_SORTED = 4_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HALF = np.uint64(0xFFFFFFFF)


def _masks(bits: int) -> np.ndarray:
    """All 32-bit numbers of at most ``bits`` set bits."""
    return np.array([sum(1 << p for p in chosen) for n in range(bits + 1)
                     for chosen in itertools.combinations(range(32), n)], np.uint64)


_NEAR = [_masks(n) for n in range(RADIUS // 2 + 1)]


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of word shingles; zero without words."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(line[a:b], seed) for a, b in zip(starts, stops, strict=False)), ">u8", len(stops))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at: at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, mark, fp`` per document: ``mark`` hashes the text, ``fp`` is the fingerprint as a signed 64-bit
    number. Null and empty texts give zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x, shingle, seed) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(found.view(np.int64))], ["doc_id", "mark", "fp"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text("text").alias("text"))
    return rows.withColumn("mark", F.xxhash64("text")).mapInArrow(run, "doc_id long, mark long, fp long")


def half_values(prints: DataFrame) -> DataFrame:
    """``side, value, fp, bits``: the values within one bit of each half, ``bits`` away from it."""
    near = F.array(*(F.struct(F.lit(side).cast("byte").alias("side"), F.lit(int(mask)).cast("long").alias("mask"),
                              F.lit(int(mask).bit_count()).cast("byte").alias("bits")) for side in (0, 1) for mask in _NEAR[1]))
    low = F.lit(0xFFFFFFFF).cast("long")
    half = F.when(F.col("side") == 0, F.col("fp").bitwiseAND(low)).otherwise(F.shiftrightunsigned("fp", 32))
    return prints.select("fp", F.inline(near)).select("side", half.bitwiseXOR(F.col("mask")).alias("value"), "fp", "bits")


def _varied(fps: np.ndarray, bits: np.ndarray, side: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The other half's values within what the radius leaves, with the places of their fingerprints."""
    other = (fps >> np.uint64(32 if side == 0 else 0)) & _HALF
    for used in (0, 1):
        at = np.flatnonzero(bits == used)
        masks = _NEAR[RADIUS // 2 - used]
        yield (other[at][:, None] ^ masks[None, :]).ravel(), np.repeat(at, len(masks))


def _group_links(fps: np.ndarray, bits: np.ndarray, side: int) -> np.ndarray:
    """Links (n, 2) among the fingerprints that met at a half value, enough to connect what is near."""
    if len(fps) <= SMALL:
        a, b = np.triu_indices(len(fps), 1)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= RADIUS
        return np.stack((fps[a[near]], fps[b[near]]), 1)
    found = []
    parts = len(fps) * len(_NEAR[-1]) // _SORTED + 1
    for part in range(parts):
        pairs = []
        for values, at in _varied(fps, bits, side):
            mine = values * np.uint64(2654435761) % np.uint64(parts) == part
            pairs.append((values[mine] << np.uint64(32)) | at[mine].astype(np.uint64))
        keys = np.sort(np.concatenate(pairs))
        same = np.flatnonzero(keys[1:] >> np.uint64(32) == keys[:-1] >> np.uint64(32))
        links = np.stack((keys[same] & _HALF, keys[same + 1] & _HALF), 1)
        found.append(np.unique(links, axis=0))
    links = np.unique(np.concatenate(found), axis=0).astype(np.int64)
    return np.stack((fps[links[:, 0]], fps[links[:, 1]]), 1)


def _forest(links: np.ndarray) -> np.ndarray:
    """Of links, those that connect something new."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for a, b in links.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Links ``a, b`` between fingerprints at most four bits apart, enough to connect all of those.

    ``prints`` has distinct ``fp``. A half value counts where two fingerprints have it as it is, or where
    fingerprints of different halves meet; those with the same half meet at that half itself.
    """
    values = half_values(prints)
    own = F.when(F.col("side") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(
        F.shiftrightunsigned("fp", 32))
    met = values.groupBy("side", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("bits") == 0, 1).otherwise(0)).alias("n_own"),
        F.min(own).alias("low"), F.max(own).alias("high"),
    ).where("n > 1 and (low <> high or n_own > 1)").select("side", "value", "n")
    # Spark takes what comes of rows for as small as they are; the hint keeps it from being broadcast.
    members = write_scratch(values.hint("merge").join(met, ["side", "value"]), "simhash-met")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            flat, sides = batch.column("members").flatten(), batch.column("side").to_numpy(zero_copy_only=False)
            fps = flat.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            bits = flat.field("bits").to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(batch.column("members")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            pairs = ends[sizes == 2]
            pairs = np.stack((fps[pairs - 2], fps[pairs - 1]), 1)
            found = [pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]]
            for i in np.flatnonzero(sizes > 2):
                part = slice(ends[i] - sizes[i], ends[i])
                found.append(_group_links(fps[part], bits[part], sides[i]))
            both = _forest(np.unique(np.concatenate(found).view(np.int64), axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    groups = members.where(F.col("n") <= most).groupBy("side", "value").agg(
        F.collect_list(F.struct("fp", "bits")).alias("members"))
    return groups.mapInArrow(link, "a long, b long").unionByName(_hot_links(members.where(F.col("n") > most)))


def _hot_links(members: DataFrame) -> DataFrame:
    """Links among very many fingerprints that met at a half value: all full values are shuffled."""
    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("side", "value", "fp", "bits")}
            for side in (0, 1):
                at = np.flatnonzero(columns["side"] == side)
                fps, halves = columns["fp"][at], columns["value"][at]
                for values, places in _varied(fps.view(np.uint64), columns["bits"][at], side):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(values), side, np.int8)), pa.array(halves[places]),
                        pa.array(values.view(np.int64)), pa.array(fps[places])], ["side", "value", "other", "fp"])

    full = members.mapInArrow(vary, "side byte, value long, other long, fp long")
    key = ["side", "value", "other"]
    least = full.groupBy(*key).agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").drop("most")
    return full.hint("merge").join(least, key).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(documents: DataFrame, most: int = MOST) -> DataFrame:
    """``doc_id, mark, fp, root, component_id`` per document; ``component_id`` is the smallest ``doc_id`` that
    links reach, ``root`` the smallest fingerprint, ``mark`` a hash of the text.

    Documents with equal fingerprints, those without words among them, link like any other. Repeated rows
    stay rows; a null ``doc_id`` is a component's smallest only if all of it is null. Other columns are
    ignored; an empty table gives an empty result.
    """
    prints = write_scratch(fingerprints(documents), "simhash")
    distinct = write_scratch(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    # Spark puts small partitions together before it writes them; each row is to become 66.
    dealt = distinct.repartition(max(1, -(-distinct.count() // DEALT)))
    roots = components(links(dealt, most)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    known = linked.join(least, "root").select("fp", "root", "component_id")
    each = distinct.join(known, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    # Written, so that both sides of the join come from plain shuffles and Spark can split a hot fingerprint.
    return prints.join(write_scratch(each, "simhash-classes"), "fp").select("doc_id", "mark", "fp", "root", "component_id")


def one_of_each(documents: DataFrame, most: int = MOST) -> DataFrame:
    """One document of each component, with all its columns: that with the smallest ``doc_id``, then the
    smallest hash of its text. Rows that repeat it go as well; null ids give way to others."""
    key, mark, place = (free_name(documents, n) for n in ("row_key", "row_mark", "row_place"))
    kept = near_duplicates(documents, most).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("r")).select("r.doc_id", "r.mark")
    kept = kept.select(F.xxhash64("doc_id", "mark").alias(key), F.col("mark").alias(mark))
    rows = documents.withColumn(mark, F.xxhash64(whole_text("text"))).withColumn(
        key, F.xxhash64(F.col("doc_id").cast("long"), mark))
    found = rows.join(kept, [key, mark], "left_semi")
    return found.withColumn(place, F.row_number().over(Window.partitionBy(key, mark).orderBy("doc_id"))).where(
        F.col(place) == 1).select(*documents.columns)
