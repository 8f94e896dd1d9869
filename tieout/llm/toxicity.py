"""Toxicity of whole texts: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the set of its words, pairs of neighbouring words, and pairs with one word between,
hashed into ``2 ** BITS`` coordinates. Every coordinate has its own learning rate, and the L1 penalty leaves
most weights at zero, so the weights that are broadcast are few; there are never more than the coordinates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.common import slices, whole_text

BITS = 20
#: Coordinates whose states are averaged together.
_PIECE = 1 << 14
_WORD = re.compile(r"[^\W\d_]+")
_MASK = np.uint64((1 << BITS) - 1)


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled documents learned from, chosen by a hash of their id. Every task
    learns from about ``shard_rows`` of them, and the tasks' states are averaged coordinate by coordinate."""

    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.01
    epochs: int = 3
    shard_rows: int = 8_000
    most_rows: int = 40_000


class _WordHashes(dict):
    """64-bit hashes of lower-cased words, at most ``limit`` of them held."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _WordHashes()


def coordinates(text: str) -> np.ndarray:
    """Coordinates of all n-grams and skip-grams of a text, repeats included; none if it has no word."""
    words = _WORD.findall(text.lower())
    one = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    left = one * np.uint64(0x9E3779B97F4A7C15)
    pair = (left[:-1] ^ (one[1:] >> np.uint64(3))) * np.uint64(0xC2B2AE3D27D4EB4F)
    skip = (left[:-2] ^ (one[2:] >> np.uint64(7))) * np.uint64(0x165667B19E3779F9)
    every = np.concatenate((one, pair >> np.uint64(20), skip >> np.uint64(20))) & _MASK
    return every.astype(np.int32)


def features(text: str) -> np.ndarray:
    """The distinct coordinates of a text, in order."""
    return np.unique(coordinates(text))


def text_score(text: str, dense: np.ndarray) -> float:
    """Sum of a text's weights; the last of ``dense`` is the intercept."""
    at = coordinates(text)
    return float(dense[np.unique(at[dense[at] != 0])].sum(dtype=np.float64)) + float(dense[-1])


def _weights(s: Settings, z: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights of the coordinates ``at`` with the states ``z`` and ``n``."""
    l1 = np.where(at == 1 << BITS, 0.0, s.l1)
    shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
    return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)


class Ftrl:
    """State ``z`` and ``n`` per coordinate; the last coordinate is the intercept, without L1."""

    def __init__(self, settings: Settings, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.settings = settings
        self.z = np.zeros((1 << BITS) + 1) if z is None else z
        self.n = np.zeros((1 << BITS) + 1) if n is None else n

    def weights(self, at: np.ndarray) -> np.ndarray:
        return _weights(self.settings, self.z[at], self.n[at], at)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.settings.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def training_labels(labels: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """``doc_id, label`` to learn from, and how many: at most ``most_rows``, those with the smallest hashes of their id.

    The limit is found from counts by the first 16 bits of the hash; only if the first of these buckets holds more rows
    than wanted is it cut by the next 16 bits, and so on. Rows with a null id, a null label or a label other than 0 and 1
    teach nothing. A document labelled twice teaches by its largest label.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("label"))
    within, total = F.lit(True), 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned(F.xxhash64("doc_id"), shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
        last = -1
        counts = known.where(within).groupBy(digit.alias("at")).count().toArrow()  # 65,536 rows at most
        buckets, sizes = (counts.column(c).to_numpy() for c in ("at", "count"))
        order = np.argsort(buckets)
        sums = np.cumsum(sizes[order])
        taken = int(np.searchsorted(sums, settings.most_rows, "right"))
        if taken:
            total, last = int(sums[taken - 1]), int(buckets[order[taken - 1]])
        if taken or not len(buckets):
            break
        within = within & (digit == int(buckets.min()))
    return known.where(within & (digit <= last)), total


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), teaches=None) -> np.ndarray:
    """Weights over all coordinates and the intercept, learned from labelled documents; ``teaches`` (a
    condition on ``doc_id``) may hold some back.

    Repeated documents teach once for each different text. Rows go to shards by a hash of their id and are
    taken in an order of their own, so the weights do not depend on how Spark deals them. The shards' states are
    averaged in tasks, a piece of the coordinates in each; what comes to the driver are the weights other than zero,
    however many shards there are. Without labelled documents all weights are zero.
    """
    known, total = training_labels(labels if teaches is None else labels.where(teaches), settings)
    shards = max(1, -(-total // settings.shard_rows))
    texts = documents.where("doc_id is not null").select("doc_id", whole_text("text").alias("text"))
    rows = texts.join(known, "doc_id").select(
        F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"),
        F.xxhash64("doc_id", "text").alias("at"), "label", "text")
    coded = rows.mapInArrow(_featurise, "shard int, at long, label int, features array<int>")
    states = coded.repartition(4 * shards, "shard").groupBy("shard").applyInPandas(
        _learner(settings), "shard int, piece int, z binary, n binary")
    found = states.groupBy("piece").applyInPandas(_averager(settings), "at binary, weight binary").toArrow()
    weights = np.zeros((1 << BITS) + 1)
    for at, weight in zip(found.column("at"), found.column("weight"), strict=True):
        weights[np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(weight.as_buffer(), np.float64)
    return weights


def _learner(settings: Settings):
    """Learns from one shard, epoch by epoch, each in an order of its own."""
    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("at")
        model, at = Ftrl(settings), part["at"].to_numpy()
        labels, sets = part["label"].to_numpy(), part["features"].to_numpy()
        for epoch in range(settings.epochs):
            for i in np.lexsort((at, (at * (2 * epoch + 3)) & 0xFFFF)):
                model.learn(np.asarray(sets[i], np.int64), labels[i])
        z, n = model.z.astype(np.float32), model.n.astype(np.float32)
        starts = range(0, len(z), _PIECE)
        return pd.DataFrame({
            "shard": int(part["shard"].iloc[0]), "piece": np.arange(len(starts), dtype=np.int32),
            "z": [z[i: i + _PIECE].tobytes() for i in starts], "n": [n[i: i + _PIECE].tobytes() for i in starts]})

    return learn


def _averager(settings: Settings):
    """The weights other than zero of one piece of the coordinates, from the mean of its states in the shards that heard
    of them."""
    def average(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        z, n = (np.stack([np.frombuffer(x, np.float32) for x in part[c]]).astype(np.float64) for c in ("z", "n"))
        heard = np.maximum((n > 0).sum(axis=0), 1)
        at = int(part["piece"].iloc[0]) * _PIECE + np.arange(z.shape[1])
        weights = _weights(settings, z.sum(axis=0) / heard, n.sum(axis=0) / heard, at)
        used = np.flatnonzero(weights)
        return pd.DataFrame({"at": [at[used].astype(np.int32).tobytes()], "weight": [weights[used].tobytes()]})

    return average


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [features(x) for x in batch.column("text").to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int32)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("at"), batch.column("label"), lists], ["shard", "at", "label", "features"])


def score(documents: DataFrame, weights: np.ndarray, out: str = "score") -> DataFrame:
    """Add the column ``score``, 0 to 1, to whatever columns there are; null and empty texts get one too.

    Only weights other than zero are sent to the tasks, at most ``2 ** BITS + 1``.
    """
    used = np.flatnonzero(weights)
    sent = documents.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used].astype(np.float32)))
    kept = [field for field in documents.schema.fields if field.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[sent.value[0]] = sent.value[1]
        for batch in slices(batches):
            sums = [text_score(x or "", dense) for x in batch.column("text").to_pylist()]
            scores = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(scores, pa.float64())],
                                             [*(f.name for f in kept), out])
        _HASHES.clear()  # the worker may go on to other work

    return documents.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))
