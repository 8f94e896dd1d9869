"""A corpus cleaned and encoded by five of the operators, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import chunks, decontamination, passages, simhash, toxicity
from tieout.llm.common import free_name, whole_text, write_scratch

#: Encoding and components have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, learned from the labelled ones among them that are not held out.

    Where no label teaches anything every document stays. Null and empty texts are scored like others; repeated rows
    share a fate; texts of any length are read whole; an empty table stays empty, and other columns pass through.
    """
    told = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    weights = toxicity.fit(docs, _table(spark, sf_dir, "labels"), teaches=told)
    if not weights.any():
        return docs
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, weights, out=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by ``op4``'s rule; near copies of a Jaccard similarity of 0.8 to
    0.95 mostly stay (see the README)."""
    return simhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with an earlier one.

    All rows and columns stay; null, empty and short texts are left as they are, rows repeated as a whole are one
    document and lose the same passages.
    """
    found = write_scratch(passages.shared_passages(docs), "shared-passages")
    return passages.without_repeats(docs, found)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark passage.

    Null and empty texts have no words and stay; rows that share an id are judged by their own text, repeated rows share
    a fate. Without benchmark items all stay.
    """
    doc, mark = free_name(docs, "item_doc"), free_name(docs, "item_mark")
    found = decontamination.find(docs, _table(spark, sf_dir, "benchmark")).where("contaminated").select(
        F.col("doc_id").alias(doc), F.col("mark").alias(mark)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (
        F.xxhash64(whole_text("text")) == F.col(mark)), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and a digest of the text decoded from them: a row for each document, null texts as empty
    ones; other columns are dropped."""
    coded = chunks.encode(docs.select("doc_id", "text"), TOKENIZER).select("doc_id", "ids")
    return chunks.decode(coded, TOKENIZER).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(chunks.joined_ids("ids"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next; an empty table gives an empty one."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
