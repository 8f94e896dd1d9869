"""The pipeline and its stages on a small corpus with planted cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tieout.llm import tokens
from tieout.session import scratch_folder


def made_up(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """A folder of tables, the rows, and what each stage has to do with them."""
    rng = random.Random(11)
    clean = [made_up(rng, rng.randrange(60, 160)) for _ in range(400)]
    clean[8] = made_up(rng, 3000)  # one word more leaves its fingerprint
    item, shared = made_up(rng, 30), made_up(rng, 70)
    rows, toxic = list(enumerate(clean)), set()
    for i in range(400, 520):
        line = made_up(rng, 80).split()
        for _ in range(4):
            line.insert(rng.randrange(len(line)), rng.choice(["scum", "vile"]))
        rows.append((i, " ".join(line)))
        toxic.add(i)
    copies = {600: clean[7], 601: clean[7], 602: clean[8] + " end"}
    contaminated = {610: made_up(rng, 40) + " " + item.upper() + ", " + made_up(rng, 40)}
    parts = [made_up(rng, 50) for _ in range(6)]
    passages = {620 + n: f"{parts[2 * n]} {shared}\n{parts[2 * n + 1]}" for n in range(3)}
    rows += [*copies.items(), *contaminated.items(), *passages.items(), (630, "short"), (631, "")]
    folder = scratch_folder(spark, "corpus")
    documents = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(520)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows), toxic, parts


def test_the_pipeline_does_what_its_stages_decide(spark, corpus):
    folder, texts, toxic, parts = corpus
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, documents, folder).collect()}
    assert len((set(texts) - kept) ^ toxic) <= 4
    want = {i: t for i, t in texts.items() if i in kept - {600, 601, 602, 610}}
    for n in (1, 2):  # the first holder of the passage keeps it
        want[620 + n] = f"{parts[2 * n]} {parts[2 * n + 1]}"
    tokenizer = tokens.PieceIds(tokens.tokenizer_path(corpus_pipeline.TOKENIZER)).tokenizer
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    plain = set()
    for i, text in want.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        plain.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in got.collect()} == plain


def test_stages_keep_columns_and_bear_odd_rows(spark, corpus, odd_documents, no_documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "passages", "decontamination", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_documents, no_documents):
            out = stage(spark, docs, corpus[0])
            rows = out.count()
            assert name == "bpe" or out.columns == docs.columns
            assert rows == (0 if docs is no_documents else 7 if name == "simhash" else docs.count()), name
    cut = corpus_pipeline.cut_repeated_passages(spark, odd_documents, corpus[0]).where(F.col("doc_id") == 6).first()
    assert cut["n_chars"] == len(cut["text"])
