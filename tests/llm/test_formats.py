"""Chat formatting, WARC archives, token id shards and byte-level BPE: exact round trips."""

import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieout.llm import chat, chunks, grammar, storage, tokens, warc
from tieout.session import scratch_folder

PIECES = ["a", "b", "the ", "  ", "\n", "\t", " ", "é", "'s", "'LL", " ", "<|endoftext|>", "1", "23", "!", "it, ", "Dog. ",
          "…", "　", "\x1c", "漢字", "🙂", "́", "\r\n", "x" * 30, "Σ", "İ", "Éa", "ª", "word"]


def random_texts(n, most=300):
    rng = random.Random(7)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(most))) for _ in range(n)] + [
        "", "a" * 5000, " " * 999, "漢" * 2000, "ab " * 3000]


def test_chats_come_back_with_their_loss_mask(spark):
    rows = [(1, 0, "user", "hi <|im_end|>\n"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] <\\|im_next|>"),
            (1, 70, "assistant", ""), (1, 200, None, "x"), (2, None, "sys\ntem%0A", "t"), (2, None, "a", "tie"), (2, None, "a", "tie"),
            (None, 0, "assistant", "no id"), (3, 0, "assistant", "[INST"), (3, 1, "user", "<"), (3, 2, "assistant", "s>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chats(frame).select(
        "conv_id", "formatted", "blocks", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("learned")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [tuple(t) for t in got[conv]["turns"]] == [(role, text) for _, _, role, text in own]
        assert got[conv]["learned"] == "".join(text for _, _, role, text in own if role == "assistant")
        assert got[conv]["blocks"] == sum(i == 0 or own[i - 1][2] != t[2] for i, t in enumerate(own))
    assert chat.format_chats(frame.where("false")).count() == 0


def test_a_long_conversation_is_put_together_in_order(spark):
    frame = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") % 5 < 2, "user").otherwise("assistant").alias("role"),
                                     F.concat(F.lit("t"), "id").alias("text"))
    row = chat.format_chats(frame).select(chat.read_turns(F.col("formatted")).alias("t"), "blocks").first()
    assert [t["text"] for t in row["t"]] == [f"t{i}" for i in range(3000)] and row["blocks"] == 1200


def test_archives_give_back_pages_and_revisits(spark):
    big = "é" * 600
    rows = [(1, "u", big), (5, None, big), (9, "http://x/%41 b\n", big), (9, "again", big), (2, "s", "small"), (3, "s", "small"),
            (4, "n", None), (None, "none", big), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    folder = scratch_folder(spark, "warc-test")
    whole = warc.write_archives(pages, f"{folder}/whole", archive_bytes=2000)
    members = warc.normalise(whole, f"{folder}/members")
    got = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"])
                  for r in warc.read_records(members).collect()), key=repr)
    want = []
    for page, url, html in rows:
        payload = (html or "").encode()
        revisit = html == big and page != 9
        want.append((page, url, "revisit" if revisit else "response", 9 if revisit else None, len(payload),
                     hashlib.sha1(payload).hexdigest(), None if revisit else bytearray(payload)))
    assert got == sorted(want, key=repr)
    assert sum(r["records"] for r in members.collect()) == len(rows)
    one = members.first()
    with storage.open_random(one["archive"]) as source:  # each member opens alone, and all of them in a row
        assert gzip.decompress(source.read()).count(b"WARC/1.1\r\n") == one["records"]
    none = pages.where("false")
    assert warc.read_records(warc.normalise(warc.write_archives(none, f"{folder}/n"), f"{folder}/m")).count() == 0


def test_damaged_archives_are_refused():
    record = warc._record(1, "u", "text", None)
    packed = gzip.compress(record + record)
    assert list(warc.split_records(warc.inflate(io.BytesIO(packed)))) == [record, record]
    assert list(warc.split_records(warc.inflate(io.BytesIO(gzip.compress(record) * 3)))) == [record] * 3
    for bad in (packed[:-9], gzip.compress(record[:-5]), gzip.compress(b"HTTP/1.1 200\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.split_records(warc.inflate(io.BytesIO(bad))))
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"text", b"tent"))


def test_shards_decode_by_range():
    rng = random.Random(3)
    ids = [np.array([rng.choice((5, 6, 7, 49407)) for _ in range(rng.randrange(60))], np.uint32) for _ in range(200)]
    for base in (49408, 70_000):
        shard = grammar.Shard(grammar.pack(list(range(200)), ids, base))
        every = np.concatenate(ids)
        assert len(shard.rules) > 3 and len(shard.symbols) < len(every) and shard.counts.tolist() == [len(x) for x in ids]
        for _ in range(200):
            a = rng.randrange(len(every))
            b = rng.randrange(a, len(every) + 1)
            assert shard.ids(a, b).tolist() == every[a:b].tolist()
    for odd in ([], [[]], [[5]], [[5, 5]], [[5] * 1001], [[1, 2] * 500, []]):
        shard = grammar.Shard(grammar.pack([None] * len(odd), [np.array(x, np.uint32) for x in odd], 49408))
        assert shard.ids(0, int(shard.counts.sum())).tolist() == sum(odd, []) and shard.keys == [None] * len(odd)
    with pytest.raises(ValueError):
        grammar.Shard(b"nothing of that kind" * 9)


def test_word_pieces_are_encoded_as_the_whole_text_is():
    known = tokens.PieceIds(tokens.tokenizer_path("word_bpe_49k.json"), limit=50)
    for text in random_texts(300):
        got = np.frombuffer(b"".join(map(known.__getitem__, grammar.word_pieces(text))), "<u4").tolist()
        assert got == known.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_ids_are_written_in_order(spark, odd_documents, no_documents):
    shards = grammar.write_ids(odd_documents, "word_bpe_49k.json", scratch_folder(spark, "ids"), 1, 49408, shard_ids=5000)
    got = sorted(grammar.read_ids(shards).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(got) == odd_documents.count()
    tokenizer = tokens.PieceIds(tokens.tokenizer_path("word_bpe_49k.json")).tokenizer
    texts = [(r["doc_id"], r["text"] or "") for r in odd_documents.collect()]
    want = sorted(((k, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, t in texts), key=repr)
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in got), key=repr) == want
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
    empty = grammar.write_ids(no_documents, "word_bpe_49k.json", scratch_folder(spark, "ids"), 1, 49408)
    assert grammar.read_ids(empty).count() == 0


def test_chunks_give_the_tokenizers_ids_and_text():
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    encoder, table = chunks.ChunkEncoder(tokens.PieceIds(path, limit=50), held_chars=2000), chunks.id_bytes(path)
    for text in random_texts(300):
        assert "".join(chunks.cut(text)) == text
        ids = encoder.known.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, text
        assert b"".join(table[i] for i in ids).decode() == encoder.known.tokenizer.decode(ids, skip_special_tokens=False)


def test_words_with_marks_are_put_together_from_their_parts():
    """op9 spent most of its time on words that differ by a mark behind them or a line's end before them only."""
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    known = tokens.PieceIds(path)
    heads, words = ["", " ", "\n", "\n ", "\n\n", "  ", " \n"], ["word", "Étrevion", "µª", "ciñado", "x", "ĀɏŁ", "ſtɐ", "дом", "a1", "×"]
    ends = ["", ",", ".", "###", "'", "'s", "'S", "!?", "\\", "-", "_", "`~", "@[", "{|}", "–", "¿", "9", "<|endoftext|>", "\t", " "]
    for piece in (head + word + end for head in heads for word in words for end in ends):
        numbers = known.tokenizer.encode(piece, add_special_tokens=False).ids
        assert np.frombuffer(known[piece], "<u4").tolist() == numbers, piece
    known = tokens.PieceIds(path)
    asked = [known[piece] for piece in (" ouioieroiment,", "\nouioieroiment", " ouioieroiment###")]
    assert {" ouioieroiment", "ouioieroiment", "\n", ",", "###"} <= set(known) and len(set(asked)) == 3


def test_shared_passages_are_encoded_once():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    encoder = chunks.ChunkEncoder(tokens.PieceIds(tokens.tokenizer_path("byte_bpe_50k.json")))
    encoder.encode("one way in " + passage)
    before = encoder.encoded
    encoder.encode("quite another beginning, " + passage + " and an end")
    assert encoder.encoded - before < 8 and encoder.reused > 10


def test_encoding_keeps_rows_and_columns(spark, odd_documents, no_documents):
    coded = chunks.encode(odd_documents, "byte_bpe_50k.json")
    assert sorted(coded.columns) == sorted(odd_documents.columns)
    back = chunks.decode(coded, "byte_bpe_50k.json")
    assert sorted(((r["doc_id"], r["text"] or "") for r in odd_documents.collect()), key=repr) == sorted(
        ((r["doc_id"], r["decoded"]) for r in back.collect()), key=repr)
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    assert chunks.decode(chunks.encode(no_documents, "byte_bpe_50k.json"), "byte_bpe_50k.json").count() == 0
    assert [r["decoded"] for r in chunks.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), "byte_bpe_50k.json").collect()] == ["", ""]


def test_crc_of_ids_is_that_of_their_bytes(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"\x01\x00\x00\x00"))).first()[0] == zlib.crc32(b"\x01\x00\x00\x00")


def test_no_pair_of_a_shard_is_left_that_occurs_often():
    rng = np.random.default_rng(3)
    copy = rng.integers(0, 49408, 1000)
    ids = np.concatenate([np.append(copy, rng.integers(0, 49408, 50)) for _ in range(100)])
    symbols = grammar.compress(ids, 49408)[1].astype(np.int64)
    assert np.unique((symbols[:-1] << 32) | symbols[1:], return_counts=True)[1].max() < grammar.LEAST_PAIRS
    shard = grammar.Shard(grammar.pack([1], [ids.astype(np.uint32)], 49408))
    assert (shard.ids(0, len(ids)) == ids).all() and len(shard.symbols) < len(ids) // 15
