"""Record files against the tokenizers library, a plain checksum and a plain reader."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import queries as Q
from spindrift.llm import record_files as R

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(Q.WORD_TOKENIZER)
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, Q.END_ID]


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=8))
def test_checksums_equal_a_plain_one(parts):
    lengths = np.array([len(p) for p in parts])
    found = R.crc32c(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert found.tolist() == [plain_crc32c(p) for p in parts]


def test_known_checksums():
    known = [(b"123456789", 0xE3069283), (bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E)]
    for data, crc in known:
        assert R.crc32c(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)])).tolist() == [crc]


@given(st.lists(st.integers(0, 2**63 - 1)))
def test_packed_numbers_come_back(values):
    assert R.unpacked_varints(np.frombuffer(b"".join(map(R.varint, values)), np.uint8)).tolist() == values


OWN = {plain: R.Encoder(PATH, plain) for plain in (True, False)}


def own_ids(encoder, text):
    return R.unpacked_varints(np.frombuffer(encoder.encode(text), np.uint8)).tolist()


WORDS = st.lists(st.text(st.one_of(st.sampled_from("'sStTrRevEmMlLdD.,:;!?\"<|>()0159ÀÖ×Øß÷ÿĀĳŉŸſƀƉǅǰȳ«»µªº"), st.characters(codec="utf-8", max_codepoint=0x2B0)), max_size=12), max_size=8).map(" ".join)
WILD = st.text(st.one_of(st.sampled_from(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0   　́̈ΣσςİIß'sn"), st.characters(codec="utf-8")), max_size=60)


@settings(deadline=None, max_examples=600)
@given(st.lists(st.one_of(WILD, WORDS), max_size=5))
def test_encoding_word_by_word_equals_the_library(texts):
    for plain in (True, False):
        LIBRARY.encode_special_tokens = plain
        try:
            assert [own_ids(OWN[plain], t) for t in texts] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        finally:
            LIBRARY.encode_special_tokens = True


def test_long_texts_and_a_full_cache(monkeypatch):
    monkeypatch.setattr(R, "STRETCH", 50)
    monkeypatch.setattr(R, "CACHED_WORDS", 20)
    own = R.Encoder(PATH, True)
    for text in ("word " * 100 + "'s end", "x" * 200 + "\n" + "It's a TEST <|endoftext|> 42 " * 20, "y" * 300):
        assert own_ids(own, text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(own.words_known) <= 20
    assert own.by_pieces and not R.Encoder(PATH, False).by_pieces


def plain_records(data):
    at = 0
    while at < len(data):
        (size,), (head,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
        body = data[at + 12 : at + 12 + size]
        (tail,) = struct.unpack_from("<I", data, at + 12 + size)
        for crc, bytes_ in ((head, data[at : at + 8]), (tail, body)):
            own = plain_crc32c(bytes_)
            assert crc == (((own >> 15) | (own << 17)) + 0xA282EAD8) % 2**32
        yield at, body
        at += 16 + size


ODD = [(None, "null id"), (None, "null id"), (None, "another"), (3, None), (1, ""), (-5, "minus"), (7, "same words"), (7, "same words"), (7, "other words"), (2, " \n\t "), (9, "long " * 30_000), (8, "<|endoftext|> <|startoftext|>")]


def odd(spark):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in ODD], "doc_id long, text string, shard string, start int").repartition(3)


def test_files_hold_documents_in_order(spark, tmp_path):
    files = R.write_records(odd(spark), PATH, Q.END_ID, folder=str(tmp_path / "out")).orderBy("shard").collect()
    seen, start = [], 0
    for f in files:
        data, places = (tmp_path / "out" / f"{f.file}.tfrecord").read_bytes(), np.frombuffer((tmp_path / "out" / f"{f.file}.idx").read_bytes(), "<i8").reshape(-1, 2)
        own = list(plain_records(data))
        assert f.start == start and f.records == len(own) and f.bytes == len(data)
        assert [tuple(p) for p in places.tolist()] == [(at, len(body) + 16) for at, body in own]
        for _, body in own:
            found = R.features(body, 0, len(body))
            ids = R.unpacked_varints(np.frombuffer(body[slice(*found[b"input_ids"])], np.uint8)).tolist()
            doc = R.unpacked_varints(np.frombuffer(body[slice(*found[b"doc_id"])], np.uint8)).tolist()[0] if b"doc_id" in found else None
            seen.append((doc, ids))
            start += len(ids)
    order = [d for d, _ in seen]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert sorted(map(repr, seen)) == sorted(repr((d, ids_of(t))) for d, t in ODD)


def test_reading_equals_the_library_and_repeated_rows_agree(spark):
    files = R.write_records(odd(spark), PATH, Q.END_ID)
    rows = R.read_records(files).collect()
    assert sorted((repr((r.doc_id, r.token_ids)) for r in rows)) == sorted(repr((d, ids_of(t))) for d, t in ODD)
    at = 0
    for r in sorted(rows, key=lambda r: (r.shard, r.record)):
        assert r.start == at
        at += len(r.token_ids)
    mixed = R.shuffled(files, 5).collect()
    assert sorted((r.shard, r.record, r.token_ids) for r in mixed) == sorted((r.shard, r.record, r.token_ids) for r in rows)
    again, other = R.shuffled(files, 5).collect(), R.shuffled(files, 6).collect()
    assert [(r.shard, r.record) for r in again] == [(r.shard, r.record) for r in mixed] != [(r.shard, r.record) for r in other]
    assert R.read_records(R.write_records(odd(spark).where("false"), PATH, Q.END_ID)).count() == 0


def test_many_equal_rows_are_dealt_over_files(spark):
    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same boilerplate").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = R.write_records(docs, PATH, Q.END_ID).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) == 4 and max(f.records for f in files) < 20_000 and sum(f.records for f in files) == 40_000


@pytest.mark.parametrize("at", [3, 9, 14, -2])
def test_a_changed_byte_is_found(at):
    data, _ = R.framed([R.example(1, b"\x05\x06"), R.example(None, b"")])
    broken = bytearray(data)
    broken[at] ^= 4

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    assert [len(f) for _, f in R.batches_of(Stream(data))] == [2]
    with pytest.raises(ValueError):
        list(R.batches_of(Stream(bytes(broken))))
    with pytest.raises(ValueError):
        list(R.batches_of(Stream(data[:-1])))


def test_query_equals_brute_force(spark):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op11_record_files(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start = 0
    for r in docs:
        ids = ids_of(r.text)
        assert got[r.doc_id] == (start, len(ids), crc_of(ids))
        start += len(ids)
    assert len(got) == len(docs)
