import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urbanweave.llm import token_files as tf
from urbanweave.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize(
    "text",
    [None, "", " ", "  \n\n a  b\t\tc ", "it's we'll I'd 'S '", "naïve ÀÉß ² ¼ x²", "日本語 text", "a\x1cb\x85c\xa0 d", "<|endoftext|> x", "€uro – dash", "9 99a a9 _a -- ...", "\x00\x01", "x" * 5000, "\n \n  z", "a\n \nb c", "a \n b", "a\n b\n", "end ", "end\n ", "a\xa0 b \xa0c", " lead", "don't 's 'll x"],
)
def test_pieces_give_the_ids_of_the_library(reference, text):
    encoder = tf.Encoder(PATH, 2)
    for _ in range(2):
        assert [np.frombuffer(c, "<u4").tolist() for c in encoder.encode_all([text, "more", text])] == [reference(t) for t in (text, "more", text)]


def test_cache_is_bounded(reference):
    encoder = tf.Encoder(PATH, 2, most_parts=3)
    for text in ("one two three four five", "six seven eight", "one two"):
        assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == reference(text)
    assert len(encoder.parts) + len(encoder.older) <= 2 * (3 + 5)


def test_perfect_hash_is_minimal_and_rejects_by_fingerprint():
    keys = np.arange(-500, 4500, dtype=np.int64) * 7
    nulls, nth = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    hashes = tf.key_hashes(keys, nulls, nth)
    assert sorted(tf.PerfectHash.build(hashes).slots(hashes).tolist()) == list(range(len(keys)))
    assert tf.PerfectHash.build(hashes[:0]).slots(hashes[:0]).tolist() == []


def expected(rows, reference):
    """Brute force: ids of all rows in order, by (doc_id, text), nulls first."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, start = [], 0
    for key, text in ordered:
        ids = np.array(reference(text), "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def read(manifest):
    held = tf.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc"))
    return sorted(map(tuple, held.collect()), key=lambda r: r[1])


def test_files_hold_every_row_in_key_order(spark, reference):
    rows = [(i * 37 % 101, f"text {i} it's\n" * (i % 9)) for i in range(101)]
    rows += [(7, "again"), (7, "again"), (7, None), (None, "no key"), (None, None), (5, "日本 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(5)
    manifest = tf.write_token_files(docs, PATH, 2)
    assert read(manifest) == expected(rows, reference)
    assert manifest.agg(F.sum("n_ids")).first()[0] == sum(r[2] for r in expected(rows, reference))


def test_keyed_access(spark, reference):
    rows = [(i, f"doc {i} " * (i % 5)) for i in range(0, 400, 2)] + [(10, "twice")]
    manifest = tf.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2)
    asked = spark.createDataFrame([(0,), (10,), (11,), (398,), (-5,), (9999,), (None,), (10,)], "doc_id long")
    found = sorted((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in tf.look_up(manifest, asked).collect())
    wanted = [(k, s, n) for k, s, n, _ in expected(rows, reference) if k in (0, 10, 398)]
    assert [(k, s, len(ids)) for k, s, ids in found] == wanted
    assert found[0][2] == reference("") and reference("twice") in [f[2] for f in found]


def test_empty_table(spark):
    manifest = tf.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, 2)
    assert manifest.count() == 0 and tf.read_token_files(manifest).count() == 0


def test_wide_ids_take_four_bytes():
    index = tf._index_bytes(np.array([3, 4]), np.array([False, False]), np.array([2, 5]), 4)
    assert index[:2] == b"PK"


def test_query_over_the_whole_table(spark, reference):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = sorted(map(tuple, QUERIES["op10_token_files"](spark, sf).collect()), key=lambda r: r[1])
    assert found == expected(rows, reference)


def test_added_tokens_get_the_ids_of_a_plain_call(spark):
    plain = Tokenizer.from_file(PATH)
    ids = lambda text: [*plain.encode(text or "", add_special_tokens=False).ids, 2]
    texts = ["a <|endoftext|> x", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext|><|endoftext|> 's", "<|endoftext |>", "  <|endoftext|>\n", "plain words it's"]
    assert any(50256 in ids(text) for text in texts)
    encoder = tf.Encoder(PATH, 2, added_as_text=False)
    for _ in range(2):
        assert [np.frombuffer(c, "<u4").tolist() for c in encoder.encode_all(texts)] == [ids(t) for t in texts]
    rows = [(i, text) for i, text in enumerate(texts)]
    assert read(tf.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2)) == expected(rows, ids)
