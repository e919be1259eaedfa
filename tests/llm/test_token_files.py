import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import token_files as tf

P = pytest.importorskip("public_tokenizers")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_library_on_any_text():
    r = random.Random(3)
    pieces = ["the", "Été", " ", "  ", "\n", " \n", "\t", ".", ",", "don't", "x1", "12", "ß", "日本", "—", " ", "a,", "b.", "<|endoftext|>", " ", "é", "\r\n", "'s", "ſ"]
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", " ", ""]) for _ in range(r.randint(0, 30))) for _ in range(400)] + ["", " ", "  a", "a ", "a  ", "\n"]
    enc = tf.Encoder(P.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert [list(np.frombuffer(x, np.dtype(enc.code))) for x in enc.encode(texts)] == whole(texts)


def test_encoder_equals_the_library_on_lines_of_words():
    r = random.Random(4)
    words = ["the", "The", "Été", "by", "He.", "don't", "word,", "naïve", "x1", "(a)", "12", "日本", "end.", "A" * 50]
    texts = ["".join(r.choice(words) + r.choice([" ", " ", "\n", "\n\n", "\r\n", "\t"]) for _ in range(40)) + "end" for _ in range(300)]
    enc = tf.Encoder(P.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert [list(np.frombuffer(x, np.dtype(enc.code))) for x in enc.encode(texts)] == whole(texts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_the_query_equals_the_library_on_a_whole_table(spark):
    from plumbline.llm.queries import QUERIES

    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_files"](spark, SF).collect()}
    start = 0
    for (doc_id, _), ids in zip(docs, whole([d.text or "" for d in docs]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        assert got[doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_other_kinds_of_files_take_the_librarys_way():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    enc, t = tf.Encoder(path), Tokenizer.from_file(path)
    assert not enc.in_parts and tf.Encoder(P.path("byte_bpe_50k.json")).in_parts
    for text in ("The CAT sat", "", "a  b\nc", "Zoë"):
        assert list(np.frombuffer(enc.encode([text])[0], np.dtype(enc.code))) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_any_range_is_read_without_the_rest(n):
    r = np.random.default_rng(n)
    ids = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    file = tf.TokenFile(pa.BufferReader(tf.dump([7, None], [n // 2, n - n // 2], ids)))
    assert file.doc_ids == [7, None]
    assert list(file.starts) == [0, n // 2, n]
    for _ in range(50):
        a, b = sorted(r.integers(0, n + 1, 2))
        assert (file.tokens(int(a), int(b)) == ids[a:b]).all()


def test_round_trip_and_order(spark):
    texts = ["the cat", None, "", "x  y", "the cat", "Zoë said: don't"]
    docs = spark.createDataFrame([(10 - i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = [tuple(r) for r in tf.token_files(docs, P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()]
    start, expected = 0, []
    for i, ids in sorted(zip(range(10, 0, -1), whole([t or "" for t in texts]), strict=False)):
        ids = [*ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


def test_very_long_texts_and_null_ids(spark):
    texts = ["the cat sat " * 60_000, "x" * 300_000, "a"]
    docs = spark.createDataFrame([(3, texts[0], 1), (None, texts[1], 1), (3, texts[2], 1)], "doc_id long, text string, start int")
    got = sorted(((r.doc_id is not None, r.n_tokens, r.ids_crc32) for r in tf.token_files(docs, P.path("byte_bpe_50k.json")).collect()))
    assert got == sorted(((i != 1), len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, ids in enumerate(whole(texts)))


def test_no_rows(spark):
    assert tf.token_files(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect() == []


def test_files_close_when_full(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c") for i in range(20)], "doc_id long, text string").coalesce(1)
    root = f"file://{tmp_path}/t"
    manifest = tf.write_files(docs, root, P.path("byte_bpe_50k.json"), file_tokens=10)
    assert manifest.count() >= 6
    rows = tf.read_files(manifest, root).orderBy("doc_id").collect()
    assert [r.start for r in rows] == [4 * i for i in range(20)]
