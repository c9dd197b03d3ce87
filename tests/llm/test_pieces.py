import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from lexisift.llm.piece_codec import encode_pieces, piece_codec
from lexisift.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "\n", "\x00", "▁", "▁▁ a▁b", "日本語 😀", "</s> <unk> <0x0A>", "�", "e\u0301é", "x" + " " * 16, "ab" * 20000, " " * 5000]
ODD += [" " * n + c + " " * m for c in "a😀é" for n in (0, 1, 14, 15, 16, 17, 31, 32, 33, 49) for m in (0, 1, 15, 16, 17)]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library():
    draw = random.Random(3)
    parts = ["a", "b", "ab", "the", "in", "ing", " ", "   ", "\n", "\t", "é", "ß", "😀", "▁", "#", "$$", "0", "\u200b", "한"]
    texts = ODD + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 80))) for _ in range(800)]
    codec, lib = piece_codec(PATH), library()
    got, want = codec.encode(texts, end=True), lib.encode(texts, add_eos=True)
    for text, g, w in zip(texts, got, want, strict=True):
        assert g.tolist() == w and codec.decode(g) == lib.decode(w), text[:80]


def test_bytes_that_are_no_text():
    codec, lib = piece_codec(PATH), library()
    draw = random.Random(5)
    for _ in range(200):
        ids = [draw.choice([draw.randint(3, 258), draw.randint(259, 400)]) for _ in range(12)]
        import numpy as np

        assert codec.decode(np.array(ids)).count("\ufffd") == lib.decode(ids).count("\ufffd")


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op4_sentencepiece"](spark, "/root/testdata/sf0.001").collect()}
    lib = library()
    for r in docs:
        ids = lib.encode(r.text, add_eos=True)
        own = got[r.doc_id]
        assert own.n_tokens == len(ids) and own.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (1, "")], "doc_id long, text string").selectExpr("doc_id", "text", "'x' as ids")
    rows = encode_pieces(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows)[1:] == [(1, [2], ""), (1, [2], "")]
    assert encode_pieces(docs.limit(0), PATH).collect() == []


def test_a_very_long_text(spark):
    """One word of a million characters, and a million words, as the library has them."""
    texts = ["ab1é" * 250_000, "some words again " * 300_000]
    rows = encode_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).orderBy("doc_id").collect()
    lib = library()
    for row, text in zip(rows, texts, strict=True):
        ids = lib.encode(text, add_eos=True)
        assert row.ids == ids and row.decoded == lib.decode(ids)
