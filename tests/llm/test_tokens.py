import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexisift.llm.byte_bpe import UNSTEADY, byte_level
from lexisift.llm.common import texts_of
from lexisift.llm.packing import cut_documents, pack, pack_documents, shortest_pack_first
from lexisift.llm.token_counts import count_tokens, pre_token_sizes

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "a", " ", "\n", "  a  b\n\n c", "don't  <|endoftext|> x<|endoftext|>", "tab\there \t\n  and nbsp \x1c !\x1c x", "x" * 5000,
    "日本語 テキスト\n\n\n end  ", "a\r\nb \r\n  c", "### $$$ ***\n" * 900, "word " * 3000, "  q", "  lead", "trail  ", "\x85a",
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, length string, share long")


def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(spark):
    got = {r.doc_id: r for r in count_tokens(frame(spark), PATH).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library().encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), t


def test_counts_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == len(library().encode(r.text, add_special_tokens=False).ids)


def test_counts_where_most_pre_tokens_are_joined(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH).collect()}
    for known in (0, 50):
        assert {r.doc_id: r.n_tokens for r in count_tokens(docs, PATH, known=known).collect()} == whole


def test_each_pre_token_is_counted_once(spark):
    rows = pre_token_sizes(texts_of(frame(spark, TEXTS + TEXTS)), PATH).collect()
    assert len({r.term for r in rows}) == len(rows) and all(r.c % 2 == 0 for r in rows)
    assert all(r.n == len(library().encode(r.term, add_special_tokens=False).ids) for r in rows)


def test_pre_tokens_of_all_steady_characters():
    coder = byte_level(PATH)
    for c in filter(lambda c: not UNSTEADY.match(chr(c)), range(0x1F650)):
        text = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}b"
        assert [p for part in coder.pre_tokens(text) for p in part] == [text[i:j] for _, (i, j) in coder.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_a_very_long_text(spark):
    text = "ab cde  fg\n" * 300_000 + "z" * 100_000
    got = count_tokens(frame(spark, [text]), PATH).first()
    assert (got.n_tokens, got.n_bytes) == (len(library().encode(text, add_special_tokens=False).ids), len(text))


def test_counts_of_other_vocabularies(spark):
    import sentencepiece

    other, model = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark), other).collect()}
    t = Tokenizer.from_file(other)
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(TEXTS)}
    s = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark), model).collect()}
    assert got == {i: len(s.encode(x or "")) for i, x in enumerate(TEXTS)}


def test_packing_round_trip(spark):
    rows = pack(cut_documents(frame(spark, TEXTS + TEXTS), PATH, 256, 1, with_ids=True), 256).collect()
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length <= 4 * 256
    for i, t in enumerate(TEXTS + TEXTS):
        own = sorted(docs[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
        assert ids == [*library().encode(t or "", add_special_tokens=False).ids, 1]
        assert all(r.doc_tokens == len(ids) for r in own) and [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) <= 256
    assert set(sequences) == set(range(len(sequences)))


def test_packing_wastes_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs, PATH).collect()
    used, n = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert used / (2048 * n) > 0.98


def test_packing_nothing_and_repeats(spark):
    assert pack_documents(frame(spark, []), PATH).collect() == []
    same = spark.createDataFrame([(1, "a b")] * 5 + [(None, None)], "doc_id long, text string")
    rows = pack_documents(same, PATH).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 3)] * 5 + [(True, 1)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 6


def test_patterns_by_hand():
    placed = shortest_pack_first({6: 2, 3: 3, 1: 1}, 10)
    assert placed == [(6, 0, 2, 0, 0), (3, 0, 2, 0, 6), (3, 2, 1, 2, 0), (1, 0, 1, 2, 3)]


def test_odd_rows_are_packed_each(spark):
    """A very long text, repeated rows, null ids and texts, and columns of names that packing uses itself."""
    long = "a long text of words " * 20_000
    rows = [(1, long, 7, 1), (1, long, 7, 1), (None, "x y", 0, 2), (None, None, 0, 3), (4, "", 0, 4)]
    given = spark.createDataFrame(rows, "doc_id long, text string, length int, share int")
    got = pack_documents(given, PATH).collect()
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start, r.length) for r in got)
    n = pieces[0][2]
    cut = [(s, min(2048, n - s)) for s in range(0, n, 2048)]
    assert pieces[: 2 * len(cut)] == sorted((False, 1, n, s, k) for s, k in cut * 2)
    assert [p[2:] for p in pieces[2 * len(cut) :]] == [(1, 0, 1), (1, 0, 1), (3, 0, 3)]
    for sequence in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == sequence)
        assert [o for o, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))] and sum(k for _, k in own) <= 2048
    assert pack_documents(given.limit(0), PATH).count() == 0
