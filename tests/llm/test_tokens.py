import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing, tokenfile
from corpusloom.llm.tokens import PORTION, Encoder, portions

ROWS = [(3, "b  c\n\nd"), (1, None), (2, ""), (5, "word " * 3000), (5, "word " * 3000), (None, "no id"), (4, "x" * 5000), (9, "é ß 中"), (7, "foo <|endoftext|> bar"), (8, "w " * 9000)]


def reference(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name,word_ends", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_cached_encoder_equals_the_library(name, word_ends):
    encode = Encoder(public_tokenizers.path(name), word_ends)
    for text in ["", " ", "a b", "a  b", "a \n b\n", "\x1c x\x85y\xa0z", "it's <|endoftext|> 12,3", "İ́ é", "tab\t\ttab "]:
        assert encode(text).tolist() == reference(name, text, 0)[:-1].tolist()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=300), max_size=6))
def test_segment_round_trip(lists):
    ids = [np.array(x, np.uint32) for x in lists]
    segment = tokenfile.Segment(tokenfile.pack(list(range(len(ids))), ids))
    assert [x.tolist() for x in segment.all_ids()] == lists
    assert [segment.ids(i).tolist() for i in range(len(ids))] == lists


def test_token_file(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("start", __import__("pyspark").sql.functions.lit("clash"))
    got = tokenfile.read_tokens(tokenfile.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))).collect()
    at = 0
    for row, (doc_id, text) in zip(sorted(got, key=lambda r: r.start), sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = reference("word_bpe_49k.json", text, 1)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfile.read_tokens(tokenfile.write_tokens(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    encoded = packing.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(encoded, with_ids=True).collect()
    want = sorted((str(d), reference("byte_bpe_50k.json", t, 0).tobytes()) for d, t in ROWS)
    starts = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.ids_crc32 == zlib.crc32(p.ids)
        starts.setdefault(str(p.doc_id), []).append(p)
    for doc_id, data in want:
        whole = [p for p in starts[doc_id] if p.doc_tokens == len(data) // 4]
        copies = sum(w == (doc_id, data) for w in want)
        assert sum(p.length for p in whole) == copies * len(data) // 4
        assert all(data[4 * p.start : 4 * (p.start + p.length)] == bytes(p.ids) for p in whole)
    for n in {p.sequence_id for p in pieces}:
        mine = sorted((p for p in pieces if p.sequence_id == n), key=lambda p: p.offset)
        end = 0
        for p in mine:
            assert p.offset == end
            end += p.length
        assert end <= 1024 and end & (end - 1) == 0
    assert {p.sequence_id for p in pieces} == set(range(len({p.sequence_id for p in pieces})))
    assert packing.pack(packing.encode(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_hilbert_key_is_a_walk():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    order = cells[np.argsort(packing.hilbert_key(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_segments_of_many_blocks():
    """More blocks than are packed in one go, and a document that begins and ends inside of them."""
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (5, tokenfile.BLOCK * tokenfile.TOGETHER + 77, 3)]
    s = tokenfile.Segment(tokenfile.pack([1, 2, 3], ids))
    assert all((a == b).all() for a, b in zip(s.all_ids(), ids, strict=True))
    assert (s.ids(1) == ids[1]).all() and (s.ids(2) == ids[2]).all()


def test_long_documents_are_many_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 5000), (1, "other " * 5000), (None, "word " * 3000)], "doc_id long, text string")
    encoded = packing.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert encoded.selectExpr("max(length(ids))").first()[0] <= 4 * packing.CHUNK and encoded.count() > 9
    vector = packing.coordinates(np.arange(50_000), packing.HASHED)
    assert vector.max() < packing.HASHED and len(np.unique(vector)) > 0.9 * packing.HASHED


def test_encoder_forgets_late_pieces(monkeypatch):
    """With room for few pieces the ids are the same, and the first pieces stay."""
    monkeypatch.setattr(Encoder, "ROOM", 40)
    monkeypatch.setattr(Encoder, "KEPT", 10)
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = Encoder(path, False), Tokenizer.from_file(path)
    texts = [f"some words come again and again {i} number{i} été{i} {'x' * (i % 9)}" for i in range(60)]
    first = None
    for at in range(0, len(texts), 3):
        got = own.many(texts[at : at + 3])
        assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 3]]
        first = first or list(own.known)[:10]
        assert list(own.known)[:10] == first
    assert len(own.known) < 80


def test_a_column_is_encoded_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, library = Encoder(path, True), Tokenizer.from_file(path)
    odd = ["a", "Z", "J", "é", "É", "ß", "×", "÷", "İ", "ſ", "中", "\u0300", "\u030c", "'s", "'RE", ".", ",", "!", "?", "|", "<", "0", "7", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "\u3000", "<|endoftext|>", "<|StartOfText|>"]
    rng = np.random.default_rng(3)
    texts = [None, "", " ", "a" + "!" * 8, "a" + "!" * 9, "!" * 40, "J\u030c a.", "É. ×. ÷! ÿ,"] + ["".join(rng.choice(odd, rng.integers(0, 40))) for _ in range(3000)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encode.column(pa.array(texts))] == want
    assert [x.tolist() for x in encode.column(pa.array(texts).slice(5, 50))] == want[5:55]
    for few in ([], [None], ["", " "], ["<|endoftext|>"]):
        assert [x.tolist() for x in encode.column(pa.array(few, pa.string()))] == [library.encode(t or "", add_special_tokens=False).ids for t in few]


def test_a_word_of_many_texts_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, key):
            self.asked += 1
            return super().get(key)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    encode = Encoder(public_tokenizers.path("word_bpe_49k.json"), True)
    encode.known = Counted()
    encode.column(pa.array(["Some words, some WORDS. Some words!"] * 1000))
    assert set(encode.known) == {"some", "words", ",", ".", "!"} and encode.known.asked <= 20


def test_portions_keep_all_rows():
    sizes = [0, 5, PORTION, 3 * PORTION + 7, 1, 0, PORTION // 2, PORTION // 2, PORTION // 2, 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if i == 5 else "x" * n for i, n in enumerate(sizes)])], ["doc_id", "text"])
    parts = list(portions(batch, 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(sizes))) and len(parts) >= 4
    assert all(sum(map(len, filter(None, p.column(1).to_pylist()[1:]))) <= PORTION for p in parts)
    assert list(portions(batch.slice(0, 0), 1)) == []


def test_segment_bytes_stay():
    """The file format holds: digest of a segment that the first version wrote."""
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 1 << int(w), 700).astype(np.uint32) for w in range(33)] + [np.array([0, 2**32 - 1] * 300, np.uint32)]
    assert zlib.crc32(tokenfile.pack(list(range(len(ids))), ids)) == 2459839602
