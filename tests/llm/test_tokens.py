"""Operators 3 and 5 against the libraries applied to whole texts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from basketry.llm import packing, sentencepiece_table
from basketry.llm.queries import op3_sentencepiece, op5_packing
from tests.conftest import SF_SMALL
from tests.llm.cases import empty_documents, odd_documents, odd_rows

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected_digest(library, doc_id, text):
    ids = library.encode(text or "")
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_sentencepiece_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = sorted(map(tuple, op3_sentencepiece(spark, SF_SMALL).collect()))
    assert got == sorted(expected_digest(library, r.doc_id, r.text) for r in docs)


def test_sentencepiece_odd_rows(spark, library):
    got = [tuple(r) for r in sentencepiece_table.encode_digests(odd_documents(spark), PIECES).collect()]
    want = [expected_digest(library, r[0], r[1]) for r in odd_rows()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sentencepiece_table.encode_digests(empty_documents(spark), PIECES).count() == 0


def test_sentencepiece_ids_round_trip(spark, library):
    for r in sentencepiece_table.encode(odd_documents(spark), PIECES).collect():
        assert library.decode(list(r.ids)) == r.decoded


def fuzz(n, seed):
    pick = random.Random(seed)
    parts = [" ", "  ", "\n", "a", "The", "▁", "\t", "é", "Ā", "中", "​", "😀", "\x00", "<s>", "<unk>", "\r", ".", "x1", " ", "　", "'s", "12", "_", "-", "́"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 9))) for _ in range(n)]


def test_chunks_of_random_texts(library, tokenizer):
    texts = fuzz(3000, 5)
    codec, tokens = sentencepiece_table.ChunkCodec(PIECES), packing.Tokens(BPE)
    for text, (n, ids, decoded), raw in zip(texts, codec.rows(texts), tokens.ids(texts)):
        own = library.encode(text)
        assert (n, ids, decoded) == (len(own), ",".join(map(str, own)), library.decode(own)), repr(text)
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check_packing(rows, texts, tokenizer, size=1024):
    """texts: list of (doc_id, text); rows without repeated documents."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and 0 < r.length <= size
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return windows


def test_packing_query(spark, tokenizer):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    rows = op5_packing(spark, SF_SMALL).collect()
    windows = check_packing(rows, [(r.doc_id, r.text) for r in docs], tokenizer)
    used = sum(r.length for r in rows)
    assert used / (1024 * len(windows)) > 0.98


def test_packing_odd_rows(spark, tokenizer):
    cut = packing.pieces(odd_documents(spark), BPE)
    rows = packing.pack(cut, shards=3).collect()
    once = {r[0]: r[1] for r in odd_rows() if r[0] not in (None, 0)}
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.doc_id] += r.length
    plain = len(tokenizer.encode("plain text here.", add_special_tokens=False).ids) + 1
    assert lengths[0] == 3 * plain
    assert lengths[1] == lengths[2] == 1  # the separator alone
    for doc_id, text in once.items():
        assert lengths[doc_id] == len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    assert packing.pack(packing.pieces(empty_documents(spark), BPE)).count() == 0


def test_best_fit_decreasing_equals_plain_search():
    pick = random.Random(3)
    lengths = sorted((pick.randint(1, 64) for _ in range(500)), reverse=True)
    packer, room = packing.Packer(64), []
    for n in lengths:
        fits = [r for r in room if r >= n]
        window, offset = packer.place(n)
        if fits:
            assert room[window] == min(fits)
        else:
            assert window == len(room)
            room.append(64)
        assert offset == 64 - room[window]
        room[window] -= n


def test_sequences_are_padded_except_at_a_power_of_two(spark, tokenizer):
    docs = spark.createDataFrame([(0, "a b c"), (1, " x" * 3000)], "doc_id bigint, text string")
    packed = packing.pack(packing.pieces(docs, BPE, with_ids=True))
    for r in packing.sequences(packed).collect():
        held = sum(d.length for d in r.documents)
        assert len(r.ids) == (held if held & (held - 1) == 0 else 1024)
        assert [d.offset for d in r.documents] == sorted(d.offset for d in r.documents)


def test_added_tokens_are_coded_as_the_library_codes_them_as_loaded(spark, tmp_path):
    from tokenizers import Tokenizer
    loaded = Tokenizer.from_file(BPE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y<|endoftext|>", "a\n<|endoftext|>\n b", "<|endof text|>", "<|endoftext|", " <|endoftext|>\t x", "é中😀 <|endoftext|> </s>\t x", "plain", "", None, "word <|endoftext|> " * 2000]
    assert loaded.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check_packing(op5_packing(spark, str(tmp_path)).collect(), docs, loaded)
    coded = packing.Tokens(BPE, added_tokens=True)
    parts = ["<|endoftext|>", "<|", "endoftext", "|>", " ", "\n", "a", "1", "é", "'s", "\t", "."]
    pick = random.Random(11)
    for text in ["".join(pick.choice(parts) for _ in range(pick.randint(0, 9))) for _ in range(3000)] + fuzz(1000, 6):
        assert np.frombuffer(coded.ids([text])[0], "<u4").tolist() == loaded.encode(text, add_special_tokens=False).ids, repr(text)


def test_ranks_give_the_ids_of_the_file():
    tokens = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.ranks is not None
    pick = random.Random(6)
    letters = "".join(map(chr, range(0x20, 0x7F)))
    chunks = ["".join(pick.choices(letters, k=pick.randint(1, 24))) for _ in range(20_000)]
    chunks += [" " + w for w in "It's we'll DON'T 1234567 a1b2 (x) ... --- $5,000 http://a.b/c?d=e&f".split()] + ["   ", " ", "'s", " 's"]
    assert tokens._encode(chunks) == tokens._encode_whole(chunks)


def test_files_of_another_kind_are_not_coded_by_ranks():
    assert packing._as_ranks(public_tokenizers.path("word_bpe_49k.json")) is None


def test_whole_texts_by_ranks_equal_the_library(tokenizer):
    tokens = packing.Tokens(BPE)
    pick = random.Random(11)
    signs = [*"ab1 '\t\n\r Жя中あ١½ﬁ🙂 ᠎\x85\xa0　\x1c", "'s", "  ", "x" * 300, " " * 300, "ж" * 257]
    texts = ["".join(pick.choice(signs) for _ in range(pick.randint(0, 30))) for _ in range(3000)]
    for text, raw in zip(texts, tokens.ids(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert tokens._by_ranks("plain text,\twith a tab and Жя") is not None
    assert tokens._by_ranks("new sign \U0001f642") is None and tokens._by_ranks("x" * 300) is None


def test_parts_of_long_texts_are_cut_where_the_pattern_cuts(tokenizer, monkeypatch):
    pick = random.Random(2)
    text = "".join(pick.choice(["ab", " ", "  ", "\n", "'s", "\t ", "1", "é"]) for _ in range(4000))
    cut = list(packing.parts(text, 50))
    assert "".join(cut) == text and len(cut) > 40 and all(c[0] == " " for c in cut[1:])
    assert list(packing.parts("", 50)) == [""] and list(packing.parts("a" * 200, 50)) == ["a" * 200]
    monkeypatch.setattr(packing.parts, "__defaults__", (50,))
    assert np.frombuffer(packing.Tokens(BPE).ids([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
