"""rANS blocks and SentencePiece offsets: exact against the libraries."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skiplight.llm import token_blocks
from skiplight.llm.pieces import ModelFile, Normaliser, PieceCodec, encode_pieces, spans
from skiplight.llm.queries import BYTE_BPE, PIECES
from skiplight.llm.token_blocks import ChunkTokeniser, decode_segment, encode_segment, quantise, read_tokens, write_tokens

ODD = ["", " a", " ", "  ", "a ", "a  ", "a  b", "\n", "\n a", "a\n", "a \n b", "a\n\nb", "a\n\n", "a\n\n\nb", "  x\n  y  \n", "tab\tx \t y", "▁x a", "é ü  ß\r\n\x0bz", "日本 語\n日 本", "don't  we'll\n's x", "it's, isn't. x,y", "a<|endoftext|> b", "x 🙂 y　z w", "a\x1cb \x1c c", "Ünïcödé. word, word. word!", "<0x0A> <s> </s>", "1234 5,6 a1 1a", "ﬁ ½ Ⅷ"]
BYTES, CODEC = ChunkTokeniser(BYTE_BPE), PieceCodec(PIECES)
words = st.text(alphabet=st.sampled_from(list("ab é.,'\n\t ▁<>|0é́日")), max_size=40)


def test_segments_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 63, 64, 65, 16384, 16385, 65535, 65536, 65537, 200_000):
        for ids in (rng.integers(0, 50257, n), np.zeros(n, int), (rng.zipf(1.3, n) % 50257).astype(int)):
            assert (decode_segment(encode_segment(ids)) == ids).all()
    every = rng.permutation(50257)
    assert (decode_segment(encode_segment(every)) == every).all()
    f = quantise(np.array([5, 0, 1, 10**9]))
    assert f.sum() == 65536 and f[1] == 0 and f[2] >= 1


def test_segments_are_compact_and_checked():
    rng = np.random.default_rng(1)
    ids = rng.choice(1000, 131_072, p=np.arange(1, 1001) / 500_500)
    p = np.bincount(ids) / len(ids)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum()
    data = encode_segment(ids)
    assert len(data) * 8 < 1.03 * bits * len(ids)
    for at in (len(data) - 5, len(data) // 2):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError, match="checksum"):
            decode_segment(bytes(bad))
    with pytest.raises(ValueError):
        decode_segment(b"none")


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=1, max_size=4))
def test_chunks_equal_the_library(texts):
    t = BYTES
    texts = texts + [" ".join(texts)]
    assert [np.frombuffer(x, np.uint16).tolist() for x in t.encode(texts)] == [t.lib.encode(x, add_special_tokens=False).ids for x in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(words, min_size=1, max_size=8))
def test_long_texts_are_cut_safely(texts):
    t = BYTES
    text = "<|endoftext|> a, b".join(texts) + " "
    token_blocks.PIECE, old = 5, token_blocks.PIECE
    try:
        for x in (text, text * 3, " ".join(texts).replace("  ", " ")):
            assert np.frombuffer(t.encode([x])[0], np.uint16).tolist() == t.lib.encode(x, add_special_tokens=False).ids
    finally:
        token_blocks.PIECE = old


def test_a_long_odd_text_is_never_held_as_a_whole_by_the_library(monkeypatch):
    t, most = ChunkTokeniser(BYTE_BPE), []

    class Lib:
        def encode(self, x, **kw):
            most.append(len(x))
            return lib.encode(x, **kw)

    lib, t.lib = t.lib, Lib()
    text = "one  two, three\t" * 40_000 + " "
    assert np.frombuffer(t.encode([text])[0], np.uint16).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert max(most) < token_blocks.PIECE + 100 and len(most) >= 4


def test_chunks_of_odd_texts_and_a_small_cache():
    t = ChunkTokeniser(BYTE_BPE, most=3)
    for _ in range(2):
        assert [np.frombuffer(x, np.uint16).tolist() for x in t.encode(ODD)] == [t.lib.encode(x, add_special_tokens=False).ids for x in ODD]


def test_corpus_is_written_in_order(docs_of, spark, tmp_path):
    rows = [(9, "nine"), (2, None), (5, ""), (2, "two again"), (-3, "minus"), (None, "null id"), (7, "many words here " * 9000)] + [(100 + i, t) for i, t in enumerate(ODD)]
    write_tokens(docs_of(rows, extra=["k", "t", "shard"]), str(tmp_path / "t"), BYTE_BPE, segment_tokens=500, partitions=3)
    got = read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    lib = ChunkTokeniser(BYTE_BPE).lib
    ids = {}
    for k, t in rows:
        ids.setdefault(k, []).append([*lib.encode(t or "", add_special_tokens=False).ids, 0])
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    start = 0
    for r in got:
        assert r["ids"] in ids[r["doc_id"]] and r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    write_tokens(docs_of([]), str(tmp_path / "e"), BYTE_BPE)
    assert read_tokens(spark, str(tmp_path / "e")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=1, max_size=4))
def test_pieces_equal_the_library(texts):
    c = CODEC
    for t, ids in zip(texts, c.encode(texts)):
        assert ids.tolist() == c.lib.encode(t)
        check_spans(c, t, ids)


def check_spans(c, text, ids):
    """Each span's bytes are what its piece stands for."""
    src, begin = text.encode(), 0
    ends = c.ends(text, ids)
    for piece, end in zip(c.lib.encode(text, out_type=str), ends):
        part = src[begin:end]
        begin = end
        if piece.startswith("<0x") and len(part) == 1:
            assert part == bytes([int(piece[3:5], 16)])
        else:
            plain = piece.replace("▁", " ")
            assert part.decode().replace("▁", " ") in (plain, plain[1:])
    assert begin == len(src)


def test_odd_pieces(docs_of):
    c = CODEC
    for t, ids in zip(ODD, c.encode(ODD)):
        assert ids.tolist() == c.lib.encode(t)
        check_spans(c, t, ids)
    rows = [(1, None), (1, "twice"), (1, "twice"), (None, "null"), (2, "long " * 30_000)] + [(10 + i, t) for i, t in enumerate(ODD)]
    got = spans(encode_pieces(docs_of(rows, extra=["ids", "k", "t"]), PIECES)).collect()
    assert len(got) == len(rows)
    texts = {k: t for k, t in rows}
    for r in got:
        t = texts[r["doc_id"]] if r["doc_id"] != 1 else ("twice" if r["ids"] else "")
        assert r["ids"] == c.lib.encode(t or "") and r["decoded"] == c.lib.decode(r["ids"])
        assert [s["id"] for s in r["spans"]] == r["ids"] and [s["end"] for s in r["spans"]] == r["ends"]
        assert [s["begin"] for s in r["spans"]] == [0, *r["ends"]][: len(r["ids"])]
        assert hashlib.sha256(r["decoded"].encode()).hexdigest() == hashlib.sha256(c.lib.decode(r["ids"]).encode()).hexdigest()
    assert encode_pieces(docs_of([]), PIECES).collect() == []


@settings(max_examples=100, deadline=None)
@given(words, st.booleans())
def test_alignment_at_once_equals_byte_by_byte(text, prefix):
    n = Normaliser(dummy_prefix=prefix, squeeze=False)
    slow = Normaliser(dummy_prefix=prefix, squeeze=False, symbols=("\x00",))
    (a, x), (b, y) = n.run(text), slow.run(text)
    begins = [i for i in range(len(a) + 1) if i == len(a) or a[i] & 0xC0 != 0x80]
    assert a == b and x[begins].tolist() == y[begins].tolist() and len(x) == len(y)


def test_compiled_character_map():
    """Normalisation by the map of a public rule equals the library's, with the same alignment."""
    import sentencepiece

    for rule in ("nmt_nfkc", "nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        model = ModelFile(lib.serialized_model_proto())
        assert model.charsmap
        n = Normaliser(model.charsmap)
        for t in [*ODD, "ＡＢＣ　ｄ", "  ①② ㍿ ｶﾞ x  ", "é ǟ", "ﬁﬂ ŉ ǆ", "​zero­"]:
            got, origin = n.run(t)
            want = lib.normalize(t)
            assert got.decode() == want, (rule, t)
            assert len(origin) == len(got) + 1 and (np.diff(origin) >= 0).all() and origin[-1] <= len(t.encode())
