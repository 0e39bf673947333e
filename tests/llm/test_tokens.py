"""Operators 4, 6 and 10 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from chemscore.llm import bpe, bytebpe, token_counts, token_files

from helpers import lines


def hostile():
    r = random.Random(7)
    alphabet = " \n\t.,'a1bZé日😀\xa0\x1c\x85\u3000ſǅ²"
    out = [None, "", " ", "  a", "a  b", "x\n \ny", "a \nb", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>c",
           "don't we'll 'S", "\u0558x 1", "é" * 500, "a" * 20_000, "word " * 4_000, "\x00\x01"]
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(300)]
    out += ["".join(r.choice([" the", "<|endoftext|>", "\n", " ", "ing", "2024", "—"]) for _ in range(20))
            for _ in range(100)]
    return [*out, "same", "same"]


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(hostile()), (None, "no id"), (7, "repeated id")]


@pytest.fixture(scope="module")
def wanted(rows, bpe_file):
    tok = bytebpe.library(bpe_file)
    return [(i, t or "", tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows]


def test_counts(frame, rows, wanted, bpe_file):
    got = token_counts.count_tokens(frame(rows), bpe_file, limit=30, table_rows=50)
    assert lines(got) == sorted(((i, len(t.encode()), len(x), len(x) > 30) for i, t, x in wanted), key=str)


def test_bpe_round_trip(frame, rows, wanted, bpe_file):
    tok = bytebpe.library(bpe_file)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(tok.decode(x, skip_special_tokens=False).encode()))
            for i, _, x in wanted]
    assert lines(bpe.round_trip(frame(rows), bpe_file)) == sorted(want, key=str)


def test_bpe_decode_gives_texts_back(frame, rows, wanted, bpe_file):
    got = bpe.decode(bpe.encode(frame(rows), bpe_file), bpe_file)
    assert lines(got) == sorted(((i, t) for i, t, _ in wanted), key=str)


def test_decode_of_broken_bytes(bpe_file):
    tok, tree = bytebpe.library(bpe_file), bpe.TreeBPE(bpe_file)
    r = random.Random(3)
    for _ in range(300):
        ids = [r.randrange(256) for _ in range(r.randint(0, 8))]
        assert tree.decode(np.array(ids, "<u4").tobytes()) == tok.decode(ids, skip_special_tokens=False)


def test_cache_turnover_changes_nothing(wanted, bpe_file):
    coder = bpe.TreeBPE(bpe_file).coder(limit=5)
    for _, text, ids in wanted * 2:
        assert coder.texts([text]) == [np.array(ids, "<u4").tobytes()]


def test_run_coder_with_and_without_room(wanted, rows, bpe_file):
    for limit in (10, 500_000):
        coder = bytebpe.RunCoder(bpe_file, limit)
        texts = [t or "" for _, t in rows]
        got = [np.frombuffer(coder.text(t), "<u4").tolist() for t in texts + texts]
        lib = bytebpe.library(bpe_file)
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts] * 2


def test_pre_tokens_of_every_letter_agree(bpe_file):
    pre = bytebpe.PreTokens(bpe_file)
    lib = bytebpe.library(bpe_file).pre_tokenizer
    for c in range(0, 0x30000, 7):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1{chr(c)}{chr(c)}! {chr(c)} \n{chr(c)}"
            assert pre.exact(text) == [text[a:b] for _, (a, b) in lib.pre_tokenize_str(text)], hex(c)


def test_file_round_trip(frame, rows, wanted, bpe_file):
    at, want = 0, []
    for i, _, x in sorted(wanted, key=lambda w: (w[0] is not None, w[0] or 0, w[1])):
        ids = np.array([*x, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert lines(token_files.round_trip(frame(rows), bpe_file, end_id=2)) == sorted(want, key=str)


def test_small_segments(frame, rows, wanted, bpe_file, monkeypatch):
    # segments of a few ids: the packing must not depend on where they end
    ids = np.concatenate([np.array(x, dtype=np.uint32) for _, _, x in wanted])
    for size in (1, 3, 1000, len(ids)):
        parts = [token_files.unpack(token_files.pack(ids[k:k + size])) for k in range(0, min(len(ids), 20 * size), size)]
        assert np.array_equal(np.concatenate(parts), ids[:sum(map(len, parts))])


@pytest.mark.parametrize("n", [0, 1, 65_535, 65_536, 65_537, 200_000])
def test_rans_sizes(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_257).astype(np.uint32)
    assert np.array_equal(token_files.unpack(token_files.pack(ids)), ids)


def test_rans_one_symbol_and_all_symbols():
    for ids in (np.full(100_000, 9, np.uint32), np.arange(50_257, dtype=np.uint32)):
        assert np.array_equal(token_files.unpack(token_files.pack(ids)), ids)


def test_damage_is_found():
    data = bytearray(token_files.pack(np.arange(200_000, dtype=np.uint32) % 1000))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.unpack(bytes(data))


def test_empty_tables(frame, bpe_file):
    none = frame([])
    assert token_counts.count_tokens(none, bpe_file).count() == 0
    assert bpe.round_trip(none, bpe_file).count() == 0
    assert token_files.round_trip(none, bpe_file, 2).count() == 0
