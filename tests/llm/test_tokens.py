"""Lexicon BPE and rANS files: against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import regex
from public_tokenizers import path
from tokenizers import Tokenizer

from chronolith.llm import kernels, lexicon_bpe, rans_files
from tests.conftest import DATA
from tests.llm.conftest import ROWS

WORD, BYTE = path("word_bpe_49k.json"), path("byte_bpe_50k.json")


def digests(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)))


def test_op1_against_the_library(spark, listed):
    tok = Tokenizer.from_file(WORD)
    assert {r["doc_id"]: tuple(r)[1:] for r in lexicon_bpe.op1_lexicon_bpe(spark, DATA).collect()} == {i: digests(tok, t) for i, t in listed}


def test_op1_odd(odd, none):
    tok = Tokenizer.from_file(WORD)
    name = lexicon_bpe.build_lexicon(odd, WORD)
    got = sorted(map(tuple, lexicon_bpe.round_trip_digests(odd, WORD, name).collect()), key=str)
    assert got == sorted(((i, *digests(tok, t)) for i, t, *_ in ROWS), key=str)
    encoded = lexicon_bpe.encode_documents(odd, WORD, name)
    decoded = {r["doc_id"]: r["text"] for r in lexicon_bpe.decode_documents(encoded, WORD).collect()}
    assert decoded[1] == tok.decode(tok.encode(ROWS[0][1], add_special_tokens=False).ids, skip_special_tokens=False)
    assert lexicon_bpe.round_trip_digests(none, WORD, lexicon_bpe.build_lexicon(none, WORD)).count() == 0


def test_transducer_is_minimal_and_exact(tmp_path):
    model = lexicon_bpe.BpeModel(WORD)
    words = [a + b for a in ("walk", "talk", "stalk", "jump") for b in ("", "s", "ed", "ing", "er", "ers")]
    (tmp_path / "x").write_bytes(lexicon_bpe.compile_lexicon(model, [w.encode() for w in words]))
    lex = lexicon_bpe.Lexicon(str(tmp_path / "x"))
    probe = [*words, "wal", "walke", "walkin", "zebra", ""]
    flat, bounds = np.frombuffer("".join(probe).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in probe])])
    at = lex.indexes(flat, bounds)
    assert sorted(at[: len(words)].tolist()) == list(range(len(words))) and (at[len(words) :] == -1).all()
    assert len(lex.final) < 20  # suffixes are shared by all stems
    tok = Tokenizer.from_file(WORD)
    for w, i in zip(words, at.tolist(), strict=False):
        assert lex.ids[lex.id_bounds[i] : lex.id_bounds[i + 1]].tolist() == tok.encode(w, add_special_tokens=False).ids


def test_merging_long_and_random_words():
    model, tok, rnd = lexicon_bpe.BpeModel(WORD), Tokenizer.from_file(WORD), random.Random(5)
    words = ["".join(rnd.choice("abething") for _ in range(rnd.choice([1, 3, 9, 40, 256, 257, 700]))) for _ in range(200)]
    flat, bounds = np.frombuffer("".join(words).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    ids, at = model.merged(flat, bounds)
    for i, w in enumerate(words):
        assert ids[at[i] : at[i + 1]].tolist() == tok.encode(w, add_special_tokens=False).ids


def test_pieces_against_regex():
    keeping = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    dropping = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    rnd = random.Random(2)
    for _ in range(500):
        texts = ["".join(rnd.choice("aéstrevldm'' \n  \t1²!. 日") for _ in range(rnd.randint(0, 14))) for _ in range(4)]
        cps, b = kernels.code_points(texts)
        for f, p in ((kernels.pieces_keeping_space, keeping), (kernels.pieces_dropping_space, dropping), (kernels.words, regex.compile(r"[^\x20\x09-\x0D]+"))):
            s, e, w = f(cps, b)
            joined = "".join(texts)
            assert [[joined[x:y] for x, y in zip(s[w[i] : w[i + 1]], e[w[i] : w[i + 1]], strict=True)] for i in range(4)] == [p.findall(t) for t in texts]


def thue_morse(n):
    """Two words of 2**n letters that any polynomial hash modulo a power of two takes for one another."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_of_equal_hash(spark, monkeypatch, tmp_path):
    """Known bad words, then hashes of three bits: ids are still the library's in op1 and op5."""
    rnd = random.Random(8)
    texts = [*thue_morse(10), " ".join(thue_morse(11)), *(" ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))) for _ in range(300)) for _ in range(4))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    tok = Tokenizer.from_file(WORD)
    assert sorted(map(tuple, lexicon_bpe.round_trip_digests(df, WORD, lexicon_bpe.build_lexicon(df, WORD)).collect())) == [(i, *digests(tok, t)) for i, t in enumerate(texts)]
    rans_files.write_files(df, BYTE, str(tmp_path / "f"))
    assert sorted(map(tuple, rans_files.read_documents(spark, str(tmp_path / "f")).collect())) == files_of(list(enumerate(texts)))
    plain = kernels.slice_hashes
    monkeypatch.setattr(kernels, "slice_hashes", lambda *x: plain(*x) & np.uint64(7))
    enc = lexicon_bpe.Encoder(lexicon_bpe.BpeModel(WORD), None)
    got = [flat[a:b].tolist() for flat, at in enc.encode(texts) for a, b in zip(at, at[1:], strict=False)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    flat, at = rans_files.PieceTokenizer(BYTE).encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [Tokenizer.from_file(BYTE).encode(t, add_special_tokens=False).ids for t in texts]


def test_a_decoder_is_honoured(spark):
    """The byte vocabulary has one: texts come back as they were."""
    model, tok = lexicon_bpe.BpeModel(BYTE), Tokenizer.from_file(BYTE)
    rows = [tok.encode(t or "", add_special_tokens=False).ids for _, t, *_ in ROWS]
    flat, bounds = np.concatenate([np.array(r, np.int64) for r in rows]), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert [bytes(x).decode() for x in lexicon_bpe.decoded(model, flat, bounds)] == [tok.decode(r, skip_special_tokens=False) for r in rows]


def files_of(rows):
    tok, start, out = Tokenizer.from_file(BYTE), 0, []
    for i, t in rows:
        a = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(a), zlib.crc32(a.tobytes())))
        start += len(a)
    return out


def test_op5_against_the_library(spark, listed):
    assert sorted(map(tuple, rans_files.op5_rans_files(spark, DATA).collect())) == files_of(listed)


def test_op5_odd(spark, odd, none, tmp_path):
    rans_files.write_files(odd, BYTE, str(tmp_path / "f"))
    want = files_of(sorted(((i, t) for i, t, *_ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted(map(tuple, rans_files.read_documents(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1]) == want
    rans_files.write_files(none, BYTE, str(tmp_path / "g"))
    assert rans_files.read_documents(spark, str(tmp_path / "g")).count() == 0


@pytest.mark.parametrize("n", [1, 511, 513, 70_000, 200_001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 50257
    cuts = np.sort(rng.integers(1, n + 1, 5)) if n > 10 else np.array([], int)
    sizes = np.diff(np.unique(np.concatenate([[0], cuts, [n]])))
    data = rans_files.encode_file([None, *range(len(sizes) - 1)], sizes, ids)
    doc_ids, got, blocks = rans_files.read_file(data)
    assert (np.concatenate(list(blocks)) == ids).all() and got.tolist() == sizes.tolist() and doc_ids[0] is None
    broken = bytearray(data)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        list(rans_files.read_file(bytes(broken))[2])


def test_decoding_may_start_at_a_checkpoint():
    ids = np.random.default_rng(3).integers(0, 300, 200_000)
    freq = rans_files.scaled_frequencies(np.bincount(ids))
    start, slots = np.cumsum(freq) - freq, np.repeat(np.arange(300), freq)
    block = memoryview(rans_files.encode_block(ids, freq, start))
    whole = rans_files.decode_block(block, freq, start, slots)
    step = rans_files.CHECKPOINT * rans_files.LANES
    for k in (1, 2, 3):
        assert (rans_files.decode_block(block, freq, start, slots, k) == whole[k * step :]).all()
    for counts in ([1], [1] * 50_000, [10**9] + [1] * 50_000):
        assert rans_files.scaled_frequencies(np.array(counts)).sum() == 1 << rans_files.SCALE
