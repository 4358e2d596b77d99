"""Operators 1, 6 and 8 against the tokenizer libraries."""

import signal
import zlib
from math import ceil

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shipgraph.llm import bpe_count, huffman, packing, tokens

from .conftest import odd_rows

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LIB = Tokenizer.from_file(BPE)


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def encode(texts):
    import pyarrow as pa
    out = []
    for flat, at in tokens.Encoder(BPE).encode(pa.array(texts, pa.string())):
        out += [flat[x:y].tolist() for x, y in zip(at, at[1:])]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r ab'sé1!<|x ", max_size=30), max_size=6))
def test_chunked_ids_equal_the_library(texts):
    texts = [*texts, None, "<|endoftext|> a", "it's  12\n\n x "]
    assert encode(texts) == [ids(t) for t in texts]


def test_repeated_chunks_and_a_full_memory(monkeypatch):
    enc = tokens.Encoder(BPE)
    enc.chunks.seen.most = 50
    import pyarrow as pa
    texts = [" ".join(f"word{i * j % 83}" for i in range(60)) for j in range(20)]
    for _ in range(2):
        got = []
        for t in texts:
            for flat, at in enc.encode(pa.array([t])):
                got += [flat[x:y].tolist() for x, y in zip(at, at[1:])]
        assert got == [ids(t) for t in texts]


@pytest.fixture
def a_minute():
    """Ends a test that would never end."""
    def stop(*_):
        raise TimeoutError
    old = signal.signal(signal.SIGALRM, stop)
    signal.alarm(60)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, old)


def test_a_text_of_more_chunks_than_the_memory_has_slots(a_minute):
    import pyarrow as pa
    enc, cnt = tokens.Encoder(BPE), bpe_count.Counter(PIECES)
    enc.chunks = tokens.Chunks(enc._new, np.uint32, 8)
    cnt.chunks = tokens.Chunks(cnt._new, np.int32, 8)
    assert len(enc.chunks.seen.slot) == 16
    texts = ["a b", " ".join(f"w{i}é" for i in range(500)), "w3é", " ".join("ab" * 300), "\t", ""]
    got = [flat[x:y].tolist() for flat, at in enc.encode(pa.array(texts))
           for x, y in zip(at, at[1:])]
    assert got == [ids(t) for t in texts]
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    few = [t for t in texts if "\t" not in t]
    assert cnt.count(pa.array(few)).tolist() == [len(lib.encode(t)) for t in few]


def test_packing(docs):
    rows = odd_rows() + [(100 + i, "some words " * (i % 37)) for i in range(200)]
    got = packing.packed_documents(docs(rows), BPE, 256, 2).collect()
    want = []
    for d, t in ((r[0], r[1]) for r in rows):
        x = ids(t) + [2]
        first = (len(x) - 1) % 256 + 1
        cut = [0, *range(first, len(x) + 1, 256)]
        want += [(d, p, a, b - a, crc(x[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:]))]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for off, length in sorted(s):
            assert off == at
            at += length
        assert at <= 256
    assert len(seqs) <= ceil(sum(w[3] for w in want) / 256 * 1.02) + 1


def test_packing_of_nothing(docs):
    assert packing.packed_documents(docs([]), BPE).count() == 0


def histograms():
    rng = np.random.default_rng(4)
    n = np.arange(1, 257)
    return {"skewed": (n, np.maximum(1, (30_000 / n ** 1.1).astype(int))),
            "flat": (n, np.full(256, 40)), "full": (n[-1:], np.array([7])),
            "long": (n[100:], rng.integers(1, 400, 156)),
            "few": (np.array([23, 61, 88, 97, 130]), np.array([900, 410, 777, 380, 505])),
            "halves": (np.array([86, 128, 129]), np.array([1000, 1001, 300])),
            "single": (np.array([100]), np.array([5]))}


@pytest.mark.parametrize("name", list(histograms()))
def test_plan_is_within_a_sequence_a_length_of_the_bound(name):
    lengths, counts = histograms()[name]
    plan, bound = packing.configurations(lengths, counts, 256)
    assert (sum(c * m for c, m in plan) == counts).all()
    assert all(c @ lengths <= 256 and m > 0 for c, m in plan)
    assert bound >= lengths @ counts / 256 - 1e-6
    n = sum(m for _, m in plan)
    assert bound - 1e-6 <= n <= bound + len(lengths)


def test_bound_is_below_the_best_plan():
    # 86 + 86 fit one sequence of 256, 129 + anything longer than 127 doesn't
    lengths, counts = np.array([86, 128, 129]), np.array([1000, 1001, 300])
    _, bound = packing.covering(lengths, counts, 256)
    best = 300 + 1001 / 2 + (1000 - 300) / 2  # 129 + 86, 128 + 128, 86 + 86
    assert best * 0.98 <= bound <= best + 1e-6


def test_prices_fall_with_coverage():
    best, took, rest = packing.best_values(np.array([-np.inf, -np.inf, -np.inf, 0.5, 0.6]))
    assert best == [0, 0, 0, 0.5, 0.6] and took[4] == 4 and rest[4] == 0
    price = np.full(11, -np.inf)
    price[[3, 4]] = 0.5, 0.6
    best, took, rest = packing.best_values(price)
    assert best[10] == pytest.approx(1.6) and sorted([took[10], took[rest[10]],
                                                      took[rest[rest[10]]]]) == [3, 3, 4]


def test_configurations_cover_every_count():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 65, 30))
    counts = rng.integers(1, 40, len(lengths))
    plan, bound = packing.configurations(lengths, counts, 64)
    assert sum(m for _, m in plan) <= bound + len(lengths)
    assert (sum(c * m for c, m in plan) == counts).all()
    assert all((c * lengths).sum() <= 64 for c, _ in plan)


def test_knapsack_is_optimal():
    value, lengths, copies = np.array([3.0, 4, 5]), np.array([2, 3, 4]), np.array([1, 2, 1])
    best = max(3 * a + 4 * b + 5 * c for a in range(2) for b in range(3) for c in range(2)
               if 2 * a + 3 * b + 4 * c <= 9)
    counts, total = packing.knapsack(value, lengths, copies, 9)
    assert total == best == (counts * value).sum()


def test_token_files(docs):
    rows = odd_rows()
    got = huffman.round_trip(docs(rows), BPE, 0).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for d, t in ((r[0], r[1]) for r in order):
        x = ids(t) + [0]
        want.append((d, at, len(x), crc(x)))
        at += len(x)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_token_files_of_nothing(docs):
    assert huffman.round_trip(docs([]), BPE, 0).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 60, 3000])
def test_code_lengths(n):
    counts = np.floor(1.6 ** np.minimum(np.arange(n), 60)).astype(np.int64)
    size = huffman.code_lengths(counts, 12)
    assert size.max() <= 12 and (n == 1 or sum(2.0 ** -size) == 1)
    if n == 3:
        assert sorted(size) == [1, 2, 2]


def test_codes_are_packed_in_two_passes(monkeypatch):
    rng = np.random.default_rng(3)
    codes = huffman.Codes(np.arange(3000), huffman.code_lengths(
        (1.01 ** np.arange(3000)).astype(np.int64) + 1))
    ids = rng.integers(0, 3000, 5000)
    count, passes = np.bincount, []
    monkeypatch.setattr(np, "bincount", lambda *a, **k: passes.append(1) or count(*a, **k))
    payload, offsets = codes.encode(ids)
    assert len(passes) == 2
    bits = "".join(f"{codes.code[i]:0{codes.length[i]}b}" for i in ids)
    assert "".join(f"{x:08b}" for x in payload)[:len(bits)] == bits
    assert (codes.decode(np.frombuffer(payload, np.uint8), offsets, len(ids)) == ids).all()
    assert codes.encode(ids[:0])[0].strip(b"\0") == b""


def test_blocks_decode_alone():
    rng = np.random.default_rng(0)
    x = np.minimum(rng.zipf(1.3, 5000), 60_000).astype(np.int64)
    s, c = np.unique(x, return_counts=True)
    codes = huffman.Codes(s, huffman.code_lengths(c))
    for n in (1, 255, 256, 257, 5000):
        raw, at = codes.encode(x[:n])
        assert (codes.decode(np.frombuffer(raw, np.uint8), at, n) == x[:n]).all()


def test_token_counts(docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = odd_rows() + [(50, "▁x ▁ y <s> </s> <unk> <0x0A>"), (51, "ab" * 500), (52, "  lead")]
    got = bpe_count.token_counts(docs(rows), PIECES, 4096).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = [(d, len((t or "").encode()), len(lib.encode(t or ""))) for d, t in
            ((r[0], r[1]) for r in rows)]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(
        [(*w, w[2] > 4096) for w in want], key=key)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_merging_equals_the_library(text):
    import pyarrow as pa
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert bpe_count.counter(PIECES).count(pa.array([text]))[0] == len(lib.encode(text))
