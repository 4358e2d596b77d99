"""Operator 12 against the tiktoken library."""

import hashlib
import random

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from shipgraph.llm import bpe_codec

from .conftest import SF, needs_data, odd_rows

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe_codec.read_ranks(PATH)
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts():
    rnd = random.Random(11)
    some = "abcxyz EnergieÉŁßж日本語한🎉  　\u0085\t\n\r\x00'’09٣²½.,;!?<|>_-"
    texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts += ["it's we'll I'd THEY'RE", "a  b   c \n\n d ", "x" * 3000, "ab" * 700, " " * 500,
              "語" * 400, "".join(rnd.choice("etaoinshrdlu") for _ in range(2500)),
              "<|endoftext|> is text", " ᠎​﻿ mixed", "\n" * 90 + "end"]
    return texts


def held(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    want = []
    for d, text in rows:
        ids = LIB.encode_ordinary(text or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_odd_texts(docs):
    rows = list(enumerate(odd_texts())) + [(1000 + (r[0] or 0), r[1]) for r in odd_rows()]
    df = docs(rows, files=3, extra={"ids": F.lit("clash"), "w": F.lit(1), "__row": F.lit(2)})
    held(bpe_codec.round_trip(df, PATH, P.PATTERN), rows)


def test_ids_do_not_depend_on_what_is_remembered(docs):
    rows = list(enumerate(odd_texts()[:60])) * 2
    df = docs(rows)
    for common, long in ((3, 64), (1000, 4), (0, 64)):
        got = bpe_codec.encoded(df, PATH, P.PATTERN, common=common, long=long).collect()
        assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted(
            (d, LIB.encode_ordinary(t)) for d, t in rows)


def test_empty_table(docs):
    assert bpe_codec.round_trip(docs([]), PATH, P.PATTERN).count() == 0


def test_heap():
    rnd = random.Random(2)
    for _ in range(300):
        w = bytes(rnd.choice(b"abcdtheing \xc3\xa9") for _ in range(rnd.randint(1, 40)))
        assert bpe_codec.heap_ids(w, RANKS) == LIB._encode_single_piece(w)


@needs_data
def test_query_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held(bpe_codec.round_trip(df, PATH, P.PATTERN), [tuple(r) for r in df.collect()])
