"""Operator 4: language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary classifier over
hashed byte n-grams tells the languages with bit 1 from those with bit 0: its
weights are the log ratios of the two sides' n-gram frequencies, summed by a
Spark job over every labelled row.  How often each classifier is right for
each language is measured on a bounded sample and weights the loss; a text
gets the language whose codeword has the least weighted loss, and is flagged
as ambiguous when the runner-up is about as near.

Defined results: null text, and text without a letter, is ``und`` with score
0; without a labelled row every text is ``und``; rows with null lang teach
nothing; repeated rows count as often as they stand; columns of the input
that carry an output name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bytes_of, doc_runs, small_batches

#: Buckets of hashed n-grams, and the n-grams' lengths in bytes.
BUCKETS, GRAMS = 1 << 15, (2, 3)
#: Labelled rows, at most about this many, on which classifiers are weighted.
SAMPLE_ROWS = 20_000
#: Most classifiers; up to 6 languages get the exhaustive code, more a random one.
MOST_BITS = 31
UNKNOWN = "und"
# letters stay (ASCII in lower case, all bytes of other characters); the rest is a blank
NORMAL = np.full(256, 0x20, np.uint8)
NORMAL[0x61:0x7B] = np.arange(0x61, 0x7B)
NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
NORMAL[0x80:] = np.arange(0x80, 0x100)


def features(data: np.ndarray) -> list[np.ndarray]:
    """Per n-gram length the bucket of each place's n-gram (one run of texts)."""
    b = data.astype(np.uint32)
    out, code = [], b
    for n in range(2, max(GRAMS) + 1):
        code = (code[:-1] << np.uint32(8)) | b[n - 1:]
        if n in GRAMS:
            h = (code + np.uint32(n << 28)) * np.uint32(2654435761)
            out.append((h >> np.uint32(32 - 15)).astype(np.int32))
    return out


def runs(arr: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bytes]]:
    """(first and last document, normalised bytes, bounds, bytes); a blank ends each text."""
    data_all, off_all = bytes_of(arr)
    for i, j in doc_runs(off_all, 1 << 18):
        off = off_all[i:j + 1] - off_all[i]
        raw = data_all[off_all[i]:off_all[j]]
        yield i, j, NORMAL[raw], off, raw


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all labelled rows; each task sums up its own first."""
    small_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for i, _, data, off, _ in runs(b.column(1)):
                for n, f in zip(GRAMS, features(data)):
                    for d in range(len(off) - 1):
                        x, y = off[d], off[d + 1] - n + 1
                        if y > x:
                            t = total.setdefault(langs[i + d], np.zeros(BUCKETS, np.int64))
                            t += np.bincount(f[x:y], minlength=BUCKETS)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(t[at])], names=["lang", "bucket", "n"])

    return (labelled.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def codewords(n: int, most: int = MOST_BITS) -> np.ndarray:
    """One row of +1/-1 per language.  Exhaustive code (every split in two once)
    where it has at most ``most`` bits, else distinct random columns that take
    each language's row far from all others."""
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= most:
        cols = [[1 if i == 0 or i in side else -1 for i in range(n)]
                for k in range(n - 1) for side in combinations(range(1, n), k)]
        return np.array(cols, float).T
    rng, best = np.random.default_rng(7), None
    bits = max(most, int(10 * np.ceil(np.log2(n))))
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, bits))
        apart = ((bits - m @ m.T) / 2 + bits * np.eye(n)).min()
        if np.all(np.abs(m.sum(0)) < n) and (best is None or apart > best[0]):
            best = (apart, m)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray     # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray    # languages x bits, each row sums to 1


def margins(arr: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Mean weight of each text's n-grams per bit, and whether it has a letter."""
    out = np.zeros((len(arr), model.code.shape[1]))
    letter = np.zeros(len(arr), bool)
    for i, j, data, off, raw in runs(arr):
        seen = np.zeros(j - i)
        for n, f in zip(GRAMS, features(data)):
            for d in range(j - i):
                x, y = off[d], off[d + 1] - n + 1
                if y > x:
                    out[i + d] += model.weights[f[x:y]].sum(0)
                    seen[d] += y - x
        out[i:j] /= np.maximum(seen, 1)[:, None]
        ascii_letter = (data > 0x60) & (data < 0x7B)
        total = np.append(0, np.cumsum(ascii_letter))
        letter[i:j] = total[off[1:]] > total[off[:-1]]
        for d in np.flatnonzero(~letter[i:j]):
            letter[i + d] = any(c.isalpha() for c in raw[off[d]:off[d + 1]].tobytes().decode())
    return out, letter


def losses(f: np.ndarray, model: Model, scale: float = 4.0) -> np.ndarray:
    """Texts x languages: weighted logistic loss of the margins against codewords."""
    bits = np.logaddexp(0, -scale * f[:, None, :] * model.code[None, :, :])
    return (bits * model.trust[None, :, :]).sum(2)


def decode(arr: pa.Array, model: Model, sharpness: float = 8.0, close: float = 0.05):
    """(language, score, ambiguous) of each text."""
    f, letter = margins(arr, model)
    if not model.langs:
        return [UNKNOWN] * len(arr), np.zeros(len(arr)), np.zeros(len(arr), bool)
    d = losses(f, model)
    e = np.exp(-sharpness * (d - d.min(1, keepdims=True)))
    best = d.argmin(1)
    score = np.where(letter, 1 / e.sum(1), 0.0)
    near = np.sort(d, 1)
    unsure = (near[:, 1] - near[:, 0] < close) if d.shape[1] > 1 else np.zeros(len(d), bool)
    return ([model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letter)], score,
            unsure | ~letter)


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, smooth: float = 0.5) -> Model:
    """Fit on ``labelled`` (text, lang).  The driver gets BUCKETS numbers a language."""
    labelled = labelled.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    rows = gram_counts(labelled).collect()
    langs = sorted({r["lang"] for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    counts = np.full((len(langs), BUCKETS), smooth)
    for r in rows:
        counts[at[r["lang"]], r["bucket"]] += r["n"]
    p = counts / counts.sum(1, keepdims=True) if len(langs) else counts
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        if (code[:, b] < 0).any():
            weights[:, b] = np.log(p[code[:, b] > 0].mean(0) / p[code[:, b] < 0].mean(0))
    model = Model(langs, code, weights, np.ones(code.shape) / code.shape[1])
    if len(langs) < 2:
        return model
    n = labelled.count()
    share = min(1.0, sample_rows / max(n, 1))
    some = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(code.shape, np.int64)
        seen = np.zeros(len(langs), np.int64)
        for b in batches:
            f, _ = margins(b.column(0), shared.value)
            for lang, row in zip(b.column(1).to_pylist(), f):
                right[at[lang]] += row * code[at[lang]] > 0
                seen[at[lang]] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(langs))), pa.array(seen), pa.array(right.tolist())],
            names=["lang", "seen", "right"])

    done = some.mapInArrow(check, "lang long, seen long, right array<long>").groupBy("lang").agg(
        F.sum("seen").alias("seen"),
        *[F.sum(F.col("right")[b]).alias(f"b{b}") for b in range(code.shape[1])]).collect()
    for r in done:
        good = np.array([r[f"b{b}"] for b in range(code.shape[1])], float)
        trust = (good + 1) / (r["seen"] + 2)
        model.trust[r["lang"]] = trust / trust.sum()
    return model


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()),
                       T.StructField("score", T.DoubleType()),
                       T.StructField("ambiguous", T.BooleanType())])


def predict(docs: DataFrame, model: Model, text: str = "text",
            drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(arr: pa.Array) -> list[pa.Array]:
        lang, score, unsure = decode(arr, shared.value)
        return [pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)]

    return append_columns(docs, text, fn, FIELDS, drop)


def held_out() -> F.Column:
    """The contract's fold: crc32(doc_id as text) mod 4 is 2 (a null id is not)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model,
                   drop=("text",))


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, own columns only.  A text
    without a letter has none; where no row has a lang to learn from, every text with a
    letter stays, as nothing tells its language apart."""
    model = train(docs.where(~held_out()))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    if not model.langs:
        model = Model(["unknown language"], np.ones((1, 1)), np.zeros((BUCKETS, 1), np.float32),
                      np.ones((1, 1)))
    found = predict(docs.select(own, F.col("text").alias("__text")), model, "__text")
    return found.where(F.col("lang_pred") != UNKNOWN).select("__doc.*")
