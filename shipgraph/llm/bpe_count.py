"""Operator 8: token counts by heap-and-linked-list byte-pair merging.

The pieces and their ranks come from a sentencepiece BPE file; counting is
done here: a chunk's characters are a linked list, a heap holds its adjacent
pairs by rank (then place), and the lowest-rank pair is merged until none is
left.  The count is the number of initial symbols minus the merges (a symbol
without a piece counts its UTF-8 bytes instead); no identifiers are made.
Texts are cut into chunks before each run of spaces, which no piece crosses,
and a chunk's count is kept for the next time it is seen.

Defined results: null or empty text has no tokens; repeated rows are counted
each on its own; columns of the input that carry an output name are replaced.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bytes_of, doc_runs
from .tokens import Chunks, chunk_bounds

#: The mark that stands for a space in pieces.
SPACE = "▁"
BLANK = np.zeros(256, bool)
BLANK[0x20] = True


def merged_count(word: str, rank: dict[str, int]) -> int:
    """Initial symbols minus merges of one chunk."""
    sym: list[str | None] = list(word)
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = sym[i] + sym[i + 1]
        if pair in rank:
            heap.append((rank[pair], i, pair))
    heapify(heap)
    count = n
    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if sym[i] is None or j == n or sym[i] + sym[j] != pair:
            continue
        sym[i], sym[j] = pair, None
        count -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            right = pair + sym[k]
            if right in rank:
                heappush(heap, (rank[right], i, right))
        h = before[i]
        if h >= 0:
            left = sym[h] + pair
            if left in rank:
                heappush(heap, (rank[left], h, left))
    return count + sum(len(s.encode()) - 1 for s in sym
                       if s is not None and len(s) == 1 and s not in rank)


class Counter:
    def __init__(self, path: str):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {lib.id_to_piece(i): -lib.get_score(i) for i in range(lib.get_piece_size())
                     if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)
                             or lib.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("pieces cross a space: texts can't be counted by chunks")
        self.chunks = Chunks(self._new, np.int32)

    def _new(self, words: list[bytes]):
        rank = self.rank
        n = np.fromiter((merged_count(w.decode().replace(" ", SPACE), rank) for w in words),
                        np.int32, len(words))
        return n, np.ones(len(words), np.int64), np.arange(len(words))

    def count(self, arr: pa.Array) -> np.ndarray:
        arr = arr.cast(pa.large_string()).fill_null("")
        empty = pc.equal(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False)
        arr = pc.replace_substring(arr, SPACE, " ")
        arr = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), arr,
                                          pa.scalar("", pa.large_string()))
        data_all, off_all = bytes_of(arr)
        out = np.zeros(len(arr), np.int64)
        for i, j in doc_runs(off_all):
            data = data_all[off_all[i]:off_all[j]]
            st, en, doc = chunk_bounds(data, off_all[i:j + 1] - off_all[i], BLANK)
            n, _ = self.chunks.of(data, st, en)
            total = np.append(0, np.cumsum(n))
            out[i:j] = total[doc[1:]] - total[doc[:-1]]
        out[empty] = 0
        return out


_open: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _open:
        _open[path] = Counter(path)
    return _open[path]


FIELDS = T.StructType([T.StructField("n_bytes", T.LongType()),
                       T.StructField("n_tokens", T.LongType())])


def token_counts(docs: DataFrame, model: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit."""
    def fn(arr: pa.Array) -> list[pa.Array]:
        size = pc.fill_null(pc.binary_length(arr), 0).cast(pa.int64())
        return [size, pa.array(counter(model).count(arr))]

    return append_columns(docs, text, fn, FIELDS, drop=(text,)).withColumn(
        "over_limit", F.col("n_tokens") > limit)
