"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

The file's splitting pattern never joins a character that isn't white space
to a following one that is, so a text's ids are those of its chunks (a run of
spaces and line feeds with what follows it) one after another.  Chunks seen
before are looked up by a 128-bit hash; the library encodes the others.  A
text with other white space, or with a special token's string, goes to the
library as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import bytes_of, doc_runs
from .words import LETTERS, TWIN, word_hashes

#: Chunks that a worker remembers; beyond, it starts afresh (memory only).
REMEMBERED = 1_000_000
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x0A]] = True
#: ASCII white space other than the two above, and lead bytes of other white space.
ODD = np.zeros(256, bool)
ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xE1, 0xE2, 0xE3]] = True


class Seen:
    """An open-addressing table from 128-bit hashes to entry numbers."""

    def __init__(self, most: int):
        self.most, self.mask = most, (1 << (most * 2 - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(self.mask + 1, -1, np.int32)
        self.a, self.b, self.n = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), 0

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 where there is none."""
        out = np.full(len(a), -1, np.int32)
        todo, at = np.arange(len(a)), (a & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            e = self.slot[at]
            hit = (e >= 0) & (self.a[e] == a[todo]) & (self.b[e] == b[todo])
            out[todo[hit]] = e[hit]
            go = (e >= 0) & ~hit
            todo, at = todo[go], (at[go] + 1) & self.mask
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> int:
        """Add new, distinct hashes; returns the number of the first."""
        first, m = self.n, len(a)
        if first + m > len(self.a):
            size = max(2 * len(self.a), first + m)
            self.a, self.b = np.resize(self.a, size), np.resize(self.b, size)
        self.a[first:first + m], self.b[first:first + m] = a, b
        todo, at = np.arange(m), (a & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free] + first
            lost = self.slot[at] != todo + first
            todo, at = todo[lost], (at[lost] + 1) & self.mask
        self.n += m
        return first


def chunk_bounds(data: np.ndarray, off: np.ndarray, blank: np.ndarray):
    """Starts and ends of the chunks, and each document's bounds among them."""
    w = blank[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    first[begins] = True
    st = np.flatnonzero(first)
    return st, np.append(st[1:], len(data)), np.searchsorted(st, off)


class Chunks:
    """Per chunk of text a run of numbers, worked out once for each chunk seen.

    ``work`` gets new chunks (bytes) and returns runs, flat, their lengths, and
    the chunks' places in the order of the runs.
    """

    def __init__(self, work: Callable[[list[bytes]], tuple], dtype, most: int = REMEMBERED):
        self.work, self.seen, self.dtype = work, Seen(most), dtype
        self.forget()

    def forget(self) -> None:
        self.seen.clear()
        self.pool, self.used = np.zeros(1 << 18, self.dtype), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def entries(self, data: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
        a, b = word_hashes(data, st, en, LETTERS), word_hashes(data, st, en, TWIN)
        e = self.seen.find(a, b)
        lack = np.flatnonzero(e < 0)
        if len(lack):
            _, pick, back = np.unique(a[lack], return_index=True, return_inverse=True)
            if (b[lack[pick]][back] != b[lack]).any():  # equal in one hash alone
                pick, back = np.arange(len(lack)), np.arange(len(lack))
            new = lack[pick]
            if self.seen.n + len(new) > self.seen.most and self.seen.n:
                self.forget()
                return self.entries(data, st, en)
            raw = data.tobytes()
            flat, size, order = self.work([raw[x:y] for x, y in zip(st[new].tolist(),
                                                                    en[new].tolist())])
            first = self.seen.add(a[new], b[new])
            last = first + len(new)
            if last > len(self.start):
                n = max(2 * len(self.start), last)
                self.start, self.size = np.resize(self.start, n), np.resize(self.size, n)
            if self.used + len(flat) > len(self.pool):
                self.pool = np.resize(self.pool, max(2 * len(self.pool), self.used + len(flat)))
            self.pool[self.used:self.used + len(flat)] = flat
            self.size[first + order] = size
            self.start[first + order] = self.used + np.cumsum(size) - size
            self.used += len(flat)
            e[lack] = first + back
        return e

    def of(self, data: np.ndarray, st: np.ndarray, en: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
        """All runs of the chunks, one after another, and their lengths; in portions
        that fit the memory even if all their chunks are new and distinct."""
        most, got = self.seen.most, []
        for k in range(0, max(len(st), 1), most):
            s, t = st[k:k + most], en[k:k + most]
            lo, hi = (int(s[0]), int(t[-1])) if len(s) else (0, 0)
            got.append(self.runs(self.entries(data[lo:hi], s - lo, t - lo)))
        if len(got) == 1:
            return got[0]
        return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])

    def runs(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All runs of the entries, one after another, and their lengths."""
        size = self.size[e].astype(np.int64)
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.pool[np.repeat(self.start[e] - end + size, size) + np.arange(total)], size


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([r"[^\S \n]"] + [re.escape(s) for s in special]))
        self.marks = [s[:2].encode() for s in special]
        # the bytes of each id: its string in the byte-level alphabet has one character a byte
        self.width = np.zeros(self.lib.get_vocab_size(), np.int64)
        for word, i in self.lib.get_vocab().items():
            self.width[i] = len(word)
        self.chunks = Chunks(self._new, np.uint32)

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New chunks in few calls of the library: those that begin with a blank
        and don't end in one split again where they were joined."""
        joined = [i for i, w in enumerate(words) if w[0] in b" \n" and w[-1] not in b" \n"]
        alone = sorted(set(range(len(words))) - set(joined))
        flat, sizes = [], []
        for k in range(0, len(joined), 4000):
            some = [words[i] for i in joined[k:k + 4000]]
            got = np.array(self.lib.encode_batch_fast([b"".join(some).decode()],
                                                      add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64))
            flat.append(got)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.width[got]), ends) + 1, prepend=0))
        for i in alone:
            flat.append(np.array(self.lib.encode(words[i].decode(), add_special_tokens=False).ids,
                                 np.uint32))
            sizes.append([len(flat[-1])])
        return np.concatenate(flat), np.concatenate(sizes), np.array(joined + alone)

    def _odd(self, data: np.ndarray, off: np.ndarray) -> list[int]:
        """Documents that the library has to see as a whole."""
        maybe = ODD[data]
        after = np.flatnonzero(data[:-1] == 0xC2)
        maybe[after] |= np.isin(data[after + 1], (0x85, 0xA0))
        docs = set((np.searchsorted(off, np.flatnonzero(maybe), side="right") - 1).tolist())
        raw = data.tobytes()
        if any(m in raw for m in self.marks):
            docs |= {i for i in range(len(off) - 1)
                     if any(m in raw[off[i]:off[i + 1]] for m in self.marks)}
        return [i for i in sorted(docs) if self.whole.search(raw[off[i]:off[i + 1]].decode())]

    def encode(self, arr: pa.Array):
        """For runs of documents: the ids of all (uint32), and each one's bounds."""
        data_all, off_all = bytes_of(arr)
        for i, j in doc_runs(off_all):
            data = data_all[off_all[i]:off_all[j]]
            off = off_all[i:j + 1] - off_all[i]
            if not len(data):
                yield np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
                continue
            odd = self._odd(data, off)
            st, en, doc = chunk_bounds(data, off, BLANK)
            if odd:
                use = np.ones(len(st), bool)
                for d in odd:
                    use[doc[d]:doc[d + 1]] = False
                doc = np.append(0, np.cumsum(use))[doc]
                st, en = st[use], en[use]
            ids, size = self.chunks.of(data, st, en)
            at = np.append(0, np.cumsum(size))[doc]
            if odd:
                raw = data.tobytes()
                parts = [ids[at[d]:at[d + 1]] for d in range(j - i)]
                for d in odd:
                    text = raw[off[d]:off[d + 1]].decode()
                    parts[d] = np.array(self.lib.encode(text, add_special_tokens=False).ids,
                                        np.uint32)
                ids = np.concatenate(parts)
                at = np.append(0, np.cumsum([len(p) for p in parts]))
            yield ids, at


_open: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a file."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
