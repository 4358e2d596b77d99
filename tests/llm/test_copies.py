"""Operators 2, 5, 7 and 9 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shipgraph.llm import decontam, dedup, graph, jaccard, substring

from .conftest import odd_rows


def key(r):
    return tuple((v is not None, v if v is not None else 0) for v in r)


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_exact_dedup(docs, files_per_batch):
    rows = odd_rows() + [(100 + i, f"copy {i % 3}") for i in range(60)]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = dedup.classes(docs(rows, files=4), files_per_batch).collect()
    assert len(got) == len(rows)
    seen = defaultdict(list)
    for r in got:
        seen[r["text_sha256"]].append(r)
    for text, ids in groups.items():
        rs = seen[hashlib.sha256(text.encode()).hexdigest()]
        top = max(ids, key=lambda i: (i is not None, i or 0))
        assert sorted([r["doc_id"] for r in rs], key=str) == sorted(ids, key=str)
        assert {(r["keep_id"], r["group_size"]) for r in rs} == {(top, len(ids))}
        assert [r["doc_id"] for r in rs if r["kept"]] == [top]


def test_exact_dedup_stage_keeps_columns(docs, spark):
    d = docs([(1, "a"), (2, "a"), (3, None), (4, "")], extra={"__keep": F.lit(1), "kept": F.lit("x")})
    got = dedup.drop_duplicates(d)
    assert got.columns == d.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 4]
    assert dedup.exact_duplicates(docs([])).count() == 0
    made = spark.createDataFrame([(1, "q"), (2, "q")], "doc_id long, text string")
    assert [r["doc_id"] for r in dedup.drop_duplicates(made).collect()] == [2]
    assert [r["doc_id"] for r in jaccard.drop_similar(made).collect()] == [1]


def words_of(t):
    return (t or "").lower().split()


def brute_classes(rows, t=0.8):
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
            for w in (words_of(r[1]) for r in rows)]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= t * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and both:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    return [root(i) for i in range(len(rows))], links


def near_copies(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for base in range(n):
        w = [f"t{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))]
        for c in range(rng.choice((1, 1, 2, 5))):
            v = list(w)
            for _ in range(rng.randrange(0, 5)):
                v[rng.randrange(len(v))] = f"e{rng.randrange(3000)}"
            rows.append((len(rows) * 3 + base, " ".join(v)))
    return rows


@pytest.mark.parametrize("block", [256, 6])
def test_jaccard_join(docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    hot = [f"h{i}" for i in range(120)]
    rows = near_copies(40) + [(10_000 + i, " ".join(hot[:rng.randrange(100, 121)]))
                              for i in range(40)]
    rows += [(20_000, ""), (20_001, None), (20_002, "one two"), (20_003, "One  two"),
             (20_004, "one two three")]
    rows = [(i, r[1]) for i, r in enumerate(rows)]
    got = {r["doc_id"]: r for r in jaccard.similar_documents(docs(rows)).collect()}
    root, links = brute_classes(rows)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert [got[i]["n_links"] for i in range(len(rows))] == links
    assert [got[i]["class_id"] for i in range(len(rows))] == [least[r] for r in root]
    assert sum(got[i]["kept"] for i in got) == len(least)


def test_jaccard_odd_rows(docs):
    rows = odd_rows()
    got = jaccard.similar_documents(docs(rows)).collect()
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len(set(brute_classes(rows)[0]))
    assert jaccard.similar_documents(docs([])).count() == 0
    d = docs(rows, extra={"class_id": F.lit(0), "root": F.lit("x")})
    assert jaccard.drop_similar(d).columns == d.columns


def test_pruning_bounds():
    least = jaccard.least_matches(0.8, 1e-7)
    assert least == sorted(least) and least[0] < 32 * 0.8 and least[-1] < 128 * 0.8


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(70)]  # a long path
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert {r["node"]: r["root"] for r in got} == {i: root(i) for i in linked}
    assert len(got) == len(linked)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(rows, items, k=10):
    grams = defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(k, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[a:a + n])].add(str(i))
    out = []
    for d, t in rows:
        w = WORD.findall(lower(t))
        hit, names = set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                got = grams.get(tuple(w[a:a + n]))
                if got:
                    names |= got
                    hit |= set(range(a, a + n))
        out.append((d, len(w), len(hit), len(names),
                    hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then some more words"),
         (2, "short item"), (10, None), (11, ""), (12, "Über-größe 99 Wörter"),
         (13, "quick brown fox jumps over the lazy dog and then some"), (2, "short item")]
LEAKY = [(1, "x THE quick, brown fox jumps over the lazy dog -- and then some more words y"),
         (2, "a short\nitem twice: short ITEM!"), (3, "über größe 99 wörter"), (4, None), (5, ""),
         (3, "über größe 99 wörter"), (6, "nothing to see"), (None, "short item"),
         (7, "the quick brown fox jumps over the lazy cat")]


@pytest.mark.parametrize("part_bytes", [1 << 20, 40])
def test_decontamination(docs, spark, part_bytes):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.report(docs(LEAKY), bench, part_bytes=part_bytes).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_hits(LEAKY, ITEMS), key=key)


def test_decontamination_removes(docs, spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = docs(LEAKY, extra={"items": F.lit("kept"), "n_words": F.lit(0)})
    gone = decontam.decontaminate(d, bench)
    assert gone.columns == d.columns
    assert sorted(r["doc_id"] for r in gone.collect()) == [3, 3, 4, 5, 6, 7]  # Ü stays Ü
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(d, bench, "spans").collect()}
    assert cut[1] == "x  y" and cut[2] == "a  twice: !" and cut[6] == "nothing to see"
    assert cut[7] == LEAKY[8][1] and cut[4] is None
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(d, none).count() == len(LEAKY)
    assert decontam.report(docs([]), bench).count() == 0


def brute_removal(rows):
    docs = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    seen, out = set(), []
    for d, w in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i:i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.add(g)
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("block_rows", [128, 3])
def test_substring_dedup(docs, monkeypatch, block_rows):
    monkeypatch.setattr(substring, "BLOCK_ROWS", block_rows)
    rng = random.Random(9)
    passages = [[f"p{j}w{i}" for i in range(rng.randrange(15, 60))] for j in range(6)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += [f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30))]
            p = rng.choice(passages)
            w += p[rng.randrange(0, 5):len(p) - rng.randrange(0, 5)]
        rows.append((i, " ".join(w)))
    rows += [(200, "loop the loop " * 40), (201, "loop the loop " * 12)] + odd_rows()
    got = substring.without_repeats(docs(rows, files=3)).collect()
    assert sorted((tuple(r) for r in got), key=key) == brute_removal(rows)


def test_substring_dedup_of_nothing(docs):
    assert substring.without_repeats(docs([])).count() == 0
    got = substring.without_repeats(docs([(1, "a  b")]), keep_text=True).collect()
    assert got[0]["kept_text"] == "a b"


def test_difference_cover():
    for d in range(substring.PERIOD):
        assert any((c + d) % substring.PERIOD in substring.COVER for c in substring.COVER)
