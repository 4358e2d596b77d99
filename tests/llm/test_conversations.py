"""Operator 13 against a plain search over edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipgraph.llm import conversations as cv

from .conftest import SF, needs_data

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SPACE = " \t\n\x0b\x0c\r"


def least_edits(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault), by memoised search."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def go(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 2:
            c, a, r = go(i, step[state], inserted + 1)
            found.append((c + 3, "I" + a, ((name[step[state]], ""), *r)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, r = go(i + 1, state, 0)
            found.append((c + 4, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                base = 3 * (fault == "truncated")
                first = role[:1]
                if first == step[state] or first == "s" and state == "":
                    c, a, r = go(i + 1, first, 0)
                    found.append((c + base, "K" + a, ((role, text), *r)))
                c, a, r = go(i + 1, step[state], 0)
                found.append((c + base + 3, "R" + a, ((name[step[state]], text), *r)))
        return min(found, default=(10 ** 9, "", ()))

    return go(0, "", 0)


def brute(rows, damage=True):
    """The query's rows for input rows in file order, a tuple per conv_id."""
    after = {}
    for conv, turn, role, text in rows:
        after.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else text
        text = "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        after[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, some in after.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faulty = set(), []
        for _, role, text in some:
            end = text.rstrip(SPACE)
            fault = ("blank" if not end else "duplicate" if (role, text) in seen
                     else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in some if t is not None}
        first = [r[:1] for _, r, _ in some]
        cost, audit, rep = least_edits(tuple(faulty))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                     *[sum(f == k for _, _, f in faulty)
                       for k in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
                     cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rep).encode()).hexdigest())
    return out


def odd_conversations():
    rnd = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "summary"]
    texts = ["Fine.", "Why?", "cut off", " \n", "", None, "Yes! \t", "é日.", "x" * 70000 + "."]
    rows = [(None, 0, "user", "Null id."), (None, 1, "assistant", "Yes."), (77, None, "user", "A."),
            (77, None, "user", "A."), (77, 4, "assistant", "B."), (78, None, None, None)]
    for conv in range(60):
        for turn in sorted(rnd.sample(range(9), rnd.randint(1, 7))):
            rows.append((conv, turn if rnd.random() > .1 else None,
                         rnd.choice(roles) if rnd.random() < .5 else roles[turn % 2],
                         rnd.choice(texts[:-1] if conv else texts)))
    return rows


@pytest.fixture
def table(spark, tmp_path):
    def make(rows, schema=SCHEMA):
        path = str(tmp_path / f"c{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.read.parquet(path)
    return make


def as_dict(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_report_is_the_cheapest_and_least(table):
    rows = odd_conversations()
    assert as_dict(cv.report(table(rows))) == brute(rows, damage=False)


@pytest.mark.parametrize("block", (1, 3, 16))
def test_pieces_of_any_size_agree(table, monkeypatch, block):
    monkeypatch.setattr(cv, "BLOCK", block)
    rows = odd_conversations() + [(500, i, "user" if i % 3 else "assistant", f"t{i % 40}.")
                                  for i in range(90)]
    got = as_dict(cv.repaired_after_damage(table(rows)))
    assert got == brute(rows)


def test_dropped_conversations_stay_listed(table):
    gone = [(c, 0) for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = [(c, t, "user", "Hi.") for c, t in gone]
    got = as_dict(cv.repaired_after_damage(table(rows).withColumn("extra", F.lit(1))))
    assert got == {c: (0,) * 6 + ("", hashlib.sha256().hexdigest()) for c, _ in gone}
    assert cv.repaired_after_damage(table([])).count() == 0


def test_repaired_rows(table):
    df = table([(1, 0, "assistant", "Hi."), (1, 1, "assistant", ""), (1, 2, "user", "Go.")])
    got = sorted(tuple(r) for r in cv.repaired(df).collect())
    assert got == [(1, 0, None, "user", "", "I"), (1, 1, 0, "assistant", "Hi.", "K"),
                   (1, 2, 2, "user", "Go.", "K"), (1, 3, None, "assistant", "", "I")]


def test_long_conversation(table):
    rnd = random.Random(5)
    rows = [(1, t, rnd.choice(["user", "assistant"]), f"{rnd.random()}" + rnd.choice([".", ""]))
            for t in range(300)] + [(2, t, ("user", "assistant")[t % 2], f"Number {t}.")
                                    for t in range(9000)]
    got = as_dict(cv.report(table(rows)))
    assert got[1] == brute(rows[:300], damage=False)[1]
    assert got[2][:6] == (0,) * 6 and got[2][6] == "K" * 9000


def test_costs_meet_at_piece_ends():
    rnd = np.random.default_rng(1)
    code, fault = rnd.integers(0, 4, 50), rnd.integers(0, 4, 50)
    whole = cv.Piece(code, fault, np.array([50])).costs(cv.AT_END[None])[0]
    unit = np.where(np.eye(4, dtype=bool), 0, cv.NEVER)
    m = cv.Piece(code[:20], fault[:20], np.array([20])).costs(unit[None])[0]
    rest = cv.Piece(code[20:], fault[20:], np.array([30])).costs(cv.AT_END[None])[0]
    assert ((m + rest).min(1) == whole).all()


@needs_data
def test_query_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").toPandas()
            .itertuples(index=False)]
    assert as_dict(cv.repaired_after_damage(df)) == brute(rows)
