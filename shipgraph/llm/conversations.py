"""Repair of conversations: the cheapest edits that make their roles alternate.

A conversation's rows stand by turn (nulls first); rows of one turn stand in
the order of the input files.  Edits are Keep (0), Rerole to user or assistant
(3), Delete (4; required for blank and duplicate rows) and Insert of an empty
row (3); a truncated row that stays adds 3.  The roles' initials become
``(s?(ua)+)?``; among the cheapest edits the ASCII-least audit wins.

A conversation may be of any length.  Rows get dense positions by a
distributed sort, and pieces of at most BLOCK rows are worked off apart:

1. Each piece's costs between the four states (nothing yet, after system,
   after user, after assistant) are a min-plus matrix by dynamic programming.
2. The matrices of a conversation, one record a piece, are folded from its end,
   so each piece knows the cost of what follows it.
3. Prefix doubling in each piece: a node is a place and a state, its
   arcs are the edits of least cost.  Nodes are ranked by the first 1, 2, 4, ...
   letters of the audits that start at them; pointers double along.  An arc
   is chosen by its letter and its target's rank, and the path from each of the
   four states is read off the doubled pointers.
4. A stream over each conversation's rows takes the path of the state it is in.
   It holds one row at a time.  SHA-256 goes through a text from its start
   to its end, so a conversation's digest is one task's work, in constant memory.

Defined cases: null role and text count as one space (so the row is blank); a
null conv_id is a conversation of its own; null turns come first and count in
no gap; a role with another initial than s, u or a can't be kept; repeated
rows are duplicates; an empty table gives an empty result; other
columns are left out.  Damage uses CRC-32 of ``conv_id:turn``, a null being one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FILE, ROW, located, small_batches, stored

#: Rows of a piece: bounds what a worker holds, never changes a result.
BLOCK = 4096
SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States: nothing yet, after system, after user, after assistant.
STATES = 4
#: The state after an inserted or re-roled row, and after two inserted ones.
NEXT = np.array([2, 2, 3, 2])
NEXT2 = NEXT[NEXT]
ROLE_OF = {2: "user", 3: "assistant"}
EDITS = "DIKR"
D, I, K, R = range(4)
COST = np.array([4, 3, 0, 3])
NEVER = 1 << 40
#: Cost of what has to be inserted at a conversation's end, by state.
AT_END = np.array([0, 6, 3, 0])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: of 20 kinds by CRC-32, 0 drops a row, 1 empties
    its text, 2 removes ``[.!?]``, 3 repeats it, 4 sets the role user."""
    rows = located(conversations)
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("__kind", F.crc32(F.concat_ws(":", *part).cast("binary")) % 20)
    text, kind = F.coalesce("text", F.lit(" ")), F.col("__kind")
    return (rows.where(kind != 0)
            .withColumn("role", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))))
            .withColumn("text", F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", ""))
                        .otherwise(text))
            .withColumn("__copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1)))
                                            .otherwise(F.array(F.lit(0)))))
            .withColumn(ROW, F.col(ROW) * 2 + F.col("__copy")).drop("__kind", "__copy"))


def _rows(conversations: DataFrame) -> DataFrame:
    return located(conversations).select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), FILE, ROW)


def numbered(rows: DataFrame) -> DataFrame:
    """The rows without their texts, with dense positions in the order of all
    conversations (pos), role code, fault and block."""
    code = F.substring("role", 1, 1)
    end = F.rtrim("text", F.lit(SPACE))
    light = rows.select(
        "conv_id", "turn", FILE, ROW,
        F.when(code == "s", 1).when(code == "u", 2).when(code == "a", 3).otherwise(0)
        .alias("code"),
        F.when(end == "", BLANK).when(~F.substring(end, -1, 1).isin(*".!?"), TRUNCATED)
        .otherwise(0).alias("own"),
        F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("digest"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), FILE, ROW]
    placed = stored(light.orderBy(*order).withColumn("__pid", F.spark_partition_id())
                    .withColumn("__at", F.monotonically_increasing_id()), "turns")
    sizes = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"),
                                        F.min("__at").alias("first"))
    shift, total = [], 0  # one row a partition
    for r in sorted(sizes.collect()):
        shift.append((r["__pid"], total - r["first"]))
        total += r["n"]
    shifts = rows.sparkSession.createDataFrame(shift or [(0, 0)], "__pid int, shift long")
    placed = placed.join(F.broadcast(shifts), "__pid").withColumn(
        "pos", F.col("__at") + F.col("shift")).drop("__pid", "__at", "shift")
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")) \
        .select("pos", F.lit(True).alias("first"))
    return (placed.join(firsts, "pos", "left")
            .withColumn("fault", F.when(F.col("own") == BLANK, BLANK)
                        .when(F.col("first").isNull(), DUPLICATE).otherwise(F.col("own")))
            .withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
            .drop("own", "digest", "first"))


class Piece:
    """Rows of several pieces, one after another: their arcs' costs, and the
    nodes' places (a piece of n rows has n + 1 places of four states)."""

    def __init__(self, code: np.ndarray, fault: np.ndarray, size: np.ndarray):
        self.code, self.size, self.n = code, size, len(code)
        self.first = np.cumsum(size) - size
        piece = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(self.n) + piece  # a row's place among all pieces' places
        self.ends = self.first + np.arange(len(size)) + size
        gone = (fault == BLANK) | (fault == DUPLICATE)
        base = np.where(gone, NEVER, np.where(fault == TRUNCATED, 3, 0))
        fits = np.stack([(code == 1) | (code == 2), code == 2, code == 3, code == 2], 1)
        self.keep = np.where(fits, base[:, None], NEVER)
        self.rerole = base + COST[R]
        self.to = np.tile(NEXT, (self.n, 1))  # the state after a kept row
        self.to[code == 1, 0] = 1

    def costs(self, end: np.ndarray) -> np.ndarray:
        """Least cost from each node, given the costs (piece, state, ...) at the pieces' ends."""
        w = np.zeros((self.n + len(self.size), *end.shape[1:]), np.int64)
        w[self.ends] = end
        order = np.argsort(-self.size, kind="stable")
        active = np.searchsorted(-self.size[order], -np.arange(self.size.max(initial=0)))
        more = (slice(None),) * 2 + (None,) * (end.ndim - 2)
        for t in range(len(active) - 1, -1, -1):
            row = self.first[order[:active[t]]] + t
            after = w[self.place[row] + 1]
            kept = after[:, NEXT]
            system = self.code[row] == 1
            kept[system, 0] = after[system, 1]
            x = np.minimum(after + COST[D], self.keep[row][more] + kept)
            x = np.minimum(x, self.rerole[row, None][more] + after[:, NEXT])
            w[self.place[row]] = np.minimum(np.minimum(x, x[:, NEXT] + COST[I]),
                                            x[:, NEXT2] + 2 * COST[I])
        return w

    def paths(self, end: np.ndarray) -> np.ndarray:
        """Per row and state at its piece's start the edits there, packed
        (inserted rows * 16 + state before the row * 4 + edit)."""
        w = self.costs(end)
        nodes, here = w.size, self.place[:, None] * STATES + np.arange(STATES)
        after = w[self.place + 1]
        ahead = (self.place[:, None] + 1) * STATES
        cost = w[self.place]
        at = np.arange(self.n)[:, None]
        target = np.stack([ahead + np.arange(STATES), self.place[:, None] * STATES + NEXT,
                           ahead + self.to, ahead + NEXT], 2)
        best = np.stack([after + COST[D], cost[:, NEXT] + COST[I], after[at, self.to] + self.keep,
                         after[:, NEXT] + self.rerole[:, None]], 2) == cost[:, :, None]
        # an arc's letter tells its target, so the least letter is the least audit
        edit = np.full(nodes, -1)
        edit[here.ravel()] = best.argmax(2).ravel()
        to = np.arange(nodes)
        to[here.ravel()] = np.take_along_axis(target, best.argmax(2)[:, :, None], 2).ravel()
        rank, far, doubled = edit + 1, (edit >= 0).astype(np.int64), [to]
        while (edit[doubled[-1]] >= 0).any():
            p = doubled[-1]
            rank = np.unique(rank * (rank.max() + 1) + rank[p], return_inverse=True)[1]
            far = far + far[p]
            doubled.append(p[p])
        chosen = np.where(best, np.arange(4) * (rank.max() + 1) + rank[target], NEVER).argmin(2)
        edit[here.ravel()] = chosen.ravel()
        far = far + far[doubled[-1]]
        start = (self.first + np.arange(len(self.size)))[:, None] * STATES + np.arange(STATES)
        start = start.ravel()  # the path from each state of each piece
        steps = far[start]
        node = np.repeat(start, steps)
        step = np.arange(len(node)) - np.repeat(np.cumsum(steps) - steps, steps)
        for k, p in enumerate(doubled):
            node = np.where(step >> k & 1, p[node], node)
        done = np.flatnonzero(edit[node] != I)  # one a row and state, in order
        inserted = np.diff(done, prepend=-1) - 1
        packed = inserted * 16 + node[done] % STATES * 4 + edit[node[done]]
        by = np.repeat(np.arange(len(start)), np.repeat(self.size, STATES))
        out = np.zeros((self.n, STATES), np.int64)
        row = np.arange(len(done)) - np.repeat(
            np.cumsum(np.repeat(self.size, STATES)) - np.repeat(self.size, STATES),
            np.repeat(self.size, STATES)) + self.first[by // STATES]
        out[row, by % STATES] = packed
        return out


def _breaks(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where a run of equal values of the columns starts."""
    found = [np.zeros(1, np.int64)]
    for c in columns:
        c = c.combine_chunks()
        found.append(pc.run_end_encode(c).run_ends.to_numpy().astype(np.int64)[:-1])
    return np.unique(np.concatenate(found))


def _whole_pieces(batches: Iterator[pa.RecordBatch], least: int = 4 * BLOCK):
    """Tables of whole pieces (equal conv_id and block), and where each starts."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= least:
            t = pa.Table.from_batches(held)
            cut = _breaks(t["conv_id"], t["block"])
            if len(cut) > 1:
                yield t.slice(0, cut[-1]), cut[:-1]
                held = t.slice(cut[-1]).to_batches()
    if sum(x.num_rows for x in held):
        t = pa.Table.from_batches(held)
        yield t, _breaks(t["conv_id"], t["block"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, st in _whole_pieces(batches):
        code, fault = (t[c].to_numpy() for c in ("code", "fault"))
        size = np.diff(st, append=t.num_rows)
        unit = np.where(np.eye(STATES, dtype=bool), 0, NEVER)
        p = Piece(code, fault, size)
        w = p.costs(np.tile(unit, (len(size), 1, 1)))[p.ends - size]
        some = t.select(["conv_id", "block"]).take(pa.array(st))
        yield from some.append_column("m", pa.array(
            list(w.reshape(len(size), -1)), pa.list_(pa.int64()))).to_batches()


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each conversation's last piece to its first: the costs after it."""
    last, cost = object(), AT_END
    for b in batches:
        ends = []
        for conv, m in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if conv != last:
                last, cost = conv, AT_END
            ends.append(cost)
            cost = (np.array(m).reshape(STATES, STATES) + cost).min(1)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(ends, pa.list_(pa.int64()))],
            names=["conv_id", "block", "after"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed edits of each row; a piece's first record holds the costs after it."""
    for t, st in _whole_pieces(batches):
        size = np.diff(st, append=t.num_rows) - 1
        end = np.array(t["after"].take(pa.array(st)).to_pylist(), np.int64).reshape(-1, STATES)
        row = np.ones(t.num_rows, bool)
        row[st] = False
        t = t.filter(pa.array(row))
        packed = Piece(t["code"].to_numpy(), t["fault"].to_numpy(), size).paths(end)
        out = t.drop_columns(["after"]).append_column(
            "edits", pa.array((packed << np.arange(0, 32, 8)).sum(1), pa.int64()))
        yield from out.to_batches()


def edits(conversations: DataFrame) -> DataFrame:
    """Per row (FILE, ROW) of ``conversations``: fault, role code and its packed
    edits for each state at its piece's start."""
    small_batches(conversations.sparkSession)
    conv = conversations.schema["conv_id"].dataType
    light = stored(numbered(_rows(conversations)), "numbered")
    key = [T.StructField("conv_id", conv), T.StructField("block", T.LongType())]
    numbers = T.ArrayType(T.LongType())
    matrices = (light.select("conv_id", "block", "pos", "code", "fault")
                .repartition("conv_id", "block").sortWithinPartitions("pos")
                .mapInArrow(_matrices, T.StructType(key + [T.StructField("m", numbers)])))
    after = (matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
             .mapInArrow(_backward, T.StructType(key + [T.StructField("after", numbers)])))
    rows = light.withColumn("after", F.lit(None).cast(numbers))
    heads = after.select(*[F.col(c) if c in after.columns else F.lit(-1 if c == "pos" else None)
                           .cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    heads = heads.fillna({"code": 0, "fault": 0})
    out = T.StructType([f for f in rows.schema if f.name != "after"]
                       + [T.StructField("edits", T.LongType())])
    return (rows.union(heads).repartition("conv_id", "block")
            .sortWithinPartitions("block", "conv_id", "pos").mapInArrow(_chosen, out))


def _together(conversations: DataFrame) -> DataFrame:
    """Each conversation's rows in order, each one's edits before its text."""
    text = _rows(conversations)
    e = stored(edits(conversations), "edits")
    none = F.lit(None)
    rows = text.select("conv_id", "turn", FILE, ROW, none.cast("long").alias("block"),
                       none.cast("int").alias("code"), none.cast("int").alias("fault"),
                       none.cast("long").alias("edits"), "role", "text")
    marks = e.select("conv_id", "turn", FILE, ROW, "block", "code", "fault", "edits",
                     none.cast("string").alias("role"), none.cast("string").alias("text"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), FILE, ROW,
             F.asc_nulls_last("block")]
    return (rows.union(marks).repartition("conv_id").sortWithinPartitions(*order)
            .drop(FILE, ROW))


def _walk(batches: Iterator[pa.RecordBatch]):
    """(conv_id, turn, code, fault, edit, role, text) of each row and each
    inserted one, and (conv_id, None) when a conversation ends."""
    conv, open_, state, block, mark = None, False, 0, None, None

    def closing():
        for s in ((2, 3) if state == 1 else (3,) if state == 2 else ()):
            yield conv, None, None, None, "I", ROLE_OF[s], ""
        yield conv, None

    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            if r[2] is not None:
                mark = r
                continue
            _, _, at, code, fault, packed, _, _ = mark
            if not open_ or r[0] != conv:
                if open_:
                    yield from closing()
                conv, open_, state, block = r[0], True, 0, None
            if at != block:
                block, entered = at, state
            x = packed >> 8 * entered & 255
            before, edit = x >> 2 & 3, x & 3
            for s in {0: (), 1: (before,), 2: (5 - before, before)}[x >> 4]:
                yield conv, None, None, None, "I", ROLE_OF[s], ""
            state = before if edit == D else int(NEXT[before])
            if edit == K and before == 0 and code == 1:
                state = 1
            yield (conv, r[1], code, fault, EDITS[edit],
                   ROLE_OF[state] if edit == R else r[6], r[7])
    if open_:
        yield from closing()


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), turn (null for inserted
    ones), role, text and edit (I, K or R)."""
    schema = T.StructType([conversations.schema["conv_id"]] + [
        T.StructField("place", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("edit", T.StringType())])
    return _together(conversations).mapInArrow(_repaired_batches(schema), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _repaired_batches(schema: T.StructType):
    arrow = _arrow(schema)

    def run(batches):
        rows, place = [], 0
        for r in _walk(batches):
            if len(r) == 2:
                place = 0
            elif r[4] != "D":
                rows.append((r[0], place, r[1], r[5], r[6], r[4]))
                place += 1
            if len(rows) >= 256:
                yield _batch(rows, arrow)
                rows = []
        if rows:
            yield _batch(rows, arrow)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


FIELDS = "gaps blank duplicate truncated illegal cost".split()
LEGAL = {(1, 2), (2, 3), (3, 2)}


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated and illegal before
    the repair, its cost and audit, and the digest of the repaired rows."""
    schema = T.StructType([conversations.schema["conv_id"]]
                          + [T.StructField(c, T.LongType()) for c in FIELDS]
                          + [T.StructField("audit", T.StringType()),
                             T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def run(batches):
        rows, new = [], True
        for r in _walk(batches):
            if new:
                n, seen, low, high, distinct = dict.fromkeys(FIELDS, 0), None, None, None, 0
                audit, digest, some, new = [], hashlib.sha256(), False, False
            if len(r) == 2:
                n["gaps"] = high - low + 1 - distinct if distinct else 0
                rows.append((r[0], *n.values(), "".join(audit), digest.hexdigest()))
                new = True
                if len(rows) >= 1000:
                    yield _batch(rows, arrow)
                    rows = []
                continue
            _, turn, code, fault, edit, role, text = r
            audit.append(edit)
            n["cost"] += int(COST[EDITS.index(edit)])
            if code is not None:  # a row of the input
                if turn is not None and turn != high:
                    distinct, high, low = distinct + 1, turn, turn if low is None else low
                if fault:
                    n[FIELDS[fault]] += 1
                    n["cost"] += 3 * (fault == TRUNCATED and edit != "D")
                n["illegal"] += seen is not None and (seen, code) not in LEGAL
                seen = code
            if edit != "D":
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
        if rows:
            yield _batch(rows, arrow)

    return _together(conversations).mapInArrow(run, schema)


def repaired_after_damage(conversations: DataFrame) -> DataFrame:
    """The report after damage for every conv_id; one that lost all rows has
    zeros, an empty audit and the digest of nothing."""
    rows = located(conversations.select("conv_id", "turn", "role", "text"))
    found = report(damaged(rows)).withColumnRenamed("conv_id", "__id")
    ids = rows.select("conv_id").distinct()
    empty = hashlib.sha256().hexdigest()
    return (ids.join(found, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
            .fillna(0, FIELDS).fillna({"audit": "", "repaired_sha256": empty}))
