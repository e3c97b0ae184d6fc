"""Conversation structure repair: the cheapest edits that make the roles `(s?(ua)+)?`, by a time-major NumPy tensor DP.

Turns are ordered by conversation, turn (nulls first), role and digest of the text. A turn is blank (only white space), or a duplicate (role and text of an
earlier turn of its conversation), or truncated (its last visible character ends no sentence). Keep costs 0, Rerole 2, Delete 3, Insert of an empty turn 2;
blank turns and duplicates must go; a truncated turn that stays adds 1. Roles count by their first letter, and an inserted or reroled turn takes the
one role that the letters before it allow, so a string of edits fixes the result. Of the cheapest strings the ASCII-least is taken.

1. Duplicates are found by a groupBy of (conversation, role, digest) for the first place, joined back (`join_each`: one text may fill the table).
2. All turns are sorted by range, not by hash, so that a conversation of any length spans as many tasks as it needs. Each task cuts what it has into
   blocks: the part of one conversation in a slice of text. A block is one row of the table that is written then.
3. Blocks of a slice are bucketed by length (next power of two, absent turns behind). The DP runs backwards over time, all blocks of a bucket and
   their four states (nothing yet, after s, u, a) in one NumPy step a turn; costs of every turn are kept, and the trace runs forwards, one step a turn for all.
4. A conversation in several blocks: each block gives the 4 x 4 cost matrix of its turns; the matrices, a few numbers a block, are multiplied
   (min, +) from the end, so every block knows what its last states cost. It is then traced from each of the four states, and the
   blocks are strung together in order.

The report streams a conversation of several blocks through one task, a block at a time, since its digest is sequential and its edits are one string.

Null role and text are one space; a null conv_id is a conversation of its own; repeated rows are duplicates; a conversation without present turns has
zeros, no edits and the hash of the empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import column, join_each, list_array, materialise, slices

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
CLASS, BLANK, DUPLICATE, TRUNCATED, ABSENT = 3, 4, 8, 16, 32  # bits of a turn; classes: s 0, u 1, a 2, other 3
NEXT = np.array([2, 2, 3, 2])  # the state that an inserted or reroled turn leads to, from: nothing, s, u, a
MOVE = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # by state and class of a kept turn
NAME = {2: "user", 3: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
FINAL = (0, 2 * INSERT, INSERT, 0)  # what it costs to end in each state
FAR = 1 << 40
SLICE = 1 << 18  # bytes of text of a slice; results don't depend on it
KEY = ["bare", "conv"]
BLOCKS = "bare boolean, conv long, part int, blk int, edge boolean, codes binary, turns array<long>, roles array<string>, texts array<string>"
COSTS = "bare boolean, conv long, part int, blk int, costs array<long>"
ENDS = "part int, blk int, ends array<long>"
SOLVED = "bare boolean, conv long, part int, blk int, cost long, edits array<string>, states array<int>, codes binary, turns array<long>, roles array<string>, texts array<string>"
REPORT = "bare boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "bare boolean, conv long, place long, turn long, edit string, role string, text string"


# ---- turns and blocks -----------------------------------------------------------------------------------------


def ordered_turns(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """All turns with their bits, sorted by range. Turns that aren't present only keep their conversation."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    rows = turns.select(F.isnull("conv_id").alias("bare"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), there.alias("there"))
    rows = materialise(rows.withColumns({"digest": F.sha2("text", 256), "rid": F.monotonically_increasing_id()}), "turns")
    same = [*KEY, "role", "digest"]
    first = rows.where("there").groupBy(*same).agg(F.min(F.struct(F.isnotnull("turn"), F.coalesce("turn", F.lit(0)), "rid")).alias("first"))
    known = join_each(rows.where("there"), first, same).withColumn("again", F.col("rid") != F.col("first.rid")).drop("first")
    known = known.unionByName(rows.where("not there").withColumns({"again": F.lit(False), "text": F.lit(""), "role": F.lit("")}))
    seen = F.rtrim("text", F.lit(SPACE))
    last = F.substring(seen, -1, 1)
    bits = {BLANK: seen == "", DUPLICATE: F.col("again"), TRUNCATED: ~last.isin(".", "!", "?"), ABSENT: ~F.col("there")}
    lead = F.substring("role", 1, 1)
    code = F.when(lead == "s", 0).when(lead == "u", 1).when(lead == "a", 2).otherwise(3)
    for bit, holds in bits.items():
        code = code + F.when(holds, bit).otherwise(0)
    order = [*KEY, F.asc_nulls_first("turn"), "role", "digest", "rid"]
    return known.withColumn("code", code.cast("int")).repartitionByRange(*order).sortWithinPartitions(*order).select(*KEY, "turn", "code", "role", "text")


def blocks(ordered: DataFrame, limit: int = SLICE) -> DataFrame:
    """One row for the part of a conversation in each slice; edge says whether there may be other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches, limit=limit):
            bare, conv = (column(batch, x).to_numpy(zero_copy_only=False) for x in KEY)
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = (bare[1:] != bare[:-1]) | (conv[1:] != conv[:-1])
            first = np.flatnonzero(fresh)
            n, ends = len(first), np.append(first[1:], batch.num_rows)
            code = column(batch, "code").to_numpy().astype(np.uint8).tobytes()
            edge = np.zeros(n, bool)
            edge[[0, -1]] = True
            offsets = pa.array(np.append(0, ends), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, column(batch, x)) for x in ("turn", "role", "text")]
            codes = pa.array([code[a:b] for a, b in zip(first.tolist(), ends.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bare[first], pa.bool_()), pa.array(conv[first], pa.int64()), pa.array([part] * n, pa.int32()), pa.array(np.arange(at, at + n), pa.int32()), pa.array(edge), codes, *lists], names=["bare", "conv", "part", "blk", "edge", "codes", "turns", "roles", "texts"])
            at += n

    return materialise(ordered.mapInArrow(run, BLOCKS), "dialogue-blocks")


# ---- tensor DP ------------------------------------------------------------------------------------------------


def buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Which blocks have lengths up to the same power of two."""
    power = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for p in np.unique(power):
        yield np.flatnonzero(power == p)


def time_major(codes: list[bytes]) -> np.ndarray:
    """Bits by time and block, absent turns behind the last."""
    out = np.full((max(map(len, codes)), len(codes)), ABSENT, np.int64)
    for i, x in enumerate(codes):
        out[: len(x), i] = np.frombuffer(x, np.uint8)
    return out


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs from before each turn (and from the end) on: time x block x state, given those of the end."""
    steps, n = codes.shape
    out = np.empty((steps + 1, n, 4), np.int64)
    out[steps] = ends
    for t in range(steps - 1, -1, -1):
        code, later = codes[t], out[t + 1]
        stays = ((code & (BLANK | DUPLICATE)) > 0) * FAR + ((code & TRUNCATED) > 0)
        to = MOVE[:, code & CLASS].T
        kept = np.where(to >= 0, np.take_along_axis(later, np.maximum(to, 0), 1), FAR)
        cost = np.minimum(np.minimum(kept, later[:, NEXT] + REROLE) + stays[:, None], later + DELETE)
        once = np.minimum(cost, cost[:, NEXT] + INSERT)
        twice = np.minimum(once, once[:, NEXT] + INSERT)
        out[t] = np.minimum(np.where((code & ABSENT)[:, None] > 0, later, twice), FAR)
    return out


def trace(codes: np.ndarray, costs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ASCII-least cheapest edits of every block (time x 3 x block: inserts before a turn, its edit; 0 for none) and the states at the end."""
    steps, n = codes.shape
    letters, state, rows = np.zeros((steps, 3, n), np.uint8), start.copy(), np.arange(n)
    for t in range(steps):
        code, later = codes[t], costs[t + 1]
        here = (code & ABSENT) == 0
        for j in range(2):  # D before I before K before R
            now = costs[t][rows, state]
            put = here & (later[rows, state] + DELETE != now) & (costs[t][rows, NEXT[state]] + INSERT == now)
            letters[t, j, put] = ord("I")
            state = np.where(put, NEXT[state], state)
        now = costs[t][rows, state]
        gone = here & (later[rows, state] + DELETE == now)
        to = MOVE[state, code & CLASS]
        kept = here & ~gone & (to >= 0) & ((code & (BLANK | DUPLICATE)) == 0) & (later[rows, np.maximum(to, 0)] + ((code & TRUNCATED) > 0) == now)
        other = here & ~gone & ~kept
        for mask, letter in ((gone, "D"), (kept, "K"), (other, "R")):
            letters[t, 2, mask] = ord(letter)
        state = np.where(kept, to, np.where(other, NEXT[state], state))
    return letters, state


def strings(letters: np.ndarray) -> list[str]:
    """The edits of each block as one string."""
    flat = letters.transpose(2, 0, 1).reshape(letters.shape[2], -1)
    return [x[x > 0].tobytes().decode() for x in flat]


def block_costs(rows: DataFrame) -> DataFrame:
    """The matrix of each block: what its turns cost from a state before to a state behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.full((4, 4), FAR, np.int64)
        np.fill_diagonal(ends, 0)
        for batch in batches:
            codes = column(batch, "codes").to_pylist()
            out = np.empty((len(codes), 4, 4), np.int64)
            for some in buckets(np.array(list(map(len, codes)))):
                table = time_major([codes[i] for i in some])
                for j in range(4):
                    out[some, :, j] = backward(table, np.broadcast_to(ends[j], (len(some), 4)))[0]
            flat = list_array(out.reshape(-1), np.arange(1, len(codes) + 1) * 16, pa.int64())
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in ("bare", "conv", "part", "blk")), flat], names=["bare", "conv", "part", "blk", "costs"])

    return rows.select(*KEY, "part", "blk", "codes").mapInArrow(run, COSTS)


def end_costs(costs: DataFrame) -> DataFrame:
    """What the states behind each block cost, from its conversation's last block back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, end = None, np.array(FINAL)
        for batch in batches:
            ends = []
            for bare, conv, flat in zip(*(column(batch, x).to_pylist() for x in ("bare", "conv", "costs"))):
                if (bare, conv) != key:
                    key, end = (bare, conv), np.array(FINAL)
                ends.append(end.tolist())
                end = np.minimum((np.array(flat).reshape(4, 4) + end).min(axis=1), FAR)
            yield pa.RecordBatch.from_arrays([column(batch, "part"), column(batch, "blk"), pa.array(ends, pa.list_(pa.int64()))], names=["part", "blk", "ends"])

    return costs.repartition(*KEY).sortWithinPartitions(*KEY, F.desc("part"), F.desc("blk")).mapInArrow(run, ENDS)


def solve(rows: DataFrame) -> DataFrame:
    """Edits of blocks from each of the four states, or from the first alone if `ends` is null, which says that the block is a whole conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, given = (column(batch, x).to_pylist() for x in ("codes", "ends"))
            n = len(codes)
            cost = np.zeros(n, np.int64)
            edits: list[list[str]] = [[] for _ in range(n)]
            states: list[list[int]] = [[] for _ in range(n)]
            for some in buckets(np.array(list(map(len, codes)))):
                table = time_major([codes[i] for i in some])
                costs = backward(table, np.array([given[i] or FINAL for i in some], np.int64))
                cost[some] = costs[0, :, 0]
                several = np.array([given[i] is not None for i in some])
                for start in range(4):
                    at = np.flatnonzero(several) if start else np.arange(len(some))
                    if len(at):
                        letters, state = trace(table[:, at], costs[:, at], np.full(len(at), start))
                        for i, x, s in zip(some[at].tolist(), strings(letters), state.tolist()):
                            edits[i].append(x)
                            states[i].append(s)
            made = [pa.array(cost), pa.array(edits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in ("bare", "conv", "part", "blk")), *made, *(column(batch, x) for x in ("codes", "turns", "roles", "texts"))], names=["bare", "conv", "part", "blk", "cost", "edits", "states", "codes", "turns", "roles", "texts"])

    return rows.select(*KEY, "part", "blk", "ends", "codes", "turns", "roles", "texts").mapInArrow(run, SOLVED)


def solved(turns: DataFrame, present: Column | None = None, limit: int = SLICE) -> DataFrame:
    """All blocks with their edits; the blocks of a conversation lie together, in order."""
    made = blocks(ordered_turns(turns, present), limit)
    near = made.where("edge").select(*KEY, "part", "blk", "codes").withColumn("n", F.count("*").over(Window.partitionBy(*KEY)))
    ends = materialise(end_costs(block_costs(near.where("n > 1"))), "dialogue-ends")
    alone = made.where("not edge").withColumn("ends", F.lit(None).cast("array<long>"))
    joined = made.where("edge").join(ends, ["part", "blk"], "left")
    several = solve(joined.where("ends is not null")).repartition(*KEY).sortWithinPartitions(*KEY, "part", "blk")
    return solve(alone.unionByName(joined.where("ends is null"))).unionByName(several)


# ---- results --------------------------------------------------------------------------------------------------


def edited(edits: str, state: int, turns: list, roles: list[str], texts: list[str], codes: bytes) -> Iterator[tuple]:
    """Turn, edit, role and text of every turn that is left or inserted."""
    at = 0
    for x in edits:
        if x == "I":
            state = int(NEXT[state])
            yield None, x, NAME[state], ""
            continue
        while codes[at] & ABSENT:
            at += 1
        if x == "K":
            state = int(MOVE[state, codes[at] & CLASS])
            yield turns[at], x, roles[at], texts[at]
        elif x == "R":
            state = int(NEXT[state])
            yield turns[at], x, NAME[state], texts[at]
        at += 1


def _walk(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column(batch, x).to_pylist() for x in ("bare", "conv", "cost", "edits", "states", "codes", "turns", "roles", "texts")))


def _tail(state: int) -> str:
    return "I" * (FINAL[state] // INSERT)


class _Summary:
    """What is reported of one conversation, block by block."""

    def __init__(self, cost: int):
        self.cost, self.state, self.edits, self.sha, self.lines = cost, 0, [], hashlib.sha256(), 0
        self.counts, self.before, self.low, self.high, self.different = [0, 0, 0, 0], None, None, None, 0

    def put(self, turns: Iterator[tuple]) -> None:
        for _, _, role, text in turns:
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def add(self, edits: list[str], states: list[int], codes: bytes, turns: list, roles: list, texts: list) -> None:
        which = self.state if len(edits) > 1 else 0
        self.put(edited(edits[which], self.state, turns, roles, texts, codes))
        self.edits.append(edits[which])
        self.state = states[which]
        for code, turn in zip(codes, turns):
            if code & ABSENT:
                continue
            fault = 0 if code & BLANK else 1 if code & DUPLICATE else 2 if code & TRUNCATED else None
            if fault is not None:
                self.counts[fault] += 1
            self.counts[3] += self.before is not None and (self.before, code & CLASS) not in LEGAL
            self.before = code & CLASS
            if turn is not None and turn != self.high:
                self.low, self.high, self.different = turn if self.low is None else self.low, turn, self.different + 1

    def row(self, bare: bool, conv: int) -> tuple:
        tail = _tail(self.state)
        self.put(edited(tail, self.state, [], [], [], b""))
        gaps = self.high - self.low + 1 - self.different if self.different else 0
        return (bare, conv, gaps, *self.counts, self.cost, "".join(self.edits) + tail, self.sha.hexdigest())


def report(turns: DataFrame, present: Column | None = None, limit: int = SLICE) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits) and repaired_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.bool_(), pa.int64(), *([pa.int64()] * 6), pa.string(), pa.string())
        names = ["bare", "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        key, summary, rows = None, None, []
        for batch in batches:
            for bare, conv, cost, *block in _walk(batch):
                if key != (bare, conv):
                    if summary:
                        rows.append(summary.row(*key))
                    key, summary = (bare, conv), _Summary(cost)
                summary.add(*block)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                rows = []
        if summary:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(summary.row(*key), kinds)], names=names)

    found = solved(turns, present, limit).select("bare", "conv", "cost", "edits", "states", "codes", "turns", "roles", "texts").mapInArrow(run, REPORT)
    return found.select(F.when(~F.col("bare"), F.col("conv")).alias("conv_id"), *(x for x in found.columns if x not in KEY))


def repaired(turns: DataFrame, present: Column | None = None, limit: int = SLICE) -> DataFrame:
    """The repaired conversations: conv_id, place, turn (null of an inserted one), edit (I, K or R), role and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["bare", "conv", "place", "turn", "edit", "role", "text"]
        key, state, place, rows = None, 0, 0, []

        def put(found: Iterator[tuple]) -> None:
            nonlocal place
            for x in found:
                rows.append((*key, place, *x))
                place += 1

        for batch in batches:
            for bare, conv, _, edits, states, codes, *block in _walk(batch):
                if key != (bare, conv):
                    put(edited(_tail(state), state, [], [], [], b""))
                    key, state, place = (bare, conv), 0, 0
                which = state if len(edits) > 1 else 0
                put(edited(edits[which], state, *block, codes))
                state = states[which]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                rows = []
        put(edited(_tail(state), state, [], [], [], b""))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    found = solved(turns, present, limit).select("bare", "conv", "cost", "edits", "states", "codes", "turns", "roles", "texts").mapInArrow(run, TURNS)
    return found.select(F.when(~F.col("bare"), F.col("conv")).alias("conv_id"), "place", "turn", "edit", "role", "text")


def damage(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Turns with planted faults, by crc32(`conv_id:turn`) % 20, nulls being one space; and which of them are present."""
    key = F.concat(*(F.coalesce(F.col(x).cast("string"), F.lit(" ")) if x else F.lit(":") for x in ("conv_id", "", "turn")))
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
    fault = F.crc32(key) % 20
    changed = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), changed.alias("text"), fault.alias("fault"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).drop("copy"), F.col("fault") != 0


ORACLE = r"""
WITH RECURSIVE poly AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) AS c FROM range(0, 256) r(i))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
hashed AS (SELECT keyed.*, xor(list_reduce(list_transform(range(1, octet_length(k) + 1), lambda i: ascii(chr(('0x' || substring(hex(k), 2 * i - 1, 2))::INT))::BIGINT), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS fault FROM keyed, poly),
rows0 AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, left(role, 1) AS lead, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM rows0),
facts AS (SELECT *, CASE WHEN seen = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(lead) OVER (PARTITION BY conv_id ORDER BY i) || lead AS pair FROM placed),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM facts GROUP BY conv_id),
best AS (
  SELECT conv_id, n AS i, {'c': 0, 'e': '', 'r': ''} AS z, {'c': 4, 'e': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s, {'c': 2, 'e': 'I', 'r': chr(10) || 'assistant:'} AS u, {'c': 0, 'e': '', 'r': ''} AS a FROM sums
  UNION ALL
  SELECT conv_id, i - 1, least(z, {'c': u.c + 2, 'e': 'I' || u.e, 'r': chr(10) || 'user:' || u.r}, {'c': a.c + 4, 'e': 'II' || a.e, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || a.r}),
    least(s, {'c': u.c + 2, 'e': 'I' || u.e, 'r': chr(10) || 'user:' || u.r}, {'c': a.c + 4, 'e': 'II' || a.e, 'r': chr(10) || 'user:' || chr(10) || 'assistant:' || a.r}),
    least(u, {'c': a.c + 2, 'e': 'I' || a.e, 'r': chr(10) || 'assistant:' || a.r}), least(a, {'c': u.c + 2, 'e': 'I' || u.e, 'r': chr(10) || 'user:' || u.r})
  FROM (SELECT b.conv_id, b.i,
      least({'c': z.c + 3, 'e': 'D' || z.e, 'r': z.r}, {'c': u.c + 2 + x, 'e': 'R' || u.e, 'r': chr(10) || 'user:' || f.text || u.r}, CASE f.lead WHEN 's' THEN {'c': s.c + x, 'e': 'K' || s.e, 'r': chr(10) || f.role || ':' || f.text || s.r} WHEN 'u' THEN {'c': u.c + x, 'e': 'K' || u.e, 'r': chr(10) || f.role || ':' || f.text || u.r} END) AS z,
      least({'c': s.c + 3, 'e': 'D' || s.e, 'r': s.r}, {'c': u.c + 2 + x, 'e': 'R' || u.e, 'r': chr(10) || 'user:' || f.text || u.r}, CASE f.lead WHEN 'u' THEN {'c': u.c + x, 'e': 'K' || u.e, 'r': chr(10) || f.role || ':' || f.text || u.r} END) AS s,
      least({'c': u.c + 3, 'e': 'D' || u.e, 'r': u.r}, {'c': a.c + 2 + x, 'e': 'R' || a.e, 'r': chr(10) || 'assistant:' || f.text || a.r}, CASE f.lead WHEN 'a' THEN {'c': a.c + x, 'e': 'K' || a.e, 'r': chr(10) || f.role || ':' || f.text || a.r} END) AS u,
      least({'c': a.c + 3, 'e': 'D' || a.e, 'r': a.r}, {'c': u.c + 2 + x, 'e': 'R' || u.e, 'r': chr(10) || 'user:' || f.text || u.r}, CASE f.lead WHEN 'u' THEN {'c': u.c + x, 'e': 'K' || u.e, 'r': chr(10) || f.role || ':' || f.text || u.r} END) AS a
    FROM best b JOIN (SELECT *, CASE fault WHEN 't' THEN 1 WHEN '' THEN 0 ELSE 1000000 END AS x FROM facts) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i)
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.e, '') AS audit, sha256(coalesce(z.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id AND best.i = 0
"""
