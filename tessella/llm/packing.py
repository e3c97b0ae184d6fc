"""Best-fit packing planned on the length histogram: at most `capacity` counts go to the driver, documents never do.

1. Each task tokenises its documents, cuts those over `capacity` tokens into pieces (the first may be shorter), and writes
   per piece its length and its rank among the task's pieces of that length.
2. Counts per length (at most `capacity` rows) are planned on the driver by best-fit decreasing over counts: all pieces of
   one length meet one group of equally filled sequences in one step, so the plan has a few intervals per length.
3. A piece's rank within its length, its task's offset plus its own rank, finds its interval, and so its slot.

Null or empty text is one piece that holds the end id. Null and repeated doc_ids are rows like any other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import column, encoder, materialise, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts. One interval of a length's ranks: from, per_sequence, first sequence, first offset."""
    groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: ranges of sequences
    opened, rows = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        room = length
        while left:
            while room <= capacity and not groups[room]:
                room += 1
            if room > capacity:  # as many new sequences as the rest needs
                per = capacity // length
                many = -(-left // per)
                groups[capacity].append((opened, many))
                opened += many
                room = capacity
            first, many = groups[room].pop()
            per = room // length
            if left < per:
                per = left
            used = min(many, left // per)
            rows.append((length, rank, per, first, capacity - room))
            groups[room - per * length].append((first, used))
            if used < many:
                groups[room].append((first + used, many - used))
            left -= used * per
            rank += used * per
            room = length
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "from", "per", "sequence", "offset"), table.T))


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The pieces of all documents with their rank by length within their task, written and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches):
            ids, ends = encode.encode(column(batch, "text"))
            of = np.diff(ends, prepend=0) + 1
            n = -(-of // capacity)
            first = of - (n - 1) * capacity
            row = np.repeat(np.arange(len(of)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            length = np.where(piece == 0, first[row], capacity)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            base = (ends - (of - 1))[row] + start
            end = np.array([end_id], "<u4").tobytes()
            crc = np.empty(len(row), np.int64)
            for k, (b, m, last) in enumerate(zip(base.tolist(), length.tolist(), (piece == n[row] - 1).tolist())):
                part = zlib.crc32(ids[b : b + m - last].astype("<u4").tobytes())
                crc[k] = zlib.crc32(end, part) if last else part
            order = np.argsort(length, kind="stable")
            same = length[order]
            within = np.arange(len(same)) - np.searchsorted(same, same)
            rank = np.empty(len(row), np.int64)
            rank[order] = within + seen[same]
            seen += np.bincount(length, minlength=capacity + 1)
            ids_of = column(batch, "doc_id").cast(pa.int64()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [ids_of, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), task), pa.int32()), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    return materialise(docs.select("doc_id", "text").mapInArrow(run, PIECES), "pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity)
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planned.value
        width = int(p["from"].max(initial=0)) + int(max(counts.values(), default=0)) + 1
        keys = p["length"] * width + p["from"]
        for batch in batches:
            length, rank = (column(batch, x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            at = np.searchsorted(keys, length * width + rank, "right") - 1
            past = rank - p["from"][at]
            sequence = p["sequence"][at] + past // p["per"][at]
            offset = p["offset"][at] + past % p["per"][at] * length
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PLACED)
