"""Token-id files in ascending doc_id order, each shard compressed by a Re-Pair grammar with random access by token.

A shard holds up to `shard_tokens` ids of consecutive documents (one longer document stands alone). Rounds replace pairs by nonterminals, in
every place where a pair is more frequent than the two that overlap it, until no pair of a shard occurs twice. No pair holds the
end id, so no symbol spans two documents. Expansion lengths of nonterminals, and the token at every MARK-th symbol, lead a reader to any
range of tokens without expanding what lies beside it. A task writes one file, named for itself, with its shards one after the other in the
shared folder; only those that the manifest table lists count, so a task that ran twice leaves no double.

Shard: magic, 8 bytes of header length, a JSON header (counts, sections with dtype and place), then the sections: doc_id, known (0 where doc_id is
null), tokens (end of each document), alphabet (ids of the first symbols), rules (pairs), sizes (tokens of each nonterminal), marks, sequence (symbols).

Null or empty text is the end id alone. Null doc_ids come first, repeated ones by text; an empty table has no shard. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import column, encoder, materialise, shared_dir, slices

MAGIC = b"RPSHARD2"
MARK = 1024
MAX_TASKS = 50_000
MANIFEST = "file string, offset long, bytes long, task int, shard int, docs long, tokens long, symbols long"


# ---- grammar --------------------------------------------------------------------------------------------------


def _grouped(left: np.ndarray, right: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by their pair, and how many each pair has. Pair and place share one 64-bit key where they fit."""
    wide, deep = int(symbols).bit_length(), int(at[-1]).bit_length()
    if 2 * wide + deep <= 64:
        key = (left.astype(np.uint64) << np.uint64(wide + deep)) | (right.astype(np.uint64) << np.uint64(deep)) | at.astype(np.uint64)
        key.sort()
        pair, at = key >> np.uint64(deep), (key & np.uint64((1 << deep) - 1)).astype(np.int64)
        new = pair[1:] != pair[:-1]
    else:
        order = np.lexsort((right, left))
        left, right, at = left[order], right[order], at[order]
        new = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    return at, np.diff(np.flatnonzero(np.concatenate(([True], new))), append=len(at))


def compress(ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, rules (left, right), expansion length of each rule, and the first nonterminal.

    The sequence is a linked list of places. A pair that occurs once can only repeat after one of its symbols was replaced, so every round
    looks only at places whose pair repeats or is new.
    """
    n, first = len(ids), int(ids.max(initial=0)) + 1
    kind = np.int32 if max(first, n) < 1 << 30 else np.int64  # a rule takes a place away at least, so symbols stay below first + n
    seq = np.append(ids, end_id).astype(kind)  # place n stands for what is before the first and behind the last
    after, before = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind)
    after[n], before[0] = n, n
    live = np.zeros(n + 1, bool)
    live[:n] = (seq[:-1] != end_id) & (seq[1:] != end_id)
    rank = np.zeros(n + 1, np.int32)
    rules, sizes, made = [np.zeros((0, 2), np.int64)], np.ones(first, np.int64), 0
    while len(at := np.flatnonzero(live)):
        left, right = seq[at], seq[after[at]]
        twin = np.flatnonzero(left == right)
        if len(twin):  # in a run of one symbol every second pair counts
            place = at[twin]
            fresh = np.ones(len(place), bool)
            fresh[1:] = after[place[:-1]] != place[1:]
            head = np.flatnonzero(fresh)
            nth = np.arange(len(place)) - np.repeat(head, np.diff(head, append=len(place)))
            use = np.ones(len(at), bool)
            use[twin[nth % 2 == 1]] = False
            at, left, right = at[use], left[use], right[use]
        at, times = _grouped(left, right, at, first + made)
        alone = np.repeat(times == 1, times)
        live[at[alone]] = False
        at, times = at[~alone], times[times > 1]
        if not len(at):
            continue
        kinds = np.sort((times.astype(np.uint64) << np.uint64(32)) | np.arange(len(times), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
        order = np.empty(len(times), np.int32)
        order[kinds.astype(np.int64)] = np.arange(1, len(times) + 1)
        heads = at[np.cumsum(times) - times]
        rank[at] = np.repeat(order, times)
        at = np.flatnonzero(rank)
        mine = rank[at]
        won = (rank[before[at]] < mine) & (rank[after[at]] < mine)
        rank[at] = 0
        at, mine = at[won], mine[won]
        chosen = np.bincount(mine, minlength=len(times) + 1) > 1  # a pair that won one place alone waits
        won = chosen[mine]
        at, mine = at[won], mine[won]
        number = np.cumsum(chosen[::-1], dtype=kind)[::-1] - 1  # most frequent pairs first
        heads = heads[chosen[order]]
        rule = np.empty((len(heads), 2), np.int64)
        place = number[order[chosen[order]]]
        rule[place, 0], rule[place, 1] = seq[heads], seq[after[heads]]
        rules.append(rule)
        sizes = np.concatenate((sizes, sizes[rule].sum(axis=1)))
        gone = after[at]
        seq[at] = (first + made + number)[mine]
        made += len(rule)
        live[gone] = False
        behind = after[gone]
        after[at] = behind
        before[behind] = at
        before[0] = n
        seq[gone] = -1
        ahead = before[at]
        live[at] = seq[behind] != end_id
        live[ahead] = seq[ahead] != end_id
    return seq[:n][seq[:n] >= 0].astype(np.uint32), np.concatenate(rules).astype(np.uint32), sizes[first:], first


def expand(symbols: np.ndarray, rules: np.ndarray, sizes: np.ndarray, first: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids lo to hi - 1 of what symbols stand for: every pass opens the nonterminals that are left, and passes over those outside."""
    symbols = symbols.astype(np.int64)
    size = np.concatenate((np.ones(1, np.int64), sizes.astype(np.int64)))  # of terminals, then of each rule

    def length(x: np.ndarray) -> np.ndarray:
        return size[np.maximum(x - first + 1, 0)]

    n = length(symbols)
    start = np.cumsum(n) - n
    hi = int(n.sum()) if hi is None else hi
    out = np.empty(max(hi - lo, 0), np.uint32)
    clipped = lo > 0 or hi < int(n.sum())
    rules = rules.astype(np.int64)
    while len(symbols):
        if clipped:
            inside = np.flatnonzero((start < hi) & (start + length(symbols) > lo))
            symbols, start = symbols[inside], start[inside]
        last, more = np.flatnonzero(symbols < first), np.flatnonzero(symbols >= first)
        out[start[last] - lo] = symbols[last]
        pair, start = rules[symbols[more] - first], start[more]
        symbols, start = pair.T.reshape(-1), np.concatenate((start, start + length(pair[:, 0])))
    return out


# ---- files ----------------------------------------------------------------------------------------------------


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype("<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def pack_shard(doc_id: np.ndarray, known: np.ndarray, ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[bytes, int]:
    known_ids = np.zeros(int(ids.max()) + 1, bool)
    known_ids[ids] = True
    alphabet = np.flatnonzero(known_ids)  # symbols start with the shard's own ids, so that most fit in two bytes
    number = np.cumsum(known_ids) - 1
    seq, rules, sizes, first = compress(number[ids], int(number[end_id]))
    each = np.concatenate((np.ones(1, np.int64), sizes))[np.maximum(seq.astype(np.int64) - first + 1, 0)]
    marks = (np.cumsum(each) - each)[::MARK]
    parts = {"doc_id": doc_id.astype("<i8"), "known": known.astype("u1"), "tokens": ends.astype("<u8"), "alphabet": _narrow(alphabet), "rules": _narrow(rules).reshape(-1), "sizes": _narrow(sizes), "marks": marks.astype("<u8"), "sequence": _narrow(seq)}
    header, place = {"first": first, "sections": {}}, 0
    for name, x in parts.items():
        header["sections"][name] = [x.dtype.str, place, len(x)]
        place += x.nbytes
    head = json.dumps(header).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(x.tobytes() for x in parts.values()), len(seq)


class Shard:
    """Random access to the tokens of a shard in a file: only the symbols that hold the tokens asked for are read and expanded."""

    def __init__(self, uri: str, offset: int = 0):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        start = self.file.read_at(16, offset)
        if start[:8] != MAGIC:
            raise ValueError(f"{uri} has no shard at {offset}")
        size = int.from_bytes(start[8:], "little")
        self.header, self.base = json.loads(self.file.read_at(size, offset + 16)), offset + 16 + size
        self.first = self.header["first"]
        self.doc_id, self.known, self.tokens, self.alphabet, self.sizes, self.marks = (self.section(x) for x in ("doc_id", "known", "tokens", "alphabet", "sizes", "marks"))
        self.rules = self.section("rules").reshape(-1, 2)

    def section(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        kind, place, n = self.header["sections"][name]
        kind, hi = np.dtype(kind), n if hi is None else min(hi, n)
        return np.frombuffer(self.file.read_at((hi - lo) * kind.itemsize, self.base + place + lo * kind.itemsize), kind)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids of tokens lo to hi - 1 of the shard."""
        if lo >= hi:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.marks, lo, "right")) - 1
        b = int(np.searchsorted(self.marks, hi, "left"))
        base = int(self.marks[a])
        return self.alphabet[expand(self.section("sequence", a * MARK, b * MARK), self.rules, self.sizes, self.first, lo - base, hi - base)]

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_tokens: int = 1 << 18) -> DataFrame:
    """Write all documents in ascending doc_id order; the manifest, one row per shard, tasks and shards in that order."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "token-shards")
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    parts = max(source.rdd.getNumPartitions(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        name = f"shards-{task:06d}-{uuid.uuid4().hex}.rps"
        held: list[tuple[np.ndarray, ...]] = []
        shard = size = at = 0
        out = None

        def flush() -> pa.RecordBatch:
            nonlocal size, shard, out, at
            doc_id, known, ids, of = (np.concatenate(x) for x in zip(*held))
            blob, symbols = pack_shard(doc_id, known, ids, np.cumsum(of), end_id)
            out = out or system.open_output_stream(f"{root}/{name}")
            out.write(blob)
            row = [[f"{folder}/{name}"], [at], [len(blob)], [task], [shard], [len(of)], [len(ids)], [symbols]]
            held.clear()
            size, shard, at = 0, shard + 1, at + len(blob)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["file", "offset", "bytes", "task", "shard", "docs", "tokens", "symbols"])

        for batch in slices(batches):
            ids, ends = encode.encode(column(batch, "text"))
            col = column(batch, "doc_id").cast(pa.int64())
            held.append((col.fill_null(0).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False), np.insert(ids, ends, end_id), np.diff(ends, prepend=0) + 1))
            size += len(held[-1][2])
            if size >= shard_tokens:
                yield flush()
        if held:
            yield flush()
        if out:
            out.close()

    order = (F.col("doc_id").asc_nulls_first(), "hash")  # with the hash, rows of one id, or of none, are dealt to many tasks
    ordered = source.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return materialise(ordered.mapInArrow(run, MANIFEST), "shard-manifest")


def starts(manifest: DataFrame, block: int = 1024) -> DataFrame:
    """The manifest with the ids before each shard: prefix sums within tasks, over tasks of a block, and over blocks."""
    to = (Window.unboundedPreceding, -1)
    tasks = manifest.groupBy("task").agg(F.sum("tokens").alias("n")).withColumn("block", F.floor(F.col("task") / block))
    blocks = tasks.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.sum("n").over(Window.orderBy("block").rowsBetween(*to)).alias("b"))
    tasks = tasks.withColumn("t", F.sum("n").over(Window.partitionBy("block").orderBy("task").rowsBetween(*to))).join(blocks, "block").select("task", "b", "t")
    within = manifest.withColumn("s", F.sum("tokens").over(Window.partitionBy("task").orderBy("shard").rowsBetween(*to)))
    zero = F.lit(0)
    return within.join(tasks, "task").select("file", "offset", (F.coalesce("b", zero) + F.coalesce("t", zero) + F.coalesce("s", zero)).alias("start"))


def read(manifest: DataFrame, docs_at_once: int = 4096) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, offset, start in zip(*(column(batch, x).to_pylist() for x in ("file", "offset", "start"))):
                shard = Shard(uri, offset)
                ends = shard.tokens.astype(np.int64)
                for lo in range(0, len(ends), docs_at_once):
                    hi = min(lo + docs_at_once, len(ends))
                    before = int(ends[lo - 1]) if lo else 0
                    ids = shard.ids(before, int(ends[hi - 1])).astype("<u4").tobytes()
                    cut = np.concatenate(([before], ends[lo:hi]))
                    edge = (4 * (cut - before)).tolist()
                    crc = [zlib.crc32(memoryview(ids)[a:b]) for a, b in zip(edge, edge[1:])]
                    doc_id = pa.array(shard.doc_id[lo:hi], mask=shard.known[lo:hi] == 0)
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(start + cut[:-1]), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    tasks = max(1, min(-(-manifest.count() // 4), MAX_TASKS))  # named, else Spark would merge these short rows into few tasks
    return starts(manifest).repartition(tasks, "file", "offset").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
