"""N-gram Jaccard join with several global token orders: exact links and components of near copies.

A document's set holds its distinct `k`-word shingles (all words as one, if fewer), each known by 128 bits in two halves. The first half is the token
by which candidates are found; sets are told apart, and links decided, by both. Two documents link when their sets'
Jaccard similarity is at least `percent` / 100. Linked sets share a token among the first s - ceil(percent * s / 100) + 1 of each, in every global order.
Two orders put frequent tokens last (classes from a fixed-size table of counts over all documents, and within a class a hash of the order's
own); one is a plain hash order, known before the counts are.

Equal sets are one class, known by a 128-bit digest; candidates, prefixes and checks are of classes, and only components are of doc_ids.

1. A scan makes size, digest and prefix under the plain order of every document's set, and the table of counts, added up in rounds of FAN tables.
2. A scan emits the prefix of each class under the first order; rows meet by token, tokens of very full counters in several
   parts. The class of a token's (or part's) smallest doc_id is its pivot, as a first document is often what others were copied from. Only pairs of a
   class and its pivot are candidates, so a group of any size gives rows in proportion.
3. A candidate's shared tokens in the prefixes of the first order, and then in those of the plain order, bound its overlap. Only sets of
   candidates that both orders let pass travel to their pivot (large pivots are split); there the last order must meet too before sets are compared.
4. Components of the found links join most groups whole. Tokens whose classes still lie in several components give the pairs across components that
   sizes and places in the order allow. Pairs are bounded by both orders, less those checked before, and verified alike. No link between different
   components is lost, so components are exact.

Keys that may be frequent (a class of copies, a pivot, a label) are joined by `join_each`, which spreads them.

A null or empty text, or one without words, has no set and no link of its own. Rows that repeat a doc_id are one node with the links of each; a null
doc_id has no link and a null component. An empty table gives no rows. Only doc_id and text are read; `representatives` keeps the other columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, column, free_name, join_each, list_array, materialise, mix, run_hashes, slices, span_digests, text_bytes, word_spans

WORDS, PERCENT = 5, 80
BITS, CHUNKS = 23, 64  # of the table of counts: 8 MB of classes, whatever the input
FAN = 64  # tables added up at a time, of at most half a megabyte each
MEMBER_BITS = 26  # of the bitmap of documents that a join needs: 8 MB at most
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)  # first, plain, last
SPLIT = 256  # candidates of a pivot that one task takes; for very large pivots the root of their number
SLICE = 1 << 19  # bytes of text whose sets a task makes at a time
FULL = 1 << 16  # rows of a token counter beyond which its tokens meet in parts
FACTS = "doc_id long, th long, size int, one long, two long, plain array<int>, task int, chunk int, counts binary"
PREFIX = "token long, part int, doc_id long, one long, two long, size int, at int"
GROUPED = "token long, part int, doc_id long, one long, two long, size int, at int, p_doc long, p_one long, p_two long, p_size int, split boolean"
SETS = "p_one long, p_two long, part int, one long, two long, tokens array<long>, others array<long>"
LINKS = "a_one long, a_two long, b_one long, b_two long"
NODE, A, B = ["one", "two"], ["a_one", "a_two"], ["b_one", "b_two"]


# ---- sets -----------------------------------------------------------------------------------------------------


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingles(col: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, its second half and row of every shingle, with repeats."""
    raw, at = text_bytes(col)
    starts, ends, first = word_spans(raw, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    halves = []
    for words, base in zip(span_digests(LOWER[raw], starts, ends), BASES):
        full = run_hashes(words, k, base)
        inside = row[: len(full)] == row[k - 1 :] if len(full) else np.zeros(0, bool)
        few = np.zeros(len(short), np.uint64)
        for j in range(k):
            more = first[short] + j < first[short + 1]
            few[more] = mix(few[more] * np.uint64(base) + words[first[short][more] + j])
        halves.append(np.concatenate((full[inside], few)))
    return halves[0], halves[1], np.concatenate((row[: len(full)][inside], short))


def sets(col: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all rows, 128 bits in two halves, rising by the first within each row; and the end of each row's."""
    token, other, row = shingles(col, k)
    order = np.lexsort((token, row))
    token, other, row = token[order], other[order], row[order]
    same = np.zeros(len(token), bool)
    same[1:] = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
    apart = np.zeros(len(token), bool)
    apart[1:] = same[1:] & (other[1:] != other[:-1])
    if apart.any():  # shingles of one first half: by the second too
        order = np.lexsort((other, token, row))
        token, other, row = token[order], other[order], row[order]
        same[1:] = (token[1:] == token[:-1]) & (row[1:] == row[:-1]) & (other[1:] == other[:-1])
    return token[~same], other[~same], np.searchsorted(row[~same], np.arange(len(col)), "right")


def digests(token: np.ndarray, other: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, one from either half of its shingles, 0 of an empty one."""
    at = np.concatenate(([0], end))
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(half ^ np.uint64(x)))))[at] for half, x in zip((token, other), ORDERS)]
    one, two = ((x[1:] - x[:-1]).view(np.int64) for x in sums)
    return one, two


def common_size(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share, by both halves."""
    at = np.searchsorted(x[0], y[0])
    at[at == len(x[0])] = 0
    met = x[0][at] == y[0]
    if (x[1][at[met]] == y[1][met]).all() and len(np.unique(x[0])) == len(x[0]) and len(np.unique(y[0])) == len(y[0]):
        return int(met.sum())
    return len(set(zip(x[0].tolist(), x[1].tolist())) & set(zip(y[0].tolist(), y[1].tolist())))


def rank_keys(token: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Keys by which a global order sorts tokens: frequency class, then a hash."""
    return (classes[token >> np.uint64(64 - BITS)].astype(np.uint64) << np.uint64(58)) | (mix(token ^ np.uint64(order)) >> np.uint64(6))


def prefix_size(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return size - (percent * size + 99) // 100 + (size > 0)


def _heads(token: np.ndarray, key: np.ndarray, end: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's prefix under the order of key: tokens, their rows, and their places in the order."""
    size = np.diff(end, prepend=0)
    row = np.repeat(np.arange(len(end)), size)
    order = np.lexsort((key, row))
    at = np.arange(len(token)) - (end - size)[row]
    keep = at < prefix_size(size, percent)[row]
    return token[order][keep], row[keep], at[keep]


# ---- scans ----------------------------------------------------------------------------------------------------


def facts(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Size, digest and plain prefix (halves of the hashes) of every document's set, and each task's table of token counts in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "size", "one", "two", "plain", "task", "chunk", "counts"]
        seen = np.zeros(1 << BITS, np.uint32)
        for batch in slices(batches, limit=SLICE):
            token, other, end = sets(column(batch, "text"), k)
            np.add.at(seen, token >> np.uint64(64 - BITS), np.uint32(1))
            one, two = digests(token, other, end)
            n = batch.num_rows
            key = mix(token ^ np.uint64(ORDERS[1]))
            least, row, _ = _heads(key, key, end, percent)
            plain = list_array((least >> np.uint64(32)).astype(np.uint32).view(np.int32), np.searchsorted(row, np.arange(n), "right"), pa.int32())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "th"), pa.array(np.diff(end, prepend=0).astype(np.int32)), pa.array(one), pa.array(two), plain, *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary()))], names=names)
        if seen.any():
            blobs = [zlib.compress(x.tobytes(), 1) for x in seen.reshape(CHUNKS, -1)]
            empty = [pa.nulls(CHUNKS, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([TaskContext.get().partitionId()] * CHUNKS, pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return materialise(_hashed(docs).mapInArrow(run, FACTS), "jaccard-facts")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _added(tables: pa.Table) -> pa.Table:
    total = np.zeros((1 << BITS) // CHUNKS, np.uint64)
    for x in tables["counts"].to_pylist():
        part = zlib.decompress(x)
        total += np.frombuffer(part, "<u8" if len(part) == 8 * len(total) else "<u4")
    return pa.table({"chunk": pa.array([tables["chunk"][0].as_py()], pa.int32()), "task": pa.array([tables["task"][0].as_py() // FAN], pa.int32()), "counts": pa.array([zlib.compress(total.astype("<u8").tobytes(), 1)], pa.binary())})


def token_counts(found: DataFrame) -> np.ndarray:
    """Rows of every bucket of tokens over all documents. Tables are added in rounds of FAN, so that no task holds many."""
    tables = found.where("chunk is not null").select("chunk", "task", "counts")
    tasks = (tables.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        tables = tables.groupBy("chunk", F.floor(F.col("task") / FAN)).applyInArrow(_added, "chunk int, task int, counts binary")
        tasks = -(-tasks // FAN)
        if tasks == 1:
            break
    total = np.zeros(1 << BITS, np.float32)  # the driver holds one such table; all that is made of it is made chunk by chunk
    for r in tables.collect():  # CHUNKS short rows
        x = np.frombuffer(zlib.decompress(r["counts"]), "<u8")
        total[r["chunk"] * len(x) : (r["chunk"] + 1) * len(x)] = x
    return total


def _chunkwise(total: np.ndarray, f) -> np.ndarray:  # noqa: ANN001
    return np.concatenate([f(x.astype(np.float64)).astype(np.uint8) for x in total.reshape(CHUNKS, -1)])


def frequency_classes(total: np.ndarray) -> np.ndarray:
    """A class for each bucket of tokens: 0 within the noise of the mean, above it two with every doubling."""
    mean = float(total.mean(dtype=np.float64))
    floor = mean + 3 * mean**0.5 + 3
    return _chunkwise(total, lambda x: np.where(x <= floor, 0, np.ceil(2 * np.log2(np.maximum(x, 1) / floor))).clip(0, 63))


def parts_of(total: np.ndarray) -> np.ndarray:
    """The logarithm of the number of parts in which the tokens of each bucket meet."""
    return _chunkwise(total, lambda x: np.ceil(np.log2(np.maximum(x / FULL, 1))).clip(0, 30))


def prefixes(docs: DataFrame, classes, parts, k: int = WORDS, percent: int = PERCENT) -> DataFrame:  # noqa: ANN001
    """The prefix under the first order of every class that a task has, once a task: token, part, doc_id, digest, size, place in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[tuple[int, int]] = set()  # the digests of this task's documents
        for batch in slices(batches, limit=SLICE):
            token, other, end = sets(column(batch, "text"), k)
            one, two = digests(token, other, end)
            size = np.diff(end, prepend=0)
            new = np.zeros(len(size), bool)
            for i, key in enumerate(zip(one.tolist(), two.tolist())):
                if size[i] and key not in had:
                    had.add(key)
                    new[i] = True
            doc_id = column(batch, "doc_id").to_numpy(zero_copy_only=False)[new]
            token, size = token[np.repeat(new, size)], size[new]
            one, two, end = one[new], two[new], np.cumsum(size)
            if not len(token):
                continue
            token, row, at = _heads(token, rank_keys(token, classes.value, ORDERS[0]), end, percent)
            part = mix(one[row].view(np.uint64)) & ((np.uint64(1) << parts.value[token >> np.uint64(64 - BITS)].astype(np.uint64)) - np.uint64(1))
            out = (token.view(np.int64), part.astype(np.int32), doc_id[row], one[row], two[row], size[row].astype(np.int32), at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["token", "part", "doc_id", "one", "two", "size", "at"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREFIX)


def grouped(prefix: DataFrame, parts) -> DataFrame:  # noqa: ANN001
    """The prefix rows of tokens that two rows have (and all of tokens in parts), with the class of the token's or part's smallest doc_id. A stream over sorted rows.

    A class that several tasks had has several rows of a token; what follows counts a pair's tokens too high then, never too low.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "part", "doc_id", "one", "two", "size", "at"]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
        first: np.ndarray | None = None  # row of the token that is open
        sent = False  # whether it went out
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([column(batch, x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names])
            if first is not None:
                rows = np.concatenate((first[:, None], rows), axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
            head = np.flatnonzero(new)
            n = np.diff(head, append=len(new))
            group = np.repeat(np.arange(len(head)), n)
            split = parts.value[rows[0].view(np.uint64) >> np.uint64(64 - BITS)] > 0
            keep = (n[group] > 1) | split
            if first is not None and sent:
                keep[0], keep[1 : n[0]] = False, True
            pivot = rows[:, head[group]]
            sent = bool(keep[head[-1]]) or (len(head) == 1 and first is not None and sent)
            first = rows[:, head[-1]].copy()
            if keep.any():
                out = [*(x[keep] for x in rows), *(x[keep] for x in pivot[2:6]), split[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=[*names, "p_doc", "p_one", "p_two", "p_size", "split"])

    return materialise(prefix.repartition("token", "part").sortWithinPartitions("token", "part", "doc_id").mapInArrow(run, GROUPED), "jaccard-grouped")


# ---- candidates -----------------------------------------------------------------------------------------------


def _bound(n: str, percent: int) -> str:
    """n shared prefix tokens leave room for a link: all others in both sets lie beyond the prefix of one, the one that ends first in the order."""
    beyond = f"greatest(({percent} * a_size + 99) div 100 - 1, ({percent} * b_size + 99) div 100 - 1)"
    return f"{100 + percent} * ({n} + {beyond}) >= {percent} * (a_size + b_size)"


def _alike(percent: int, a: str = "a_size", b: str = "b_size") -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _stars(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of a class (b) and the pivot (a) of a token that they share, by the tokens shared; pivots of a token's parts meet its first pivot."""
    rows = groups.select("token", *(F.col(x).alias(y) for x, y in (("p_one", "a_one"), ("p_two", "a_two"), ("p_size", "a_size"), ("one", "b_one"), ("two", "b_two"), ("size", "b_size"))))
    pivots = groups.where("split and one = p_one and two = p_two").select("token", F.struct("p_doc", "p_one", "p_two", "p_size").alias("p")).distinct()
    least = pivots.groupBy("token").agg(F.min("p").alias("q"))
    rows = rows.unionByName(pivots.join(least, "token").select("token", *(F.col(f"{s}.p_{x}").alias(f"{t}_{x}") for s, t in (("q", "a"), ("p", "b")) for x in ("one", "two", "size"))))
    rows = rows.where("a_one <> b_one or a_two <> b_two").where(_alike(percent))
    counted = rows.groupBy(*A, "a_size", *B, "b_size").agg(F.count("*").alias("n"))
    return counted.where(_bound("n", percent)).select(*A, "a_size", *B, "b_size")


def _second(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the plain order lets pass too."""
    plain = classes.select(*NODE, "plain")
    pairs = join_each(pairs, plain.toDF(*A, "a_plain"), A).join(plain.toDF(*B, "b_plain"), B)
    return pairs.where(_bound("size(array_intersect(a_plain, b_plain)) + (size(a_plain) - size(array_distinct(a_plain)))", percent)).select(*A, *B)


def _across(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different labels that share a token and may link: by size, by position at a shared token, then by shared prefix tokens."""
    position = f"{100 + percent} * least(x.size - x.at, y.size - y.at) >= {percent} * (x.size + y.size)"
    may = f"(x.one < y.one or x.one = y.one and x.two < y.two) and x.label <> y.label and {_alike(percent, 'x.size', 'y.size')} and {position}"
    met = open_.alias("x").join(open_.alias("y"), F.expr(f"x.token = y.token and {may}"))
    pairs = met.select(*(F.col(f"{s}.{x}").alias(f"{t}_{x}") for s, t in (("x", "a"), ("y", "b")) for x in ("one", "two", "size"))).distinct()
    held = open_.groupBy(*NODE).agg(F.collect_set("token").alias("held"))
    pairs = pairs.join(held.toDF(*A, "a_held"), A).join(held.toDF(*B, "b_held"), B)
    return pairs.where(_bound("size(array_intersect(a_held, b_held))", percent)).drop("a_held", "b_held")


# ---- verification ---------------------------------------------------------------------------------------------


def _member(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << MEMBER_BITS))


def _only(docs: DataFrame, needed: DataFrame, *keys: str) -> DataFrame:
    """The rows of docs whose keys may be among those of needed, by a broadcast bitmap of fixed size: a join after it shuffles few others."""
    nth = _member(*keys) + 1  # the bitmap functions number values from 1
    maps = needed.groupBy(F.bitmap_bucket_number(nth).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(nth)).alias("_bits"))
    placed = docs.withColumns({"_bucket": F.bitmap_bucket_number(nth), "_at": F.bitmap_bit_position(nth).cast("int")}).join(F.broadcast(maps), "_bucket")
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    return placed.where(F.floor(byte / F.pow(F.lit(2), F.col("_at") % 8)) % 2 == 1).select(*docs.columns)


def _places(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id and th of a document of each class in pairs, with the (pivot, part) places its set must go to. Large pivots are split, their own set copied to each part."""
    counted = pairs.groupBy(*A).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / F.greatest(F.lit(SPLIT), F.sqrt("n"))).cast("int")).drop("n")
    spread = join_each(pairs, counted, A).select(F.col("b_one").alias("one"), F.col("b_two").alias("two"), F.struct(F.col("a_one").alias("p_one"), F.col("a_two").alias("p_two"), F.pmod(F.xxhash64(*B), F.col("parts")).cast("int").alias("part")).alias("to"))
    own = counted.select(F.col("a_one").alias("one"), F.col("a_two").alias("two"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.col("a_one").alias("p_one"), F.col("a_two").alias("p_two"), p.alias("part")))).alias("to"))
    listed = spread.unionByName(own).groupBy(*NODE).agg(F.collect_list("to").alias("places"))
    return listed.join(classes.select(*NODE, "rep", "th"), NODE).select(F.col("rep").alias("doc_id"), "th", *NODE, "places")


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, frequency, k: int = WORDS, percent: int = PERCENT) -> DataFrame:  # noqa: ANN001
    """The pairs that link: sets meet at a, the last order's prefixes are intersected, then the sets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            token, other, end = sets(column(batch, "text"), k)
            start = np.concatenate(([0], end[:-1]))
            places = column(batch, "places").to_pylist()
            one, two = (x.tolist() for x in digests(token, other, end))
            right = [a == x and b == y for a, b, x, y in zip(one, two, column(batch, "one").to_pylist(), column(batch, "two").to_pylist())]
            for lo in range(0, len(places), 64):
                rows = [(p["p_one"], p["p_two"], p["part"], i) for i in range(lo, min(lo + 64, len(places))) if right[i] for p in places[i]]
                for some in (rows[j : j + 512] for j in range(0, len(rows), 512)):
                    *to, row = zip(*some)
                    to_list = np.cumsum([end[i] - start[i] for i in row])
                    halves = [list_array(np.concatenate([half[start[i] : end[i]] for i in row]).view(np.int64), to_list, pa.int64()) for half in (token, other)]
                    own = [pa.array([x[i] for i in row], pa.int64()) for x in (one, two)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(to, (pa.int64(), pa.int64(), pa.int32()))), *own, *halves], names=["p_one", "p_two", "part", "one", "two", "tokens", "others"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequency.value

        def head(x: np.ndarray) -> np.ndarray:
            n = int(prefix_size(np.array(len(x)), percent))
            return np.sort(np.partition(rank_keys(x, table, ORDERS[2]), n - 1)[:n])

        of = own = None
        for batch in batches:
            links = []
            flat, more = (column(batch, x).values.to_numpy(zero_copy_only=False).view(np.uint64) for x in ("tokens", "others"))
            ends = column(batch, "tokens").offsets.to_numpy()
            for i, (p_one, p_two, part, one, two) in enumerate(zip(*(column(batch, x).to_pylist() for x in ("p_one", "p_two", "part", "one", "two")))):
                x = flat[ends[i] : ends[i + 1]], more[ends[i] : ends[i + 1]]
                if (one, two) == (p_one, p_two):
                    if of != (p_one, p_two, part):
                        of, own = (p_one, p_two, part), (x[0].copy(), x[1].copy(), head(x[0]))
                    continue
                if of != (p_one, p_two, part):
                    raise RuntimeError("a pivot's set is missing")
                *y, theirs = own
                n, m = len(x[0]), len(y[0])
                if n * 100 < percent * m or m * 100 < percent * n or not np.isin(theirs, head(x[0])).any():
                    continue
                both = common_size(tuple(y), x)
                if 100 * both >= percent * (n + m - both):
                    links.append((p_one, p_two, one, two))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=[*A, *B])

    places = materialise(_places(pairs, classes), "jaccard-places")
    wanted = _only(_hashed(docs).where("doc_id is not null"), places, "doc_id", "th").join(places, ["doc_id", "th"])
    sent = wanted.select("text", *NODE, "places").mapInArrow(send, SETS)
    later = F.expr("one <> p_one or two <> p_two").alias("later")
    met = sent.repartition("p_one", "p_two", "part").sortWithinPartitions("p_one", "p_two", "part", later)
    return met.mapInArrow(compare, LINKS)


# ---- components -----------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, of every node that has a link. Labels spread over links and jump to their label's label."""
    edges = materialise(links.select("a", "b").where("a <> b").union(links.select("b", "a").where("a <> b")).toDF("node", "other").distinct(), "jaccard-edges")
    labels = materialise(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "jaccard-labels")
    while True:
        near = join_each(edges, labels.withColumnRenamed("node", "other"), ["other"]).groupBy("node").agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        fresh = materialise(join_each(spread, jump, ["label"]).select("node", "old", F.least("label", "beyond").alias("label")), "jaccard-labels")
        labels = fresh.select("node", "label")
        if fresh.where("label <> old").limit(1).count() == 0:
            return labels


def near_copies(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    context = docs.sparkSession.sparkContext
    found = facts(docs, k, percent)
    total = token_counts(found)
    frequency, parts = context.broadcast(frequency_classes(total)), context.broadcast(parts_of(total))
    del total
    own = found.where("chunk is null").select("doc_id", "th", "size", "one", "two", "plain")
    first = F.min(F.struct("doc_id", "th")).alias("first")
    classes = own.where("doc_id is not null and size > 0").groupBy(*NODE).agg(first, F.first("plain").alias("plain"))
    classes = materialise(classes.select(*NODE, F.col("first.doc_id").alias("rep"), F.col("first.th").alias("th"), "plain"), "jaccard-classes")
    reps = classes.select(*NODE, "rep")

    # a doc_id with several sets ties their classes together
    several = own.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*NODE, "size")).alias("lo"), F.max(F.struct(*NODE, "size")).alias("hi")).where("lo <> hi").select("doc_id")
    tied = own.where("size > 0").select("doc_id", *NODE).join(several, "doc_id").distinct().join(reps, NODE).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    def of_docs(links: DataFrame) -> DataFrame:
        """Links of classes as links of their first documents."""
        return join_each(links, reps.toDF(*A, "a"), A).join(reps.toDF(*B, "b"), B).select("a", "b")

    groups = grouped(prefixes(docs, frequency, parts, k, percent), parts)
    stars = materialise(_stars(groups, percent), "jaccard-stars")
    pairs = materialise(_second(stars, classes, percent), "jaccard-pairs")
    links = of_docs(materialise(verify(docs, pairs, classes, frequency, k, percent), "jaccard-links")).unionByName(tied)
    labels = components(links)

    # tokens whose classes still lie in several components
    label_of = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*NODE, F.coalesce("label", "rep").alias("label"))
    placed = groups.select("token", *NODE, "size", "at").join(label_of, NODE)
    split = placed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    open_ = materialise(placed.join(split, "token", "left_semi").distinct(), "jaccard-open")
    seen = stars.select(*A, *B)
    unseen = materialise(_across(open_, percent).join(seen.union(seen.select(*B, *A)), [*A, *B], "left_anti"), "jaccard-unseen")
    rest = materialise(_second(unseen, classes, percent), "jaccard-rest")
    if rest.limit(1).count():
        labels = components(links.unionByName(of_docs(materialise(verify(docs, rest, classes, frequency, k, percent), "jaccard-links"))))
    label_of = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*NODE, F.coalesce("label", "rep").alias("component_id"))
    rows = own.select("doc_id", "size", *NODE)
    full = join_each(rows.where("doc_id is not null and size > 0"), label_of, NODE)
    bare = rows.where("doc_id is null or size = 0").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("label", "doc_id"))
    return full.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id").unionByName(bare.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id"))


def representatives(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the smallest; all columns stay. Rows without an id, or that repeat the kept id, stay too."""
    name = free_name(docs, "_gone")
    gone = near_copies(docs, k, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 4], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS c FROM w UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a WHERE r.c < l.a),
c AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
