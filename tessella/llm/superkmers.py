"""Substring dedup by super-k-mers: repeated windows of `width` words leave all but the first document.

1. A scan finds every window's minimiser, the smallest hash of its runs of `seed` words; consecutive windows that share it are one
   super-k-mer, of which only place and minimiser are kept (about one row for 20 words).
2. Minimisers seen in one document only can't hold a repeated window and are left out.
3. The rest is joined to the texts; each super-k-mer travels as one packed string to the bucket of its minimiser, where its windows are
   sorted with those of the others, and those whose words also start in a smaller doc_id are found.
4. A minimiser with over `hot` super-k-mers isn't one bucket. Its strings are found in the texts once more, where they stand, and cut again by the minimiser of another hash order, and equal strings are
   pre-aggregated to their smallest doc_id: all windows of the others are repeated. The buckets of (minimiser, next minimiser) with up to DIFFERENT * `hot`
   different strings, which one task holds, are sorted like any other, larger ones are cut once more; after LEVELS orders the key is the hash of the window itself.
5. Runs of repeated windows go back to their documents, whose covered words are removed.

Windows are judged on the input, and equal only if their words are: in a bucket, windows that a hash brings together are compared word by word. A null
text has no words; a null doc_id is larger than any other; repeated doc_ids are told apart by a hash of the text, and rows that are equal are one to steps
1 to 4, so that any number of them costs what one does, and get equal results. Texts shorter than the
window, and empty tables, pass through. Only doc_id and text are read; `deduplicate` keeps the other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import HOT_ROWS, column, free_name, join_each, materialise, mix, run_hashes, slices, span_hashes, text_bytes, word_spans

WIDTH, SEED, HOT = 50, 8, 2000
LAST = (1 << 63) - 1  # stands for a null doc_id
KMERS = "did long, th long, minimiser long, start int, n int"
PACKED = "minimiser long, did long, th long, start int, words string"
STRINGS = "key long, did long, th long, start int, n int, words string"
LEVELS = 3  # hash orders by which hot buckets are cut
DIFFERENT = 20
RUNS = "did long, th long, start int, n int"
LISTED = "did long, th long, text string, kmers array<struct<start:int,n:int,minimiser:long>>"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _runs(fresh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of runs in `at`, a new one starting where fresh is set."""
    first = np.flatnonzero(fresh)
    return first, np.diff(first, append=len(at))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select("did", F.xxhash64("text").alias("th"), "text")


def _distinct(keyed: DataFrame) -> DataFrame:
    """Each (did, th) once. Texts are shuffled only if some repeat, and copies in a task are one before."""
    repeats = keyed.groupBy("did", "th").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return materialise(keyed.dropDuplicates(["did", "th"]), "distinct-texts") if repeats else keyed


def minimisers(words: np.ndarray, width: int, seed: int, level: int = 0) -> np.ndarray:
    """The minimiser of every window of word hashes (rows not regarded), under one of LEVELS orders; beyond them the hash of the window."""
    if level > LEVELS:
        return run_hashes(words, width)
    runs = run_hashes(words, seed)
    return _sliding_min(mix(runs ^ mix(np.full(1, level, np.uint64))) if level else runs, width - seed + 1)


def _found(batch: pa.RecordBatch, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Row, minimiser, first window and windows of every super-k-mer of a batch's texts, in their order."""
    raw, at = text_bytes(column(batch, "text"))
    starts, ends, first = word_spans(raw, at)
    none = np.zeros(0, np.int64)
    if len(starts) < width:
        return none, none, none, none
    low = minimisers(span_hashes(raw, starts, ends), width, seed)
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    window = np.flatnonzero(row[: len(low)] == row[width - 1 :])
    if not len(window):
        return none, none, none, none
    low, of = low[window], row[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (of[1:] != of[:-1])
    head, n = _runs(fresh, window)
    return of[head], low[head].view(np.int64), window[head] - first[of[head]], n


def super_kmers(keyed: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Every super-k-mer of (did, th, text) rows: did, th, minimiser, first window, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, low, start, n = _found(batch, width, seed)
            if len(of):
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays([column(batch, "did").take(rows), column(batch, "th").take(rows), pa.array(low), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["did", "th", "minimiser", "start", "n"])

    return keyed.mapInArrow(run, KMERS)


def _listed(keyed: DataFrame, frequent: np.ndarray, width: int, seed: int) -> DataFrame:
    """The texts that have super-k-mers of frequent minimisers (sorted), with the list of those. They are found anew, so that no text is shuffled for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, low, start, n = _found(batch, width, seed)
            keep = frequent[np.minimum(np.searchsorted(frequent, low), len(frequent) - 1)] == low
            if not keep.any():
                continue
            rows, many = np.unique(of[keep], return_counts=True)
            kmers = pa.StructArray.from_arrays([pa.array(start[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)), pa.array(low[keep])], names=["start", "n", "minimiser"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), kmers)
            yield pa.RecordBatch.from_arrays([*(column(batch, x).take(pa.array(rows)) for x in ("did", "th", "text")), lists], names=["did", "th", "text", "kmers"])

    return keyed.mapInArrow(run, LISTED)


def _wanted(texts: DataFrame, kmers: DataFrame) -> DataFrame:
    """Texts with the list of their super-k-mers that are wanted."""
    lists = kmers.groupBy("did", "th").agg(F.collect_list(F.struct("start", "n", "minimiser")).alias("kmers"))
    return texts.join(lists, ["did", "th"])


def pack_strings(wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each wanted super-k-mer as one string of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for did, th, text, kmers in zip(*(column(batch, x).to_pylist() for x in ("did", "th", "text", "kmers"))):
                words = text.encode().split()
                for k in kmers:
                    for to, x in zip(out, (k["minimiser"], did, th, k["start"], b" ".join(words[k["start"] : k["start"] + k["n"] + width - 1]).decode())):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["minimiser", "did", "th", "start", "words"])

    return wanted.mapInArrow(run, PACKED)


def cut_strings(wanted: DataFrame, width: int, seed: int, level: int) -> DataFrame:
    """The wanted super-k-mers, cut where the minimiser of another order changes, as strings by both minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 18):
            raw, at = text_bytes(column(batch, "text"))
            starts, ends, first = word_spans(raw, at)
            low = minimisers(span_hashes(raw, starts, ends), width, seed, level)
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for before, did, th, text, kmers in zip(first.tolist(), *(column(batch, x).to_pylist() for x in ("did", "th", "text", "kmers"))):
                words = text.encode().split()
                for k in kmers:
                    own = low[before + k["start"] : before + k["start"] + k["n"]]
                    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    keys = mix(own[head] ^ mix(np.full(1, k["minimiser"], np.int64).view(np.uint64))).view(np.int64)
                    for key, s, n in zip(keys.tolist(), (head + k["start"]).tolist(), np.diff(head, append=len(own)).tolist()):
                        for to, x in zip(out, (key, did, th, s, n, b" ".join(words[s : s + n + width - 1]).decode())):
                            to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["key", "did", "th", "start", "n", "words"])

    return wanted.select("did", "th", "text", "kmers").mapInArrow(run, STRINGS)


def resolve(strings: DataFrame, width: int, seed: int, hot: int, level: int = 1) -> DataFrame:
    """Runs of repeated windows in strings that may be many to a key, or equal in any number."""
    strings = materialise(strings, "strings")
    first = materialise(strings.groupBy("key", "words").agg(F.min("did").alias("lo"), F.first("n").alias("n")).withColumn("sid", F.monotonically_increasing_id()), "first-strings")
    known = materialise(join_each(strings.drop("n"), first, ["key", "words"]).select("did", "th", "start", "n", "sid", "lo"), "known-strings")
    sized = join_each(first, first.groupBy("key").agg(F.count("*").alias("times")), ["key"])
    most = DIFFERENT * hot
    few = sized.where(F.lit(level > LEVELS) | (F.col("times") <= most)).select(F.col("key").alias("minimiser"), F.col("lo").alias("did"), F.col("sid").alias("th"), F.lit(0).alias("start"), "words")
    inside = sort_buckets(few, width)
    many = sized.where(F.col("times") > most)
    if level <= LEVELS and many.limit(1).count():
        whole = F.array(F.struct(F.lit(0).alias("start"), "n", F.col("key").alias("minimiser"))).alias("kmers")
        deeper = cut_strings(many.select(F.col("lo").alias("did"), F.col("sid").alias("th"), F.col("words").alias("text"), whole), width, seed, level + 1)
        inside = inside.unionByName(resolve(deeper, width, seed, hot, level + 1))
    inside = inside.select(F.col("th").alias("sid"), F.col("start").alias("at"), F.col("n").alias("long"))
    own = known.where("did = lo").join(inside, "sid").select("did", "th", (F.col("start") + F.col("at")).alias("start"), F.col("long").alias("n"))
    return known.where("did > lo").select("did", "th", "start", "n").unionByName(own)


def _groups(words: np.ndarray, window: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (their first words) in an order in which equal ones are neighbours, and where a new one starts. Words are numbers, equal for equal words."""
    hashed = mix(words.astype(np.uint64) + np.uint64(1))
    one = run_hashes(hashed, width)[window]
    order = np.argsort(one, kind="stable")
    edge = np.ones(len(order), bool)
    edge[1:] = one[order][1:] != one[order][:-1]
    # a hash only proposes: every window is compared with the one before
    place, same = window[order], ~edge
    for k in range(width):
        if not same.any():
            break
        at = np.flatnonzero(same)
        same[at] = words[place[at] + k] == words[place[at - 1] + k]
    if (same != ~edge).any():  # different windows of one hash: sort those hashes by their words
        for h in np.unique(one[order][~edge & ~same]):
            at = np.flatnonzero(one[order] == h)
            keys = [tuple(words[p : p + width].tolist()) for p in place[at]]
            rank = sorted(range(len(at)), key=keys.__getitem__)
            order[at] = order[at][rank]
            edge[at] = [i == 0 or keys[rank[i]] != keys[rank[i - 1]] for i in range(len(at))]
    return order, edge


def _repeated(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """Of whole buckets of packed strings, the runs of windows whose words also start in a smaller did."""
    split = pc.split_pattern(column(batch, "words"), " ")
    words = split.values.dictionary_encode().indices.to_numpy()
    first = split.offsets.to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    window = np.flatnonzero(row[: len(words) - width + 1] == row[width - 1 :])
    of = row[window]
    order, edge = _groups(words, window, width)
    did = column(batch, "did").to_numpy(zero_copy_only=False)[of]
    head, n = _runs(edge, order)
    again = np.zeros(len(order), bool)
    again[order] = did[order] > np.repeat(np.minimum.reduceat(did[order], head), n) if len(order) else False
    place = np.flatnonzero(again)
    fresh = np.ones(len(place), bool)
    fresh[1:] = (np.diff(place) != 1) | (of[place][1:] != of[place][:-1])
    head, n = _runs(fresh, place)
    rows = of[place[head]]
    start = column(batch, "start").to_numpy(zero_copy_only=False)[rows] + window[place[head]] - first[rows]
    rows = pa.array(rows)
    return pa.RecordBatch.from_arrays([column(batch, "did").take(rows), column(batch, "th").take(rows), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["did", "th", "start", "n"])


def sort_buckets(packed: DataFrame, width: int = WIDTH, strings: int = 4000) -> DataFrame:
    """Runs of repeated windows, whole minimisers at a time; a minimiser has at most HOT strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, "words"):
            key = column(batch, "minimiser").to_numpy(zero_copy_only=False)
            if size >= strings or sum(x.nbytes for x in held) > 8 << 20:
                last = column(held[-1], "minimiser")[held[-1].num_rows - 1].as_py()
                cut = int(np.argmax(key != last)) if (key != last).any() else len(key)
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < len(key):
                    yield _repeated(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width)
                    held, size = [], 0
                    batch = batch.slice(cut)
                else:
                    continue
            held.append(batch)
            size += batch.num_rows
        if held:
            yield _repeated(pa.Table.from_batches(held).combine_chunks().to_batches()[0], width)

    return packed.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(run, RUNS)


def repeated_runs(docs: DataFrame, width: int = WIDTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """did, th, start, n: runs of windows whose words also start in a document with a smaller doc_id."""
    texts = _distinct(_keyed(docs))
    kmers = materialise(super_kmers(texts, width, seed), "super-kmers")
    # counted once: what is left of the counts is small, and every later step reads it
    counted = materialise(kmers.groupBy("minimiser").agg(F.min("did").alias("lo"), F.max("did").alias("hi"), F.count("*").alias("times")).where(f"lo < hi or times > {HOT_ROWS}"), "minimisers")
    shared = counted.where("lo < hi").select("minimiser", "times")
    placed = join_each(kmers, shared, ["minimiser"], counted.select("minimiser", F.col("times").alias("_n")))
    found = sort_buckets(pack_strings(_wanted(texts, placed.where(F.col("times") <= hot)), width), width)
    # a frequent minimiser has more than `hot` super-k-mers, so these few numbers are at most one for as many
    frequent = np.sort(np.array([r[0] for r in shared.where(F.col("times") > hot).select("minimiser").collect()], np.int64))
    if not len(frequent):
        return found
    return found.unionByName(resolve(cut_strings(_listed(texts, frequent, width, seed), width, seed, 1), width, seed, hot))


def _kept(text: str, runs: list[dict] | None, width: int) -> tuple[int, int, bytes]:
    words = text.encode().split()
    if not runs:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        gone[r["start"]] += 1
        gone[r["start"] + r["n"] + width - 1] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    left = [w for w, k in zip(words, keep.tolist()) if k]
    return len(words), len(words) - len(left), b" ".join(left)


def _with_runs(docs: DataFrame, width: int, seed: int, hot: int) -> DataFrame:
    runs = repeated_runs(docs, width, seed, hot).groupBy("did", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return _keyed(docs).join(runs, ["did", "th"], "left")


def removal(docs: DataFrame, width: int = WIDTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for did, text, runs in zip(*(column(batch, x).to_pylist() for x in ("did", "text", "runs"))):
                n, removed, left = _kept(text, runs, width)
                rows.append((None if did == LAST else did, n, removed, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_runs(docs, width, seed, hot).select("did", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _clean(text: Column, runs: Column, width: int) -> Column:
    @F.pandas_udf("string")
    def clean(texts, runs):  # noqa: ANN001
        import pandas as pd

        return pd.Series([_kept(t, list(r), width)[2].decode() for t, r in zip(texts, runs)], dtype=object)

    return F.when(runs.isNull(), text).otherwise(clean(F.coalesce(text, F.lit("")), F.coalesce(runs, F.array().cast("array<struct<start:int,n:int>>"))))


def deduplicate(docs: DataFrame, width: int = WIDTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """The documents with repeated words removed; a text that loses none stays byte for byte. All columns and rows stay."""
    found, did, th = (free_name(docs, x) for x in ("_runs", "_did", "_th"))
    runs = repeated_runs(docs, width, seed, hot).groupBy(F.col("did").alias(did), F.col("th").alias(th)).agg(F.collect_list(F.struct("start", "n")).alias(found))
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == F.col(did)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(th))
    joined = docs.join(runs, same, "left")
    return joined.withColumn("text", _clean(F.col("text"), F.col(found), width)).select(*docs.columns)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
lo AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN lo USING (h) WHERE doc_id > lo),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
