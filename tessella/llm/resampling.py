"""Importance resampling: the ratio of two hashed n-gram models, target and raw text, sampled by Gumbel top-k.

The target model is fitted on the documents labelled of quality 1 and not toxic (at most `max_target` of them, by a hash of doc_id),
the raw model on all documents. A text's log weight is the sum over its words and word pairs of the log of the ratio. Both counts
are smoothed by `smoothing` n-grams of the raw model, so a rare n-gram weighs little. The sample is the k = ceil(keep * rows) largest
log weight + Gumbel noise, which draws without replacement in proportion to the weights. Noise comes from a hash of doc_id
and seed. The k-th largest key is found by counting, never by a sort into one task.

Null or empty text has log weight 0. A null doc_id takes part with the noise of null. Ties at the threshold go to smaller
doc_ids, repeated rows in any order. Without labels every weight is 0 and the sample is uniform.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import LOWER, column, materialise, mix, slices, span_hashes, text_bytes

BITS = 20
WORD = np.zeros(256, bool)  # letters, digits and all that isn't ASCII
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _ngrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word and word pair."""
    raw, at = text_bytes(col)
    word = np.zeros(len(raw) + 1, bool)
    word[:-1] = WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | edge))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge[1:])) + 1
    row = np.searchsorted(at, starts, "right") - 1
    h = span_hashes(LOWER[raw], starts, ends)
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[row[:-1] == row[1:]]
    shift = np.uint64(64 - BITS)
    return (np.concatenate((h, pair)) >> shift).astype(np.int64), np.concatenate((row, row[:-1][row[:-1] == row[1:]]))


def target_ids(labels: DataFrame, max_target: int = 100_000) -> DataFrame:
    """doc_ids all of whose labels say quality 1 and not toxic; at most about max_target, so that they can be broadcast."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")
    n = good.count()
    if n > max_target:
        good = good.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(max_target / n * (1 << 20)))
    return good.withColumn("target", F.lit(True))


def log_ratio(docs: DataFrame, labels: DataFrame, max_target: int = 100_000, smoothing: float = 5.0) -> np.ndarray:
    marked = docs.select("doc_id", "text").join(F.broadcast(target_ids(labels, max_target)), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in slices(batches):
            bucket, row = _ngrams(column(batch, "text"))
            is_target = column(batch, "target").fill_null(False).to_numpy(zero_copy_only=False)
            raw += np.bincount(bucket, minlength=1 << BITS)
            target += np.bincount(bucket[is_target[row]], minlength=1 << BITS)
        at = np.flatnonzero(raw)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(raw[part]), pa.array(target[part])], names=["bucket", "raw", "target"])

    got = marked.select("text", "target").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = got["bucket"].to_numpy()
    raw[at], target[at] = got["raw"].to_numpy(), got["target"].to_numpy()
    if not target.sum():
        return np.zeros(1 << BITS, np.float32)
    expected = raw * target.sum() / raw.sum()
    return np.log((target + smoothing) / (expected + smoothing)).astype(np.float32)


def gumbel(*cols: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def weights(docs: DataFrame, ratio: np.ndarray, seed: int = 1) -> DataFrame:
    """doc_id, log_weight and key of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bucket, row = _ngrams(column(batch, "text"))
            total = np.bincount(row, weights=sent.value[bucket], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(total)], names=["doc_id", "log_weight"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, log_weight double")
    return scored.withColumn("key", F.col("log_weight") + gumbel("doc_id", F.lit(seed)))


def top_k(scored: DataFrame, k: int, bins: int = 1024) -> DataFrame:
    """The k rows of largest key, smaller doc_id first among equals. The bracket of the k-th key narrows by histograms until it holds few rows."""
    lo, hi = scored.agg(F.min("key"), F.max("key")).first()
    if k <= 0 or lo is None:
        return scored.limit(0)
    above = 0
    while lo < hi:
        width = (hi - lo) / bins
        if not width or lo + width == lo:
            break
        place = F.least(F.greatest(F.floor((F.col("key") - lo) / width), F.lit(0)), F.lit(bins - 1))
        found = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in scored.where(F.col("key").between(lo, hi)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(found, reverse=True):
            n, low, high = found[b]
            if above + n >= k:
                break
            above += n
        if (low, high) == (lo, hi):
            break
        lo, hi = low, high
    rest = k - above  # rows within [lo, hi] still to take; lo == hi but for keys nearer than a double can part
    inside = scored.where(F.col("key").between(lo, hi))
    ids = inside.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    ranked = ids.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < rest)
    taken = ranked.select("key", "doc_id", F.least("n", F.lit(rest) - F.col("before")).alias("m"))
    tied = inside.alias("x").join(taken.alias("y"), F.expr("x.doc_id <=> y.doc_id and x.key = y.key"))
    nth = F.row_number().over(Window.partitionBy("x.doc_id", "x.key").orderBy(F.lit(1)))
    return scored.where(F.col("key") > hi).unionByName(tied.withColumn("nth", nth).where("nth <= m").select("x.*"))


def resample(docs: DataFrame, labels: DataFrame, keep: float = 0.7, seed: int = 1, max_target: int = 100_000) -> DataFrame:
    """The sampled documents: doc_id, log_weight, key."""
    scored = materialise(weights(docs, log_ratio(docs, labels, max_target), seed), "resampling-keys")
    return top_k(scored, math.ceil(keep * scored.count()))
