"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in numpy over a broadcast matrix.

The model learns from at most `max_rows` labelled rows (all of them below that), chosen by a hash of doc_id. A null text, or one
without a letter, is `und` with score 0. The score is the posterior of the predicted language, tempered to the weight of
`evidence` n-grams so that long texts don't all saturate. Ties go to the language that sorts first. Without any labelled row every
text is `und`. The matrix has at most MAX_CELLS cells: with more languages than fit at 2**bits buckets each (128 at 17 bits) it has fewer buckets, down to
2**LEAST_BITS, which leaves room for 262,144 languages; more are an error. Repeated rows each get their own prediction. Only doc_id, text and lang are read; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import column, free_name, mix, slices

SIZES = (1, 2, 3, 4)  # of the character n-grams
STRETCH = 1 << 17  # characters hashed at a time
BATCH = 1 << 18  # bytes of text looked at together
MAX_CELLS = 1 << 24  # languages times buckets that the broadcast matrix may have
LEAST_BITS = 6
GATHERED = 1 << 21  # cells of the matrix that a step of scoring gathers


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # float32, languages x buckets
    prior: np.ndarray


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _chars(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, the text of each, and which texts have a letter. A run without letters is one space; every text starts and ends with one."""
    lowered = [(x or "").lower() for x in texts]
    code = np.frombuffer("".join(f" {x} " for x in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, lowered), np.int64, len(texts)) + 2)
    letter = _letters()[code]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    code, row = np.where(letter, code, np.uint32(32))[keep], row[keep]
    return code, row, np.bincount(row[code != 32], minlength=len(texts)) > 0


def _ngrams(code: np.ndarray, row: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams and the text of each, rising, for one stretch of characters and one n after the other, so that few are held."""
    for lo in range(0, len(code), STRETCH):
        part, of = code[lo : lo + STRETCH + max(SIZES) - 1].astype(np.uint64), row[lo : lo + STRETCH + max(SIZES) - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(SIZES) + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + part[n - 1 :]
            if n in SIZES:
                inside = of[:m] == of[n - 1 :]
                inside[STRETCH:] = False  # the next stretch has them
                if n == 1:
                    inside &= part != 32
                yield (mix(h[inside] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int32), of[:m][inside]


def train(labelled: DataFrame, max_rows: int = 200_000, bits: int = 17, smoothing: float = 0.05) -> Model:
    """Fit on rows (doc_id, text, lang) with neither text nor lang null."""
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    found = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit((MAX_CELLS >> LEAST_BITS) + 1).collect())
    if len(found) << LEAST_BITS > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS >> LEAST_BITS} languages")
    while len(found) << bits > MAX_CELLS:
        bits -= 1
    langs, total = [x for x, _ in found], sum(n for _, n in found)
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(max_rows / total * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {x: i for i, x in enumerate(langs)}
        seen = np.zeros(len(langs) << bits, np.int64)
        for batch in slices(batches, limit=BATCH):
            of = np.fromiter((index[x] for x in column(batch, "lang").to_pylist()), np.int32, batch.num_rows) << bits
            code, row, _ = _chars(column(batch, "text").to_pylist())
            for buckets, at in _ngrams(code, row, bits):
                np.add.at(seen, of[at] + buckets, 1)
        cell = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(seen[cell])], names=["cell", "n"])

    counts = np.full(len(langs) << bits, smoothing)
    if langs:
        got = rows.select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts[got["cell"].to_numpy()] += got["n"].to_numpy()
    counts = counts.reshape(len(langs), 1 << bits)
    log_prob = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(langs, log_prob, np.log(np.array([n for _, n in found], float) / max(total, 1)))


def predict(docs: DataFrame, model: Model, *keep: str, evidence: int = 60, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns `keep` of every row with its language and score; text alone decides. Kept columns named like these two give way to them."""
    names = [x for x in dict.fromkeys(keep) if x.lower() not in (lang.lower(), score.lower())]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        by_bucket = np.ascontiguousarray(m.log_prob.T)
        bits = len(by_bucket).bit_length() - 1
        for batch in slices(batches, limit=BATCH):
            n = batch.num_rows
            best, sure, has = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            if m.langs:
                code, row, has = _chars(column(batch, "text").to_pylist())
                size, total = np.zeros(n), np.zeros((n, len(m.langs)))
                step = max(1, GATHERED // len(m.langs))
                for every, of in _ngrams(code, row, bits):
                    for lo in range(0, len(every), step):
                        buckets, at = every[lo : lo + step], of[lo : lo + step]
                        head = np.flatnonzero(np.diff(at, prepend=-1))
                        size[at[head]] += np.diff(head, append=len(at))
                        total[at[head]] += np.add.reduceat(by_bucket[buckets], head, axis=0, dtype=np.float64)
                total *= (evidence / np.maximum(size, evidence))[:, None]
                total += m.prior
                best = total.argmax(axis=1)
                sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            found = [m.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())]
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in names), pa.array(found, pa.string()), pa.array(np.where(has, sure, 0.0))], names=[*names, lang, score])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema), f"`{lang}` string", f"`{score}` double"])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod 4, is 2; false for a null id, from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *keep: str, **names: str) -> DataFrame:
    """Fit on the documents that aren't held out, then predict all."""
    learn = docs.where(~held_out() & F.col("doc_id").isNotNull())
    return predict(docs, train(learn), *keep, **names)


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a score of `least` or more; all columns stay, whatever their names."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    return identify(docs, *docs.columns, lang=lang, score=score).where((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)
