"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

1. language: documents without a letter, or whose language is less than half sure, go.
2. near_copies: of documents linked by a shingle similarity of 0.8 or more, the smallest doc_id stays.
3. repeated_passages: words of 50-word windows that an earlier document has go; n_chars follows the text.
4. benchmark: documents of which a twentieth or more is benchmark text go.
5. packing: the rest is packed into sequences of 2048 tokens.

A stage's input is written before it starts, so each stage first deletes what the stages before it, of the same run, left in the shared folder. Stages that are
called one by one in a session are one run: the result of each must be written before the next is called.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, jaccard, language, packing, superkmers
from tessella.llm.common import release, scratch, settle, shared_dir, table
from tessella.llm.queries import tokenizer


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = "1000"  # texts are long: so many rows hold a few megabytes on either side of the border to Python


class Run:
    """What a run of the stages leaves for the next stage to clear up: the folders that its own stages made, no other's, and the session's batch size."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self.batch = spark, [], None

    @contextmanager
    def stage(self, last: bool = False) -> Iterator[None]:
        release(self.spark, self.folders)
        gc.collect()
        settle()
        self.batch = self.batch or self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, BATCH_ROWS)
        try:
            with scratch(self.folders):
                yield
        except BaseException:
            last = True
            raise
        finally:
            if last:
                self.spark.conf.set(BATCH, self.batch)
                self.batch = None


_runs: WeakKeyDictionary[SparkSession, Run] = WeakKeyDictionary()  # of stages that are called one by one


def _run(spark: SparkSession) -> Run:
    return _current.get() or _runs.setdefault(spark, Run(spark))


_current: ContextVar[Run | None] = ContextVar("run", default=None)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _run(spark).stage():
        return language.keep_known(docs)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _run(spark).stage():
        return jaccard.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _run(spark).stage():
        return superkmers.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _run(spark).stage():
        return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with _run(spark).stage(last=True):
        return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_language),
    ("near_copies", keep_one_near_copy),
    ("repeated_passages", drop_repeated_passages),
    ("benchmark", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a trained language model is no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, own = table(spark, sf_dir, "documents"), []
    token = _current.set(Run(spark))
    try:
        for name, stage in STAGES:
            out, made = shared_dir(spark, f"pipeline-{name}"), stage(spark, docs, sf_dir)
            made.write.parquet(out)
            docs = spark.read.schema(made.schema).parquet(out)
            release(spark, own)
            own.append(out)
        release(spark, _current.get().folders)
    finally:
        _current.reset(token)
    return docs
