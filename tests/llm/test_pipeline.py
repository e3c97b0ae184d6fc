"""The pipeline end to end on the smallest table, each stage's effect on its own input."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_removal

import corpus_pipeline as pipeline
from tessella.llm import common, language

SF = "/root/testdata/sf0.001"


def written(df):
    """A stage's result as the next one gets it."""
    path = pipeline.shared_dir(df.sparkSession, "test-stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_stages(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        seen.append((name, docs.count()))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert [x for x, _ in seen] == ["language", "near_copies", "repeated_passages", "benchmark", "packing"]
    kept = [n for _, n in seen]
    assert kept[0] > kept[1] >= kept[2] > kept[3] > 0


def test_run_equals_brute_force(spark):
    """Each stage's decisions on its own input, by plain loops; languages are those that the tested model gives."""
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in language.identify(docs, "doc_id").where("lang_pred <> 'und' and score >= 0.5").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in known]
    label = brute_components(rows)
    rows = [(i, t) for i, t in rows if label[i] == i]
    removed = {r[0]: r[2] for r in brute_removal(rows, 50)}
    starts, texts = {}, {}
    for i, t in sorted(rows):
        words = t.encode().split()
        texts[i], gone = words, set()
        for at in range(len(words) - 49):
            window = tuple(words[at : at + 50])
            if starts.setdefault(window, i) < i:
                gone |= set(range(at, at + 50))
        assert len(gone) == removed[i]
        if gone:
            texts[i] = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        else:
            texts[i] = t
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = plain(r.text)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes, kept = {len(x) for x in windows}, {}
    for i, t in texts.items():
        w, hit = plain(t), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
        if not hit or 20 * len(hit) < len(w):
            kept[i] = t
    assert 0 < len(kept) < len(texts) < len(known)
    encode = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")).encode
    pieces = pipeline.run(spark, SF).collect()
    found, filled = {}, {}
    for p in pieces:
        found.setdefault(p.doc_id, []).append(p)
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(found) == set(kept)
    for i, own in found.items():
        ids, at = [*encode(kept[i], add_special_tokens=False).ids, 0], 0
        for p in sorted(own, key=lambda p: p.piece):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for places in filled.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048


def test_only_the_runs_own_tables_are_deleted_and_the_session_is_left_as_it_was(spark):
    pytest.importorskip("public_tokenizers")
    docs, before = spark.read.parquet(f"{SF}/documents.parquet").limit(40), spark.conf.get(pipeline.BATCH)
    other = []
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        other.append(common.materialise(spark.range(3), "someone-elses"))
    assert all(x.count() == 3 for x in other) and spark.conf.get(pipeline.BATCH) == before
    with pytest.raises(Exception, match="no_such_column"):
        pipeline.keep_known_language(spark, spark.range(1).selectExpr("no_such_column"), SF)
    assert spark.conf.get(pipeline.BATCH) == before


def test_stages_with_nulls_repeats_and_columns_of_any_name(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, None, "en", "s", 0), (901, "", "en", None, 0), (902, "12 34", None, "s", 5), (None, "a text of some words without an id", "en", "s", 3)], docs.schema)
    wide = docs.unionByName(docs).unionByName(odd)
    for x in ("score", "lang_pred", "_gone", "_runs", "_spans"):
        wide = wide.withColumn(x, F.lit(x))
    before = wide.count()
    for name, stage in pipeline.STAGES[:-1]:
        wide, columns = written(stage(spark, wide, SF)), wide.columns
        assert wide.columns == columns and 0 < wide.count() <= before
        assert all(r.score == "score" for r in wide.select("score").collect())
        before = wide.count()
    packed = pipeline.pack_sequences(spark, wide, SF)
    assert packed.where("piece = 0").count() == before


def test_stages_of_an_empty_table(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        assert docs.count() == 0
