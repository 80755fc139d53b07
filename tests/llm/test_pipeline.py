"""The pipeline's stages, each against what its operator alone says."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import decontaminate, mixing, simhash, tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34", "en", "src0", 5)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, SF).cache()
    assert one.columns == columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} >= {10**6, 10**6 + 1}
    two = stages["simhash_dedup"](spark, one, SF).cache()
    assert two.columns == columns
    assert {r.doc_id for r in two.collect()} == {r.component for r in simhash.groups(one).collect()}
    three = stages["decontamination"](spark, two, SF).cache()
    items = [decontaminate.normal(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert three.columns == columns and not any(t in decontaminate.normal(r.text.encode()) for r in three.collect() for t in items)
    four = stages["mixing"](spark, three, SF).cache()
    drawn = {r.id: r.copies for r in mixing.mix(three).collect()}
    assert four.columns == columns and Counter(r.doc_id for r in four.collect()) == {i: n for i, n in drawn.items() if n}
    five = stages["token_output"](spark, four, SF).orderBy("start").collect()
    encoder, start = tokens.Encoder(tokens.public_tokenizer()), 0
    texts = {r.doc_id: r.text for r in four.collect()}
    assert [r.doc_id for r in five] == sorted(r.doc_id for r in four.collect())
    for r in five:
        raw = encoder.encode([texts[r.doc_id]])[0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(raw) // 4, zlib.crc32(np.frombuffer(raw, dtype="<u4").tobytes()))
        start += r.n_tokens


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 50
    empty = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
