"""The pipeline against its stages one by one, by plain means."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from chronolith.llm import decontaminate, language_id, queries, simhash


def test_pipeline_against_brute_force(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    model = language_id.fit_language_model(spark.read.parquet(f"{small}/documents.parquet"))
    left = {i: r for i, r in docs.items() if model.predict(r.text)[0] != "und"}
    last = {}
    for i, r in left.items():
        last[r.text] = max(i, last.get(r.text, i))
    left = {i: left[i] for i in last.values()}
    ids = np.array(sorted(left))
    fps = np.array([simhash.fingerprint(left[i].text) for i in ids], np.uint64)
    low = ids.copy()
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    near = apart <= 2
    for a, b in np.argwhere((apart > 2) & (apart <= simhash.NEAR_BITS)):
        sets = [simhash.shingle_set(left[ids[k]].text) for k in (a, b)]
        near[a, b] = simhash.similarity(*sets) >= simhash.SIMILARITY
    while (new := np.array([low[near[k]].min() for k in range(len(ids))])).tolist() != low.tolist():
        low = new
    left = {int(i): left[int(i)] for i, c in zip(ids, low, strict=True) if i == c}
    items = [decontaminate.normal_text(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = {i: r for i, r in left.items() if not any(t in decontaminate.normal_text(r.text) for t in items)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: tokenizer.encode(r.text, add_special_tokens=False).ids for i, r in left.items()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert {i: r.ids for i, r in got.items()} == want
    assert all(r.decoded_sha256 == hashlib.sha256(docs[i].text.encode()).hexdigest() for i, r in got.items())


def test_stages_keep_columns_and_stand_nulls(spark, small):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "some plain words stand in this text", "en", "a", 5), (3, "some plain words stand in this text", "en", "a", 5), (None, "das ist ein text", "de", "b", 3), (4, "12", None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == schema.names, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{i}" for i in range(1, 11)]
