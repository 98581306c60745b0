"""The registered queries against their SQL, and the pipeline against its stages done by hand."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_tables import plain_components, plain_repeats
from test_texts import PATH, plain_matches

from pulsewake.llm import bpe, queries, toxicity
from pulsewake.plans import catalogue
from pulsewake.plans.check import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, con, name, monkeypatch):
    monkeypatch.setitem(catalogue.QUERIES, name, queries.QUERIES[name])
    monkeypatch.setitem(catalogue.ORACLES, name, queries.ORACLES[name])
    assert compare(spark, con, FOLDER, name).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_gives_a_row_for_each_document(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())


def test_all_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


def test_pipeline_equals_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = sorted(toxicity.drop_toxic(docs, labels).collect(), key=lambda r: r.doc_id)
    _, groups = plain_components([r.text for r in rows])
    rows = [r for i, r in enumerate(rows) if groups[i] == i]
    cut = [k if m else r.text for r, (_, m, k) in zip(rows, plain_repeats([r.text for r in rows], 35))]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [not m[1] for m in plain_matches(cut, items)]
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    want = {}
    for r, text, ok in zip(rows, cut, clean):
        if ok:
            ids = encoder.encode_ordinary(text)
            want[r.doc_id] = (len(text), ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_chars, r.token_ids, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
