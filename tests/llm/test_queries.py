"""The registered queries and the pipeline on the smallest test data."""

import os

import duckdb
import pytest

import corpus_pipeline
from pagemill.llm import language, toxicity
from pagemill.llm.common import table, written
from pagemill.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_topk": ["query_id", "rank", "vec_id", "score"],
    "op4_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_word_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    got = df.collect()
    if name in ORACLES:
        con = duckdb.connect()
        for t in os.listdir(DATA):
            con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
        want = con.execute(ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want.fetchall(), key=repr)
    elif name not in ("op8_packing",):
        assert len(got) == table(spark, DATA, "documents").count()


def test_pipeline_keeps_clean_documents(spark):
    docs = table(spark, DATA, "documents")
    columns, kept = docs.columns, docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, kept, DATA))
        if name != "packing":
            assert kept.columns == columns
            sizes.append(kept.count())
    lexicon = toxicity.learn(docs, table(spark, DATA, "labels"))
    toxic = toxicity.score(docs, lexicon).where("predicted = 1").count()
    assert sizes[1] == sizes[0] - toxic and sizes[2] <= sizes[1] and 0 < sizes[3] <= sizes[2] and sizes[4] == sizes[3]
    none = language.predict(docs, language.learn(docs)).where("lang_pred = 'und'").count()
    assert sizes[1] - sizes[2] <= none
    assert kept.select("doc_id").distinct().count() == sizes[4]
