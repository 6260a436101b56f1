"""Every stage of the pipeline on what the one before it kept, against brute force."""

import hashlib

import numpy as np
import tiktoken
from public_tokenizers import PATTERN

import corpus_pipeline
from pagesieve.llm import bpe
from pagesieve.llm.queries import MIX, MIX_OPTIONS, VOCABULARY
from pagesieve.llm.queries import op8_quality_divergence as judged
from pagesieve.llm.sql import mix
from test_duplicates import _least, _shingles, assert_whole

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before = {r.doc_id: r.text for r in docs.collect()}
        rows = out.collect()
        if k < 4:
            assert sorted(out.columns) == sorted(columns)
        if name == "quality rules":
            assert {r.doc_id for r in rows} == {r.doc_id for r in judged(spark, SF).filter("kept").collect()}
            assert 0 < len(rows) < len(before)
        elif name == "line dedup":
            left = dict.fromkeys(before, "") | {r.doc_id: r.text for r in rows}
            assert_whole(before, left)
            assert all(r.text.split() for r in rows) and len(rows) < len(before)
        elif name == "MinHash near-dedup":
            sets = {i: _shingles(t, 5) for i, t in before.items()}
            pairs = [
                (a, b) for a in sets for b in sets
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            ]
            assert {r.doc_id for r in rows} == {i for i, x in _least(before, pairs).items() if i == x}
        elif name == "mixing":
            with duckdb.connect() as db:
                db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{k - 1}/*.parquet'")
                copies = db.execute(f"SELECT doc_id, copies FROM ({mix(MIX, **MIX_OPTIONS)})").fetchall()
            assert sorted(r.doc_id for r in rows) == sorted(i for i, n in copies for _ in range(n))
        docs = out
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})
    assert len(rows) == sum(n for _, n in copies)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(before[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
