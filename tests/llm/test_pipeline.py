"""The pipeline's stages, each held against a plain version on its own input."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from lodeweave.llm import byte_bpe
from tests.conftest import SF
from tests.llm.test_small import similar


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, inputs[-1], SF).persist()
        if stage is not corpus_pipeline.as_tokens:
            assert out.columns == columns, name
        inputs.append(out)
    rows = [{r["doc_id"]: r["text"] for r in df.collect()} for df in inputs[:5]]
    assert 0 < len(rows[1]) <= len(rows[0]) and set(rows[2]) == set(rows[1])
    groups = similar(list(rows[2].items()), 5, 0.8)
    assert set(rows[3]) == {i for i, (_, c) in groups.items() if i == c}
    assert set(rows[4]) <= set(rows[3])
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).tokens)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = inputs[5].collect()
    assert {r["doc_id"] for r in last} == set(rows[4])
    for r in last:
        ids = np.array(plain.encode_ordinary(rows[4][r["doc_id"]]), dtype="<u4")
        assert bytes(r["ids"]) == ids.tobytes() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(rows[4][r["doc_id"]].encode()).hexdigest()
