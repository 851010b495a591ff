"""Registered queries that SQL does not express, on whole tables, against plain versions."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodeweave.llm import byte_bpe, substring_dedup
from lodeweave.llm import queries as llm
from tests.conftest import SF


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def grams(line, k=5):
    words = line.encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def test_substring_dedup(spark, texts):
    """All pairs of paragraphs, compared exactly; and all runs of words that two documents share."""
    got = llm.op2_substring_dedup(spark, SF).collect()
    lines = {(d, i): grams(x) for d, t in texts.items() for i, x in enumerate(t.split("\n")) if len(x.encode().lower().split()) >= substring_dedup.MIN_WORDS}
    by_set = collections.defaultdict(list)
    for place, s in lines.items():
        by_set[s].append(place)
    sets = list(by_set)
    of = {s: s for s in sets}

    def root(s):
        while of[s] is not s:
            s = of[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                of[root(a)] = root(b)
    clusters = collections.defaultdict(list)
    for s in sets:
        clusters[root(s)] += by_set[s]
    want = {(place, min(c)) for c in clusters.values() if len(c) > 1 for place in c}
    found = {((r["doc_id"], r["place"]), (r["keep_doc_id"], r["keep_place"])) for r in got if r["kind"] == "paragraph"}
    assert found <= want
    assert len(found & want) >= 0.95 * len(want)
    size = substring_dedup.WINDOW + substring_dedup.REACH + 3
    runs = collections.defaultdict(set)
    words = {d: t.encode().lower().split() for d, t in texts.items()}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            runs[tuple(w[i : i + size])].add(d)
    sure = {d for docs in runs.values() for d in docs if d != min(docs)}
    windows = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - substring_dedup.WINDOW + 1):
            windows[tuple(w[i : i + substring_dedup.WINDOW])].add(d)
    passages = [r for r in got if r["kind"] == "passage"]
    assert sure and sure <= {r["doc_id"] for r in passages}
    for r in passages:
        span = words[r["doc_id"]][r["place"] : r["place"] + r["words"]]
        assert any(min(windows[tuple(span[i : i + substring_dedup.WINDOW])]) < r["doc_id"] for i in range(len(span) - substring_dedup.WINDOW + 1))


def test_toxicity(spark):
    """Rows whose labels were not learnt from."""
    folder = SF.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = llm.op5_toxicity(spark, folder).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(p == t for p, t in held) >= 0.95 * len(held) and not any(p and not t for p, t in held)


def test_byte_bpe(spark, texts):
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).tokens)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in llm.op6_byte_bpe(spark, SF).collect()}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = np.array(plain.encode_ordinary(text), dtype="<u4")
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_lm_score(spark, texts):
    got = llm.op9_lm_score(spark, SF).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {d: [*t.encode().lower().split(), None] for d, t in texts.items()}
    counts = collections.Counter(w for d, t in tokens.items() if not held(d) for w in t)
    total, distinct = sum(counts.values()), len(counts)
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        words = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(words), sum(counts[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_nothing_is_left_behind(spark, tmp_path):
    """A run of the pipeline leaves its result in the shared folder, and nothing else."""
    import os

    import corpus_pipeline
    from lodeweave.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    result = corpus_pipeline.run(spark, SF)
    assert result.count() > 0
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and os.listdir(f"{folder}/{new.pop()}") == [str(len(corpus_pipeline.STAGES) - 1)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("line_run_", "exact_index_"))]
