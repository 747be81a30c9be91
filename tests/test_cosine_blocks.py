"""Nearest vectors: many queries against a block take no more memory than few."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brindle.operators import retrieval as S


def test_scores_of_a_block_are_bounded(spark):
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(6000, 8))
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    ids, own = np.arange(6000), np.arange(4000)
    batch = pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(unit[:4000]))], names=["id", "embedding"])
    multiply = S._multiplier(SimpleNamespace(value=(ids, unit)), 3)
    tracemalloc.start()
    found = {}
    for out in multiply(iter([batch])):
        for q, i, score in zip(*[c.to_numpy() for c in out.columns]):
            found.setdefault(q, []).append((-score, i))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All scores at once would be 192 MB, and as much again for what is worked out of them.
    assert peak < 100e6 and len(found) == 6000
    for q in (0, 17, 5999):
        scores = unit[:4000] @ unit[q]
        scores[own == q] = -np.inf
        assert [i for _, i in sorted(found[q])[:3]] == list(np.argsort(-scores)[:3])


def test_blocks_of_queries_give_the_same_lists(spark, sf_dir, monkeypatch):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    whole = S.cosine_topk(vectors, vectors, 5).collect()
    monkeypatch.setattr(S._multiplier, "__defaults__", (700,))
    assert sorted(S.cosine_topk(vectors, vectors, 5).collect()) == sorted(whole)
