import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import vectors

PASSAGES = "document_id bigint, node_id int, chunk_id string, embedding array<float>, content string"
QUERIES = "query_id bigint, document_id bigint, query_vector array<float>"


def sample(r, n, documents=3, size=5):
    rows = []
    for k in range(n):
        v = [round(r.gauss(0, 1), 1) for _ in range(size)]
        v = r.choice([v, v, v, v, [0.0] * size, v[:3], rows[-1][3] if rows else v, None])
        rows.append((r.choice([0, 0, *range(documents)]), r.randrange(6), f"c{k:04d}", v, f"text {k}"))
    return rows


def brute(queries, passages, k, scope=None):
    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return 0.0
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        size = np.sqrt((a @ a) * (b @ b))
        return max(0.0, round(float(a @ b / size), 4)) if size else 0.0

    out = set()
    for q, d, v in queries:
        mine = [(-cosine(v, p[3]), p[2], p[4]) for p in passages if p[0] == d and (scope is None or q not in scope or p[1] in scope[q])]
        out |= {(q, c, text, -s, i) for i, (s, c, text) in enumerate(sorted(mine)[:k], 1)}
    return out


def rows_of(df):
    return {(r.query_id, r.chunk_id, r.content, r.similarity, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("block,group", [(20_000, 2_000), (7, 3)])
def test_exact_search(spark, monkeypatch, block, group):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "QUERIES", group)
    r = random.Random(block)
    passages = sample(r, 150)
    queries = [(q, r.randrange(4), [r.gauss(0, 1) for _ in range(5)]) for q in range(25)] + [(99, 0, [0.0] * 5), (98, 0, None)]
    p, q = spark.createDataFrame(passages, PASSAGES), spark.createDataFrame(queries, QUERIES)
    assert rows_of(vectors.exactly(q, p, 4)) == brute(queries, passages, 4)
    scope = {0: {1, 2}, 3: {5}, 7: {77}}
    limits = spark.createDataFrame([(a, b) for a, bs in scope.items() for b in bs], "query_id bigint, node_id int")
    assert rows_of(vectors.exactly(q, p, 4, limits)) == brute(queries, passages, 4, scope)
    index = vectors.build(p, cells=6)
    # with all cells open the index is exact
    assert rows_of(index.search(q, 4, 6)) == brute(queries, passages, 4)
    assert rows_of(index.search(q, 4, 6, limits)) == brute(queries, passages, 4, scope)
    assert vectors.exactly(q.limit(0), p, 4).count() == vectors.exactly(q, p.limit(0), 4).count() == 0
    assert vectors.build(p.limit(0)).search(q, 4, 1).count() == 0


def test_recall_is_measured_and_reached(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    passages = rows.select(F.lit(0).cast("bigint").alias("document_id"), F.col("label").alias("node_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit(0).cast("bigint").alias("document_id"), F.col("embedding").alias("query_vector"))
    vectors.build(passages).write(str(tmp_path / "index"))
    index = vectors.Index.read(spark, str(tmp_path / "index"))
    assert index.rows.count() == rows.count()
    n, found = vectors.probes(index, queries, 10, 0.9)
    assert found >= 0.9
    assert vectors.recall(index.search(queries, 10, n), vectors.exactly(queries, passages, 10)) >= 0.88


def test_a_hot_bucket_is_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    monkeypatch.setattr(vectors, "QUERIES", 10)
    p = spark.range(2000).select(F.lit(0).cast("bigint").alias("document_id"), F.lit(0).alias("node_id"), F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    q = spark.range(40).select(F.col("id").alias("query_id"), F.lit(0).cast("bigint").alias("document_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("query_vector"))
    got = vectors.exactly(q, p, 5)
    assert {(r.query_id, r.chunk_id) for r in got.collect()} == {(a, b) for a in range(40) for b in range(5)}
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("cells", [1, 8])
def test_products_of_a_block_are_bounded(spark, monkeypatch, cells):
    whole = vectors.similarities

    def watched(vectors_, norms, lengths, queries, query_lengths):
        assert len(vectors_) * len(queries) <= 1_000
        return whole(vectors_, norms, lengths, queries, query_lengths)

    monkeypatch.setattr(vectors, "similarities", watched)
    monkeypatch.setattr(vectors, "PRODUCT", 1_000, raising=False)
    monkeypatch.setattr(vectors, "GATHERED", 50, raising=False)
    r = random.Random(5)
    passages = [(0, 0, f"c{k:04d}", [r.gauss(0, 1) for _ in range(5)], "") for k in range(300)]
    queries = [(q, 0, [r.gauss(0, 1) for _ in range(5)]) for q in range(60)]
    p, q = spark.createDataFrame(passages, PASSAGES), spark.createDataFrame(queries, QUERIES)
    index = vectors.build(p, cells=10)
    found = vectors.exactly(q, p, 4) if cells == 1 else index.search(q, 4, cells)
    assert vectors.recall(found, spark.createDataFrame(sorted(brute(queries, passages, 4)), "query_id bigint, chunk_id string, content string, similarity double, rank int")) > (0.999 if cells == 1 else 0.8)
    assert found.count() == 240
