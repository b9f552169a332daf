import threading

import pytest
from pyspark.sql import functions as F

from strataloom.sources import store as module
from strataloom.sources.store import Conflict, Store

DOCS, NODES, CHUNKS = "document_id bigint, filename string, file_path string", "document_id bigint, node_id int, parent_id int, content string", "document_id bigint, chunk_id string"


def parts(spark, ids, word):
    return (
        spark.createDataFrame([(i, f"f{i}", "/p") for i in ids], DOCS),
        spark.createDataFrame([(i, n, None if n == 1 else 1, f"{word} {i} {n}") for i in ids for n in (1, 2)], NODES),
        spark.createDataFrame([(i, f"c{i}") for i in ids], CHUNKS),
    )


def contents(store, version=None):
    return sorted(r["content"] for r in store.read("nodes", version).collect())


def test_indexing_again_replaces_and_versions_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path), "m")
    first = store.add(*parts(spark, [1, 2], "old"))
    for _ in range(2):
        store.add(*parts(spark, [2, 3], "new"))
    want = sorted([f"old 1 {n}" for n in (1, 2)] + [f"new {i} {n}" for i in (2, 3) for n in (1, 2)])
    assert contents(store) == want and store.read("documents").count() == store.read("chunks").count() == 3
    assert contents(store, first) == sorted(f"old {i} {n}" for i in (1, 2) for n in (1, 2))
    last = store.delete(2)
    assert store.document(2) is None and store.nodes(2).count() == 0 and contents(store, last - 1) == want
    store.add(*parts(spark, [2], "back"))
    assert [r["content"] for r in store.nodes(2).collect()] == ["back 2 1", "back 2 2"]
    assert [r["node_id"] for r in store.children(2, 1).collect()] == [2] and store.node(2, 1)["content"] == "back 2 1"
    # the same in one segment
    rows = contents(store)
    store.compact()
    assert contents(store) == rows and len(store.state()["segments"]) == 1
    assert store.vacuum() and contents(store) == rows
    assert Store(spark, str(tmp_path), "m").state()["version"] == store.state()["version"]


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path), "m")
    failed = []

    def write(k):
        try:
            own = Store(spark, str(tmp_path), "m")
            for n in range(3):
                own.add(*parts(spark, [10 * k + n], "w"))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    store.compact()
    for t in threads:
        t.join()
    assert not failed and {r["document_id"] for r in store.read("documents").collect()} == {10 * k + n for k in range(3) for n in range(3)}


def test_a_version_is_created_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), "m")
    with pytest.raises(Conflict):
        store.log.create(store.state()["version"], {})
    assert store.state()["model_key"] == "m"


def test_an_aborted_write_is_invisible(spark, tmp_path):
    store = Store(spark, str(tmp_path), "m")
    store.add(*parts(spark, [1], "a"))
    documents, nodes, chunks = parts(spark, [1, 2], "b")
    with pytest.raises(Exception):
        store.add(documents, nodes, chunks.withColumn("chunk_id", F.raise_error(F.lit("stop")).cast("string")))
    assert contents(store) == ["a 1 1", "a 1 2"] and store.read("documents").count() == 1
    assert len(store.vacuum()) == 1


def test_a_point_read_takes_one_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path), "m")
    store.add(*parts(spark, list(range(60)), "a"))
    assert len(store.nodes(7).inputFiles()) > module.BUCKETS / 2
    plan = store.nodes(7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    seen = store.nodes(7).select(F.input_file_name()).distinct().count()
    assert seen == 1


def test_paths_other_models_and_many_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "MOST_SEGMENTS", 3)
    store = Store(spark, str(tmp_path), "m")
    for k in range(5):
        store.add(*parts(spark, [k], "a"))
    assert len(store.state()["segments"]) <= 4 and store.read("documents").count() == 5
    store.set_path("f3", "/new")
    assert {r["document_id"]: r["file_path"] for r in store.read("documents").collect()}[3] == "/new" and store.nodes(3).count() == 2
    again = Store(spark, str(tmp_path), "other")
    assert (again.read("documents").count(), again.read("nodes").count(), again.read("chunks").count()) == (5, 10, 0)
    again.add(*parts(spark, [1], "b"))
    assert again.read("chunks").count() == 1
