"""Large buckets are refined as long as it helps, not a fixed number of times."""

from pyspark.sql import functions as F

from strataloom.llm import cluster


def test_refinement_goes_on_while_it_helps(spark, monkeypatch):
    monkeypatch.setattr(cluster, "ROUNDS", 0)
    sets = {i: [*range(30), *range(1000 * i, 1000 * i + 10)] for i in range(1, 61)}
    # the only link: 39 elements of 40
    sets[61] = [*sets[60][:-1], 77_777]
    contents = spark.createDataFrame(list(sets.items()), "id bigint, s array<bigint>")
    buckets = spark.createDataFrame([(0, i, len(sets)) for i in sets], "key bigint, id bigint, n bigint")
    compared = []

    def verify(pairs):
        compared.append(pairs.count())
        return cluster.with_contents(pairs, contents, "s").where(cluster.alike_sets(F.col("x"), F.col("y"), 0.8)).select("a", "b")

    def contrast(pairs):
        return cluster.contrast_sets(cluster.with_contents(pairs, contents, "s"), F.col("x"), F.col("y"), 0.8)

    roots = cluster.link_classes(buckets, verify, contrast, 0.8)
    assert {(r["id"], r["root"]) for r in roots.collect()} == {(60, 60), (61, 60)}
    # all pairs are 1830; the members with the most popular one are 60
    assert sum(compared) < 200
