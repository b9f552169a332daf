"""Pairs of sets that sketches tell apart are not verified, and no link is lost for it."""

import random

from pyspark.sql import functions as F

from strataloom.llm import cluster, line_dedup


def groups(n, seed=3):
    """Near copies of a base of 300 elements, of which some resemble only each other, and strangers that share a few of its elements."""
    rng, new = random.Random(seed), iter(range(10_000, 10**9))
    edit = lambda x, k: (set(x) - set(rng.sample(sorted(x), k))) | {next(new) for _ in range(k)}
    base = set(range(300))
    sets = [base] + [edit(base, rng.randint(0, 25)) for _ in range(n)] + [edit(base, rng.randint(60, 120)) for _ in range(n)]
    sets += [edit(sets[-1 - k], rng.randint(0, 28)) for k in range(n // 2)]
    return sets + [set(range(9)) | {next(new) for _ in range(rng.randint(5, 200))} for _ in range(n)]


def compared(spark, sets, threshold=0.8):
    contents = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id bigint, s array<bigint>")
    buckets = spark.createDataFrame([(key, i, len(sets)) for key in (1, 2) for i in range(len(sets))], "key bigint, id bigint, n bigint")
    seen = []

    def verify(pairs):
        pairs = pairs.localCheckpoint()
        seen.append(pairs.count())
        return cluster.with_contents(pairs, contents, "s").where(cluster.alike_sets(F.col("x"), F.col("y"), threshold)).select("a", "b")

    roots = {r["id"]: r["root"] for r in cluster.set_classes(buckets, verify, contents, F.col("s"), threshold).collect()}
    return [roots.get(i, i) for i in range(len(sets))], seen


def plain(sets, threshold=0.8):
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if x == hi else x for x in root]
    return root


def test_sketches_lose_no_link_in_tiles_of_any_size(spark, monkeypatch):
    sets = groups(30)
    expected = plain(sets)
    assert 40 < len(set(expected)) < len(sets) - 30
    for tile in (7, 1000):
        monkeypatch.setattr(cluster, "TILE", tile)
        got, seen = compared(spark, sets)
        # of 5565 pairs
        assert got == expected and sum(seen) < 2.5 * len(sets)


def test_verified_pairs_grow_with_a_group_and_not_with_its_square(spark):
    counts = [sum(compared(spark, groups(n))[1]) for n in (20, 80)]
    assert counts[1] <= 5 * counts[0]


def test_sketches_differ_in_no_more_bits_than_sets_in_elements(spark):
    sets = [*groups(6), {1}, {2}, set(range(5000))]
    rows = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id bigint, s array<bigint>")
    found = {r["id"]: r for r in cluster.sketches(rows).collect()}
    marks = {i: sum((r[f"w{j}"] % 2**64) << 64 * j for j in range(cluster.WORDS)) for i, r in found.items()}
    assert all(found[i]["n"] == len(x) for i, x in enumerate(sets))
    for a in range(len(sets)):
        for b in range(a):
            differ, unlike = (marks[a] ^ marks[b]).bit_count(), len(sets[a] ^ sets[b])
            assert differ <= unlike and (differ - unlike) % 2 == 0 and (unlike > 200 or differ >= 0.6 * unlike)


def test_lines_that_share_a_bucket_are_verified_only_if_sketches_allow_it(spark, monkeypatch):
    """A common line prefix puts all these lines in the same buckets; before, all their pairs or all their differences became rows."""
    rng, seen = random.Random(8), []
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(30)]
    lines = [" ".join(base[:k] + [word() for _ in range(30 - k)]) for k in (22, 24) for _ in range(40)] + [" ".join(base)]
    with_contents = line_dedup.with_contents

    def counted(pairs, contents, col):
        pairs = pairs.localCheckpoint()
        seen.append(pairs.count())
        return with_contents(pairs, contents, col)

    monkeypatch.setattr(line_dedup, "with_contents", counted)
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    line_dedup.classes(rows).collect()
    assert sum(seen) < 5 * len(lines)
