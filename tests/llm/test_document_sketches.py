"""Sketches of weighted documents, and large buckets that meet some pivots first, lose no link."""

import random

import numpy as np
from test_sketched_pairs import compared, groups, plain

from strataloom.llm import cluster, near_dedup


def test_graded_sketches_differ_no_more_than_documents():
    rng = random.Random(4)
    weights = np.linspace(2 / 3, 1, 1000).astype(np.float32)
    base = {i: rng.choice([1, 1, 1, 2, 300]) for i in range(150)}
    bags = [base | {rng.randrange(1000): rng.randint(1, 5) for _ in range(k)} for k in (0, 1, 5, 20, 200) for _ in range(4)]
    dense = np.array([[b.get(i, 0) for i in range(1000)] for b in bags], dtype=float) * weights
    keys = [np.array(sorted(b), np.uint64) for b in bags]
    counts = np.concatenate([[b[int(k)] for k in ks] for b, ks in zip(bags, keys)])
    flat = np.concatenate(keys)
    words = near_dedup.marks(flat, counts, weights[flat.astype(np.int64)], np.cumsum([0, *map(len, keys)]))
    grades = np.array(near_dedup.grades(weights))
    assert words.shape == (len(bags), cluster.WORDS) == (len(bags), len(grades))
    for a in range(len(bags)):
        for b in range(a):
            differ, unlike = float((np.bitwise_count(words[a] ^ words[b]) * grades).sum()), float(np.abs(dense[a] - dense[b]).sum())
            assert differ <= unlike + 1e-6 and (unlike > 100 or differ >= 0.5 * unlike)


def test_large_buckets_meet_pivots_first_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(cluster, "LARGE", 20)
    monkeypatch.setattr(cluster, "PIVOTS", 8)
    monkeypatch.setattr(cluster, "TILE", 40)
    met, near = [], cluster._near

    def counted(*args, pivots=False):
        out = near(*args, pivots=pivots).localCheckpoint()
        met.append((pivots, out.count()))
        return out

    monkeypatch.setattr(cluster, "_near", counted)
    sets = groups(30)
    assert compared(spark, sets)[0] == plain(sets)
    # most of the group is one component by then
    assert [x for x, _ in met] == [True, False] and 0 < met[0][1] and met[1][1] < 300
