import hashlib
import random
import re
import time
import zlib

import numpy as np

from strataloom.llm import periodic_runs as pr

DOCS = "doc_id bigint, text string, i string, h string"


def brute(ids, least=24, repeats=3):
    n, out = len(ids), []
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and ids[i] == ids[i + p]:
                i += 1
            size = i - s + p
            if i > s and size >= max(least, repeats * p):
                w = ids[s : s + size]
                if not any(w[q:] == w[:-q] for q in range(1, p)):
                    out.append((s, size, p))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def sample(r):
    k, ids, size = r.choice([1, 2, 3, 5, 50]), [], r.randint(0, 160)
    while len(ids) < size:
        w = [r.randrange(k) for _ in range(r.randint(1, 14))]
        if r.random() < 0.3:
            w = w * 2 + [r.randrange(k)]
        ids += w * r.randint(1, 9) if r.random() < 0.6 else w
        if r.random() < 0.4:
            ids = ids[: len(ids) - r.randint(0, 5)]
    return ids


def test_runs_equal_brute_force():
    r = random.Random(3)
    for _ in range(700):
        ids, least = sample(r), r.choice([24, 6])
        assert pr.runs(np.array(ids, np.int64), least) == brute(ids, least), ids


def test_small_blocks_of_periods_change_nothing(monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(pr, "BLOCK", 7)
    monkeypatch.setattr(pr, "CHUNK", 2)
    for _ in range(200):
        ids = sample(r)
        assert pr.runs(np.array(ids, np.int64)) == brute(ids)


def test_long_texts_need_about_n_log_n():
    rng = np.random.default_rng(0)
    texts = {"natural": rng.zipf(1.3, 200_000) % 9999, "one word": np.zeros(200_000, int), "two words": rng.integers(0, 2, 200_000), "thirds": np.tile(rng.integers(0, 9999, 70_000), 3)}
    texts["many"] = np.concatenate([np.tile(rng.integers(0, 50, rng.integers(1, 30)), 9) for _ in range(1500)])
    for name, ids in texts.items():
        start = time.time()
        found = pr.runs(ids.astype(np.int64))
        assert time.time() - start < 20, name
        assert {"natural": 0, "one word": 1, "thirds": 1}.get(name, len(found)) == len(found), name


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute([hash(w) for w in words])
    gone = {i for s, size, p in found for i in range(s + p, s + size)}
    best = max(found, key=lambda x: (x[1] * 10**12 // x[2], -x[0], -x[2])) if found else (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest("".join("%d,%d,%d\n" % x for x in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_rows(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t", "a", "b " * 24, "b " * 23, "x y " * 30, "a\x0bb\x0c" * 20, "中 文 " * 40, "😀 " * 60 + "z"]
    texts += [" ".join(f"w{x}" for x in sample(r)) for _ in range(120)]
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)] + [(7, texts[7], "", ""), (None, "q " * 30, "", "")]
    got = pr.periodic_runs(spark.createDataFrame(rows, DOCS), plant=True).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", *[x.split()[0] for x in pr.COLUMNS.split(", ")[1:]]}
    want = sorted([(-1 if i is None else i, *expected(i, t)) for i, t, _, _ in rows], key=str)
    assert sorted([(-1 if x[0] is None else x[0], *x[1:]) for x in got], key=str) == want
    assert pr.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_collapse_and_table(spark):
    df = spark.createDataFrame([(1, "start " + "lo la " * 20 + "end", "", ""), (2, None, "", ""), (3, "plain words", "", "")], DOCS)
    assert {x.doc_id: x.text for x in pr.collapse(df).collect()} == {1: "start lo la end", 2: "", 3: "plain words"}
    assert [tuple(x) for x in pr.run_table(df).collect()] == [(1, 1, 40, 2)]
    assert pr.collapse(df.limit(0)).count() == pr.run_table(df.limit(0)).count() == 0
