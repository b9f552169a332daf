import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import language_model as lm

DOCS = "doc_id bigint, text string, t string, w1 string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Brute:
    """The same model by plain counting, with strings for words."""

    def __init__(self, texts, order):
        self.order, self.raw = order, Counter()
        grams = Counter()
        for text in texts:
            line = [None] * (order - 1) + words(text) + [""]
            for i in range(order - 1, len(line)):
                self.raw[line[i]] += 1
                grams[tuple(line[i - order + 1 : i + 1])] += 1
        self.n = {order: grams}
        for k in range(order - 1, 0, -1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.follow = {k: defaultdict(list) for k in self.n}
        for k, found in self.n.items():
            for g, c in found.items():
                self.follow[k][g[:-1]].append(c)
        self.d = {k: lm.discounts(*(sum(c == j for c in found.values()) for j in (1, 2, 3, 4))) for k, found in self.n.items()}

    def p(self, k, gram):
        if not k:
            return 1 / (len(self.raw) + 1)
        counts = self.follow[k].get(gram[:-1])
        lower = self.p(k - 1, gram[1:])
        if not counts:
            return lower
        d = lambda c: self.d[k][min(c, 3) - 1] if c else 0
        c = self.n[k].get(gram, 0)
        return (c - d(c) + sum(map(d, counts)) * lower) / sum(counts)

    def score(self, text):
        line = [None] * (self.order - 1) + words(text) + [""]
        tokens = line[self.order - 1 :]
        total, v = sum(self.raw.values()), len(self.raw)
        base = sum(math.log10((self.raw[x] + 0.5) / (total + 0.5 * (v + 1))) for x in tokens)
        own = sum(math.log10(self.p(self.order, tuple(line[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(line)))
        return len(tokens), sum(self.raw[x] > 0 for x in tokens), total, base, own


def corpus(n, seed):
    r = random.Random(seed)
    names = [f"w{k}" for k in range(60)] + ["Ünï", "中文", "A", "a", "😀"]
    out = [None, "", " ", "a", "A a\x0bA\x1cb"]
    while len(out) < n:
        state, line = r.randrange(len(names)), []
        for _ in range(r.randint(1, 40)):
            state = (state * 7 + r.choice([1, 1, 1, 2, 3, r.randrange(60)])) % len(names)
            line.append(names[state])
        out.append(r.choice([" ", "\n", "\t "]).join(line))
    return out


def test_hashes_are_sparks(spark):
    r = np.random.default_rng(1)
    pairs = r.integers(-(2**63), 2**63 - 1, (50, 2))
    got = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long").select(F.xxhash64("a", "b").alias("two"), F.xxhash64("a").alias("one"), lm.shard_of(F.xxhash64("a"), 7).alias("shard")).collect()
    a, b = (pairs[:, k].view(np.uint64) for k in (0, 1))
    assert [x.two for x in got] == lm.key_of([a, b]).view(np.int64).tolist() and [x.one for x in got] == lm.key_of([a]).view(np.int64).tolist()
    assert [x.shard for x in got] == (((lm.key_of([a]) >> np.uint64(33)) * np.uint64(7)) >> np.uint64(31)).tolist()


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_packed_ngrams(spark, order):
    r, packing = np.random.default_rng(order), lm.Packing(order)
    words, n = [r.integers(0, 2**lm.BITS, 40, np.uint64) for _ in range(order)], r.integers(1, 2**40, 40, np.uint64)
    words[0][0] = words[-1][1] = 2**lm.BITS - 1
    found = packing.pack(words, n)
    back, counts = packing.unpack(found)
    assert all((a == b).all() for a, b in zip(words, back)) and (counts == n).all()
    rows = spark.createDataFrame([tuple(map(int, x)) for x in zip(*found)], ", ".join(f"{x} long" for x in packing.names)).select(*packing.words()).collect()
    assert [tuple(x) for x in rows] == [tuple(map(int, x)) for x in zip(*words)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    train, others = corpus(150, 1), corpus(40, 2) + ["unknown words only", "w1 unknown w2"]
    model = lm.fit(spark.createDataFrame([(x,) for x in train], "t string").repartition(5), order, shards=6)
    brute = Brute(train, order)
    got = lm.score(spark.createDataFrame([(k, x, "", "") for k, x in enumerate(train + others)], DOCS), model).orderBy("doc_id").collect()
    assert len(got) == len(train + others)
    for row, text in zip(got, train + others):
        want = brute.score(text)
        assert tuple(row)[1:4] == want[:3] and row.base_score == pytest.approx(want[3], rel=1e-9) and row.score == pytest.approx(want[4], rel=1e-6), text
    # the probabilities of all words after any context, one unknown word among them, sum to 1
    for context in (["w3"], ["w3", "w20"], ["never", "seen"]):
        context = tuple(([None] * order + context)[-(order - 1) :]) if order > 1 else ()
        assert sum(brute.p(order, (*context, w)) for w in [*brute.raw, "\n"]) == pytest.approx(1)


def test_query(spark, tmp_path):
    rows = [(k, x, "clash", None) for k, x in enumerate(corpus(200, 3))] + [(5, "w1 w2 w3", "", ""), (None, "w1 w2", "", "")]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = lm.op11_language_model(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    brute = Brute([t for i, t, _, _ in rows if not out(i)], lm.ORDER)
    want = sorted([(str(i), out(i), *brute.score(t)) for i, t, _, _ in rows], key=lambda x: (x[0], x[-1]))
    for a, b in zip(sorted([(str(x[0]), *x[1:]) for x in got.collect()], key=lambda x: (x[0], x[-1])), want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    model = lm.fit(none.select("t"))
    assert lm.score(none, model).count() == 0
    row = lm.score(spark.createDataFrame([(1, "any word", "", "")], DOCS), model).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score == 0.0


def test_folders_that_cannot_be_mapped_are_refused(spark):
    with pytest.raises(ValueError, match="cannot map"):
        lm.fit(spark.createDataFrame([("a",)], "t string"), folder="hdfs://there/folder")


def test_the_model_beats_single_words_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.op11_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert docs.count() and rows[1] > rows[0]
