import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.llm import byte_bpe, line_dedup, quality, sharding, token_counts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [None, "", " ", "\n\n", "a", "A b.\n\nA b.", "x" * 5000, "中文字符 没有空格的文本", "😀 \u0000 ﻿", "tab\there  and   spaces ", "▁ literal ▁▁"]


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.vocabulary_path())


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.vocabulary_path(), byte_bpe.default_pattern())


def test_token_counts(spark, library):
    got = token_counts.token_counts(docs(spark, EDGE), token_counts.vocabulary_path(), limit=20).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(library.encode(t or "")) for t in EDGE]
    assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in EDGE]
    assert [r["over_limit"] for r in got] == [len(library.encode(t or "")) > 20 for t in EDGE]
    assert token_counts.token_counts(docs(spark, EDGE).limit(0), token_counts.vocabulary_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab  \n▁é中😀.'x<s>\t ", max_size=25))
def test_every_prefix(text):
    counter = _counter()
    prefix = counter.prefix(text)
    for i in range(len(text) + 1):
        assert prefix.count(i) == len(counter.model.encode(text[:i]))
    brute = [len(counter.model.encode(text[:i])) for i in range(1, len(text) + 1)]
    assert prefix.every().tolist() == brute
    ok = [i for i, n in enumerate(brute, 1) if n <= 5 and not (text[i - 1] in " ▁" and i < len(text))]
    assert prefix.count(prefix.cut(5)) <= 5 and prefix.cut(5) >= max(ok, default=0)


def test_long_words_need_linear_time():
    import time
    import tracemalloc

    r = random.Random(1)
    base64 = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    counter = _counter()
    for word in ("1" * 1_000_000, "".join(r.choice("0123456789") for _ in range(1_000_000)), "a" * 1_000_000, "汉字没有空格" * 170_000, base64, "▁" * 1_000_000, "😀" * 300_000):
        start = time.time()
        prefix = counter.prefix(word)
        tracemalloc.start()
        at = prefix.cut(4096)
        assert tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()
        assert time.time() - start < 20 and len(counter.model.encode(word[:at])) <= 4096
        assert at == len(word) or len(counter.model.encode(word[: at + 1])) > 4096 or word[at] in " ▁" or word[at - 1] in " ▁"
    word = base64[:3000] + "aaaaaaa" * 50 + "▁▁▁▁" + "日本語" * 40 + "ing" * 60
    assert counter.prefix(word).every().tolist() == [len(counter.model.encode(word[:i])) for i in range(1, len(word) + 1)]


def test_a_text_without_spaces_is_cut_inside():
    counter = _counter()
    for text in ("汉字没有空格" * 4000, "x" * 200_000, "Donaudampfschifffahrt" * 100):
        prefix = counter.prefix(text)
        at = prefix.cut(1000)
        assert 0 < at and prefix.total() == len(counter.model.encode(text))
        assert len(counter.model.encode(text[:at])) <= 1000 and (at == len(text) or len(counter.model.encode(text[: at + 1])) > 1000)


_KEPT = []


def _counter():
    if not _KEPT:
        _KEPT.append(token_counts.PrefixCounter(token_counts.vocabulary_path()))
    return _KEPT[0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab  \n▁é中😀.'sl<>\t   0123", max_size=300))
def test_stitched_encoding(text):
    if len(_KEPT) < 2:
        _counter()
        _KEPT.append(byte_bpe.Codec(byte_bpe.vocabulary_path(), byte_bpe.default_pattern()))
    codec = _KEPT[1]
    ids = codec.encode(text, 20, 8)
    assert ids == codec.encoding.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_texts_over_tasks(spark, codec):
    rng = random.Random(4)
    texts = [*EDGE, "".join(rng.choice("ab  \n'sé中. 12") for _ in range(6000)), "q" * 4000 + " tail text " * 300]
    rows = docs(spark, texts).unionByName(docs(spark, texts).where("doc_id >= 11"))
    got = byte_bpe.encode(rows, byte_bpe.vocabulary_path(), byte_bpe.default_pattern(), long=1000, chunk=500, overlap=60)
    ids = [(r["doc_id"], r["ids"]) for r in got.collect()]
    assert len(ids) == len(texts) + 2
    for i, x in ids:
        assert x == codec.encoding.encode_ordinary(texts[i] or "")
    back = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(got, byte_bpe.vocabulary_path(), byte_bpe.default_pattern()).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    digests = {r["doc_id"]: r for r in byte_bpe.encode(rows, byte_bpe.vocabulary_path(), byte_bpe.default_pattern(), byte_bpe.DIGESTS).collect()}
    for i, x in ids:
        assert digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def test_shards(spark):
    rng = random.Random(2)
    texts = [None, "", *["w" * rng.randint(1, 400) for _ in range(600)], *["hot text"] * 300]
    got = sharding.shard_by_bytes(docs(spark, texts)).collect()
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[text].add(r["shard"])
    assert sorted(size) == list(range(8)) and len(got) == len(texts)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in where.values())
    assert max(size.values()) - min(size.values()) <= 2 * 401 + sum(size.values()) * 0.01
    assert sharding.shard_by_bytes(docs(spark, texts).limit(0)).count() == 0
    # one text of more than a shard's bytes has a shard of its own, the others share the rest
    large = [*texts, *["q" * 1000] * 60]
    size, where = Counter(), defaultdict(set)
    for r in sharding.shard_by_bytes(docs(spark, large).withColumn("heavy", F.lit("clash"))).collect():
        size[r["shard"]] += r["size"]
        where[large[r["doc_id"]] or ""].add(r["shard"])
    alone = where["q" * 1000]
    rest = [n for k, n in size.items() if k not in alone]
    assert all(len(x) == 1 for x in where.values()) and size[min(alone)] == 60060 and max(rest) - min(rest) <= 2 * 401 + sum(rest) * 0.01


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    rng = random.Random(3)
    texts = [*EDGE, *[" ".join(rng.choice(["a", "b", "c", "dd\n", "|x", "#"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]]
    got = quality.measures(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got] == [plain_measures(t) for t in texts]


def test_binomial_tail(spark):
    cases = [(n, k, a) for n in (1, 50, 3000) for k in (0, 1, 7) for a in (0.004, 0.1) if k <= n]
    for n, k, a in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), a).alias("p")).first()["p"]
        exact = sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(1.0 if k >= n * a else exact, rel=1e-9)


def test_cutoffs_against_plain_python(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(3600):
        good = i % 3 > 0
        share = 0.0 if good and rng.random() > 0.003 else 0.6
        words = [rng.choice("abcdefgh") * rng.randint(3, 7) + str(j) for j in range(60)]
        texts.append(" ".join(w + "#" * 4 if rng.random() < share else w for w in words))
        labels.append((i, int(good)))
    rows = docs(spark, texts, ["en" if i % 5 else None for i in range(len(texts))])
    marks = spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id bigint, quality int")
    judged = quality.quality_rules(rows, marks).select("doc_id", "kept", "base_failed").collect()
    chosen = {r["stratum"]: r for r in quality.cutoffs(quality.measures(rows), marks, alpha=0.05).collect()}
    assert set(chosen) == {"en", ""}
    share = lambda t: plain_measures(t)[2] / plain_measures(t)[1]
    good = [share(texts[i]) for i, q in labels if q and i % 5]
    bad = [share(texts[i]) for i, q in labels if not q and i % 5]
    passed = []
    for c in quality.RULES["symbol_share"][1]:
        k, n, a = sum(x > c for x in good), len(good), 0.05 / len(quality.RULES)
        if sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1)) > 0.05 / (2 * len(quality.RULES)) or k >= n * a:
            break
        passed.append((sum(x > c for x in bad) / len(bad) - k / n, c))
    best = max((g for g, _ in passed), default=0)
    assert chosen["en"]["max_symbol_share"] == (next(c for g, c in passed if g == best) if best > 0 else None)
    assert sum(not r["kept"] for r in judged if labels[r["doc_id"]][1]) <= 0.02 * sum(q for _, q in labels)
    assert quality.quality_rules(rows.limit(0), marks.limit(0)).count() == 0
    clash = rows.limit(20).withColumn("_s", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y"))
    assert quality.keep_good(clash, marks).columns == clash.columns and quality.keep_good(clash, marks).first()["kept"] == "x"


def plain_lines(texts):
    places = [(i, p, x.strip(" \t\r\x0b\x0c")) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n"))]
    places = [x for x in places if x[2]]
    bags = {x: frozenset(x.lower()[i : i + 9] for i in range(max(1, len(x.lower()) - 8))) for _, _, x in places}
    root = {x: x for x in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, p, x in places:
        groups[find(x)].append((i, p))
    return {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def line_texts():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 30))) for _ in range(60)]
    texts = []
    for _ in range(70):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(base).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    return [*EDGE, *texts]


def test_lines_against_all_pairs(spark):
    texts = line_texts()
    rows = docs(spark, texts)
    got = {(r["i"], r["pos"]): (r["keep_i"], r["keep_pos"]) for r in line_dedup.classes(rows).collect()}
    expected = plain_lines(texts)
    links = lambda x: {(a, b) for a, b in x.items()}
    assert len(links(got) & links(expected)) >= 0.97 * len(expected) and set(got) <= set(expected)


def test_dedup_lines(spark):
    texts = ["one line that stays here\nsecond", "one line that stays here", "  one line that stays here\t\n\nnew", None, "", "twice\ntwice\n"]
    rows = docs(spark, texts).withColumn("_gone", F.lit(1))
    out = line_dedup.dedup_lines(rows.unionByName(rows.where("doc_id = 5"))).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["one line that stays here\nsecond", "", "\nnew", None, "", "twice\n", "twice\n"]
    assert [r["n_chars"] for r in out] == [len(r["text"] or "") for r in out] and out[0]["_gone"] == 1
    assert line_dedup.dedup_lines(rows.limit(0)).count() == 0
