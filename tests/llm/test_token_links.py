import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from strataloom.llm import token_links as tl

DOCS = "doc_id bigint, text string, a string, words string"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path(tl.A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tl.B))


def byte_of(c):
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return ord(c) if ord(c) in own else [b for b in range(256) if b not in own][ord(c) - 256]


def both(libraries, text):
    """(A, B): lists of (id, end), by the libraries over the whole text; empty where they do not give the text's bytes."""
    a, b = libraries
    if not text:
        return [], []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    raw_a = [bytes(map(byte_of, a.id_to_token(x))) for x in ids]
    ids_b = b.encode(text)
    raw_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], []
    return [[(x, sum(map(len, raw[: k + 1]))) for k, x in enumerate(ids)] for ids, raw in ((ids, raw_a), (ids_b, raw_b))]


def brute(libraries, texts):
    links, rows = [], []
    for text in texts:
        a, b = both(libraries, text)
        spans = lambda t: [(x, t[k - 1][1] if k else 0, e) for k, (x, e) in enumerate(t)]
        links.append([(x, y) for x, s, e in spans(a) for y, u, v in spans(b) if s < v and u < e])
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        inside = lambda t, lo, hi: ",".join(str(x) for x, e in t if lo < e <= hi)
        groups = ";".join(f"{inside(a, lo, hi)}|{inside(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        rows.append([len(a), len(b), len(cuts), len(links[-1]), 0, 0, hashlib.sha256(groups.encode()).hexdigest() if a else ""])
    counts = Counter(x for row in links for x in row)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    for row, found in zip(rows, links):
        row[4], row[5] = sum(counts[x] == most[x[1]] for x in found), sum(counts[x] for x in found)
    return [tuple(x) for x in rows]


EDGE = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "a  b", "a \n b\n  c \n", "Hello, world!", "<|endoftext|> <s> </s> <unk>", "▁ mark", "中文字符没有空格的文本", "😀😀👍🏽 é é", "  nb sp 　x", "1234567 don't I'LL", "x" * 300, "tab\tand\r\nlines \x1c \x85 ", "\x00 ﻿"]


def test_rows_equal_brute_force(spark, libraries):
    r = random.Random(2)
    parts = ["the", " quick", "Ünïcode", "naïve", " ", "  ", "\n", "日本語", "العربية", "ing", "tion", "0.75", "😀", "don't", "_x", "--", "xyzzyq", "Straße"]
    texts = EDGE + ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(1, 40))) for _ in range(150)] + ["same text"] * 3
    want = brute(libraries, texts)
    df = spark.createDataFrame([(k if k % 7 else None, t, "x", "y") for k, t in enumerate(texts)], DOCS).repartition(3)
    for broadcast in (tl.BROADCAST, 0):
        got = tl.token_links(df, public_tokenizers.path(tl.A), public_tokenizers.path(tl.B), broadcast=broadcast)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        rows = {x.doc_id: tuple(x)[1:] for x in got.collect() if x.doc_id is not None}
        assert rows == {k: x for k, x in enumerate(want) if k % 7}
        assert sorted(tuple(x)[1:] for x in got.collect()) == sorted(want)
    assert tl.token_links(df.limit(0), public_tokenizers.path(tl.A), public_tokenizers.path(tl.B)).count() == 0


def test_byte_level_ids_are_the_librarys(libraries):
    side, r = tl.byte_level(public_tokenizers.path(tl.A)), random.Random(1)
    names = [x.decode("utf-8", "ignore") for x in side.raw]
    words = ["".join(r.choice(names) for _ in range(r.randint(1, 4))) for _ in range(20_000)]
    words += [f"x{chr(c)}x 1{chr(c)}1 {chr(c)}{chr(c)} \n{chr(c)} {chr(c)}'s" for c in range(0x30000) if c % 9 == 0 and not 0xD800 <= c < 0xE000]
    whole = [x.ids for x in libraries[0].encode_batch_fast(words, add_special_tokens=False)]
    assert side.encode(words) == whole
    # cut to words, the ids are the same; all but the first word keep the space before them
    assert [[i for x in side.encode(tl.words_of(w)) for i in x] for w in words[:5000]] == [x.ids for x in libraries[0].encode_batch_fast([" " + w for w in words[:5000]], add_special_tokens=False)]


def test_a_long_text(spark):
    text = "pneumonoultramicroscopic " * 60_000
    row = tl.token_links(spark.createDataFrame([(1, text, "", "")], DOCS), public_tokenizers.path(tl.A), public_tokenizers.path(tl.B)).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.count_sum > row.n_links


def test_words_tokenised_together_are_those_of_single_words():
    r = random.Random(5)
    texts = [x for x in EDGE if x and "▁" not in x] + ["".join(r.choice("abc é\n日😀\u3000\uff21") for _ in range(r.randint(1, 30))) for _ in range(300)]
    words = list(dict.fromkeys(w for x in texts for w in tl.words_of(x)))
    for side in (tl.byte_level(public_tokenizers.path(tl.A)), tl.pieces(public_tokenizers.path(tl.B))):
        ids, n, good = side.tokens(words)
        each = side.encode(words)
        assert n.tolist() == [len(x) for x in each] and ids.tolist() == [i for x in each for i in x]
        assert good.tolist() == [b"".join(side.raw[i] for i in x) == w.encode() for w, x in zip(words, each)]


def test_a_task_holds_few_slices_whatever_the_input(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(tl, "SLICE", 40_000)
    monkeypatch.setitem(tl.STORED, "parquet.block.size", 200_000)
    r = random.Random(7)
    rows = [(k, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(2_000)), "", "") for k in range(200)]
    kept, stored = [], tl.stored
    monkeypatch.setattr(tl, "stored", lambda df, **options: kept.append(stored(df, **options)) or kept[-1])
    found = tl.token_links(spark.createDataFrame(rows, DOCS).coalesce(1), public_tokenizers.path(tl.A), public_tokenizers.path(tl.B))
    files = [pq.ParquetFile(x.replace("file:", "")) for x in kept[0].inputFiles()]
    slices = kept[0].count()
    assert slices > 12 * tl.DEALT and found.count() == 200
    # before, a row group held 100 rows at least, and the shuffle's partitions did not grow with the slices
    assert max(f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) <= 20
    assert f", {-(-slices // tl.DEALT)}" in found._jdf.queryExecution().optimizedPlan().toString()
