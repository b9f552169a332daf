from pyspark.sql import functions as F

from strataloom.config import Settings
from strataloom.functions.text import approx_tokens, char_ngrams, extractive_summary, fold, fold_full, heat_class, repair_json, sentences, tokens, valid_ids
from strataloom.operators.chunk import chunk_table, chunk_text, page_of
from strataloom.operators.tree import renumber_headings


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_fold(spark):
    for text in ("ÇĞİÖŞÜ çğıöşü", "Ärger übÉr", "straße", "İstanbul"):
        assert one(spark, text, fold) == one(spark, text, fold_full)
    assert one(spark, "İÇİNDEKİLER", fold) == "icindekiler"


def test_tokens_and_ngrams(spark):
    assert one(spark, "Ünlü bir_şey, 3 tane!", tokens) == ["unlu", "bir_sey", "3", "tane"]
    assert sorted(one(spark, "abcd", char_ngrams)) == ["abc", "bcd"]
    assert one(spark, "ab", char_ngrams) == ["ab"]
    assert one(spark, "  ", char_ngrams) == []
    assert one(spark, "😀ab😀", char_ngrams) == ["😀ab", "ab😀"]


def test_sentences_and_summary(spark):
    assert one(spark, "A b. C d! E? F", sentences) == ["A b.", "C d!", "E?", "F"]
    assert one(spark, "A. B. C. D.", lambda x: extractive_summary(x, F.lit("h"))) == "A. B. C."
    assert one(spark, " \n", lambda x: extractive_summary(x, F.lit("h"))) == "h"
    assert one(spark, None, lambda x: extractive_summary(x, F.lit("h"))) == "h"
    assert one(spark, "a b  c\n", approx_tokens) == 4


def test_chunks(spark):
    assert one(spark, "Tür-\nkiye büyük.", chunk_text) == ["Türkiye büyük."]
    assert one(spark, "a proxy-risk b.", chunk_text) == ["a proxy-risk b."]
    assert one(spark, "", chunk_text) == []
    assert one(spark, None, chunk_text) == []
    text = " ".join(f"Cümle numarası {i} burada duruyor." for i in range(60))
    parts = one(spark, text, chunk_text)
    assert len(parts) > 1 and all(len(x) <= 900 for x in parts)
    assert all(a[-30:] in b for a, b in zip(parts, parts[1:]))
    table = "önce\n| a | b |\n|---|---|\n| 1 | 2 |\nsonra"
    assert one(spark, table, chunk_text) == ["önce", "| a | b |\n|---|---|\n| 1 | 2 |", "sonra"]
    assert one(spark, "x" * 2000, chunk_text) == ["x" * 2000]


def test_large_table_repeats_its_head(spark):
    rows = ["| key | value |", "|---|---|", *(f"| {i} | {'v' * 60} |" for i in range(40))]
    parts = one(spark, "\n".join(rows), chunk_table)
    assert len(parts) > 1 and all(x.split("\n")[:2] == rows[:2] for x in parts)
    assert [r for x in parts for r in x.split("\n")[2:]] == rows[2:]


def test_pages_of_chunks(spark):
    got = lambda p, n, sp, ep: spark.range(1).select(page_of(F.lit(p), F.lit(n), F.lit(sp).cast("int"), F.lit(ep).cast("int")).alias("y")).first()["y"]
    assert [got(p, 3, 2, 7) for p in range(3)] == [2, 4, 7]
    assert (got(0, 1, 5, 9), got(1, 3, None, None), got(1, 3, 0, 4), got(1, 3, 4, 4)) == (5, -1, -1, 4)


def test_replies(spark):
    assert one(spark, 'cevap: {"a": 1,} son', repair_json) == '{"a": 1}'
    assert one(spark, '<think>{"b": 9}</think>{"a": 2}', repair_json) == '{"a": 2}'
    assert one(spark, ["2", "3", "99", "x", "true", "1.5", None], lambda x: valid_ids(x, F.array(F.lit(2), F.lit(3))), "array<string>") == [2, 3]


def test_heat_class(spark):
    assert [one(spark, x, heat_class, "double") for x in (0.7, 0.5, 0.1, 0.0, None)] == ["high", "medium", "low", None, None]


def test_renumber(spark):
    text = "## 1 GİRİŞ\n## 1.1 Alt\n## 3.2.1 Derin\n## ÖZET\ngövde # değil"
    assert one(spark, text, renumber_headings) == "# 1 GİRİŞ\n## 1.1 Alt\n### 3.2.1 Derin\n# ÖZET\ngövde # değil"


def test_settings_are_used(spark):
    small = Settings(chunk_chars=20, chunk_overlap=5)
    parts = one(spark, "aaaa bbbb cccc. dddd eeee. ffff.", lambda x: chunk_text(x, small))
    assert parts == ["aaaa bbbb cccc.", "cccc. dddd eeee.", "eeee. ffff."]
