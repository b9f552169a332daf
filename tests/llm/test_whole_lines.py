import random
from collections import defaultdict

from pyspark.sql import functions as F

from strataloom.llm import line_dedup


def grams(line):
    """All runs of 9 code points, or the line if it is shorter."""
    return {line[i : i + 9] for i in range(max(1, len(line) - 8))}


def texts():
    rng = random.Random(21)
    letters = "abcdefghijklmnop日本語😀é"
    base = ["".join(rng.choice(letters) + " " * (rng.random() < 0.15) for _ in range(rng.randint(5, 160))).strip() for _ in range(60)]
    out = [
        *["The committee will publish the final report in March" + x for x in ("", ".")],
        *[x + "https://example.org/articles/archive/years/months/some-long-page-name.html" for x in ("", "(")],
    ]
    for line in base:
        at = rng.randrange(len(line))
        out += [line, line[:at] + rng.choice(letters) + line[at + 1 :]]
    return out


def test_lines_against_all_character_ngrams(spark):
    lines = [x.strip(" \t") for x in texts()]
    bags = [grams(x.lower()) for x in lines]
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b]):
                root = [root[b] if x == root[a] else x for x in root]
    groups = defaultdict(list)
    for i, x in enumerate(root):
        groups[x].append(i)
    expected = {i: min(g) for g in groups.values() if len(g) > 1 for i in g}
    assert {0, 1, 2, 3} <= set(expected)
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r["i"]: r["keep_i"] for r in line_dedup.classes(rows).collect()}
    assert got.items() <= expected.items() and len(got) >= 0.98 * len(expected) and got[1] == 0 and got[3] == 2


def test_shingles_are_all_ngrams(spark):
    lines = [x.lower() for x in texts()] + ["a", "12345678", "123456789", "1234567890", "😀" * 8, "😀" * 10]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in rows.select("line", line_dedup.shingles(rows["line"]).alias("s")).collect():
        assert set(r["s"]) == grams(r["line"]) and len(r["s"]) == max(1, len(r["line"]) - 8)


def test_shingle_rows_are_all_ngrams(spark):
    lines = [x.lower() for x in texts()] + ["a", "12345678", "123456789", *("x日😀" * n for n in (13, 14, 27, 400)), "ab" * 5000]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = line_dedup.shingle_rows(rows, "i").groupBy("i").agg(F.sort_array(F.collect_list("s")).alias("s"))
    each = rows.select("i", F.sort_array(F.transform(line_dedup.shingles(rows["line"]), lambda x: F.xxhash64(x))).alias("expected"))
    pairs = each.join(got, "i").collect()
    assert len(pairs) == len(lines) and all(r["s"] == r["expected"] for r in pairs)


def test_bands_meet_often_enough(spark):
    """Lines of similarity 0.8 to 0.83 share a band in at least 0.98 of 400 pairs; lines of no common shingle never do."""
    rng = random.Random(5)
    pairs = []
    while len(pairs) < 400:
        x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(60, 220)))
        y = x
        while len(grams(x) & grams(y)) >= 0.83 * len(grams(x) | grams(y)):
            at = rng.randrange(len(y))
            y = y[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + y[at + 1 :]
        if len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y)):
            pairs.append((x, y))
    rows = spark.createDataFrame([(i, side, 1, x) for i, p in enumerate(pairs) for side, x in enumerate(p)], "h1 bigint, h2 bigint, n bigint, line string")
    keys = {(r["h1"], r["h2"]): {r[f"k{b}"] for b in range(line_dedup.BANDS)} for r in line_dedup.band_keys(rows).collect()}
    assert sum(bool(keys[i, 0] & keys[i, 1]) for i in range(400)) >= 0.98 * 400
    assert not any(keys[i, 0] & keys[i + 1, 0] for i in range(399))


def test_null_ids_come_first_and_repeated_rows_agree(spark, tmp_path):
    line = "one and the same long line of words that stands in several documents"
    rows = [(None, f"{line}\nowner\n{line}"), (1, f"first\n{line}"), (2, f"second\n{line}"), (2, f"second\n{line}"), (3, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted([("None", f"{line}\nowner"), ("1", "first"), ("2", "second"), ("2", "second"), ("3", "None"), ("None", "")])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    # the second line of the repeated row stands in both of its rows
    assert sorted(str(r.doc_id) for r in line_dedup.op5_line_dedup(spark, str(tmp_path)).collect() if r.kept) == ["2", "2", "None"]
