import html as html_lib
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from strataloom.llm import cluster, decontaminate, entry, html_text, language_id, near_dedup, passage_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [None, "", " ", "\n\n", "a", "7 % 3", "x" * 5000, "中文字符", "😀 !!"]
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(1, 4))) for _ in range(900)]


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def union_find(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(links):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    got = {r["id"]: r["root"] for r in cluster.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    expected = union_find(26, links)
    assert got == {x: expected[x] for a, b in links if a != b for x in (a, b)}


def grouped_sets(rng, n):
    """Sets of a large group of near copies of one set, of a second group, of copies of copies, and of strangers, all in one bucket."""
    new = iter(range(10_000, 10**9))
    edit = lambda x, k: (set(x) - set(rng.sample(sorted(x), k))) | {next(new) for _ in range(k)}
    base, other = set(range(60)), set(range(30, 90))
    sets = [base, other] + [edit(base, rng.randint(0, 14)) for _ in range(n)] + [edit(other, rng.randint(0, 14)) for _ in range(n // 2)]
    sets += [edit(rng.choice(sets), rng.randint(0, 6)) for _ in range(n // 2)]
    return sets + [{next(new) for _ in range(rng.randint(1, 40))} for _ in range(n // 4)] + [set(range(k)) for k in (1, 2, 3)]


def clustered(spark, monkeypatch, sets, weights=None, bands=None):
    monkeypatch.setattr(cluster, "FEW", 0.5)
    seen = []
    if weights is None:
        packed = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id bigint, s array<bigint>")

        def verify(pairs):
            pairs = pairs.localCheckpoint()
            seen.append(pairs.count())
            return cluster.with_contents(pairs, packed, "s").where(cluster.alike_sets(F.col("x"), F.col("y"), 0.8)).select("a", "b")

        def contrast(pairs):
            return cluster.contrast_sets(cluster.with_contents(pairs, packed, "s"), F.col("x"), F.col("y"), 0.8)
    else:
        bags = [(np.array(sorted(x), np.uint64), np.array([weights[i, k] for k in sorted(x)])) for i, x in enumerate(sets)]

        def verify(pairs):
            rows = pairs.collect()
            seen.append(len(rows))
            return spark.createDataFrame([(r["a"], r["b"]) for r in rows if near_dedup.similarity(bags[r["a"]], bags[r["b"]]) >= 0.8], "a bigint, b bigint")

        def contrast(pairs):
            rows = [(r["a"], r["b"], *near_dedup.differences(bags[r["a"]], bags[r["b"]], 0.8)) for r in pairs.collect()]
            rows = [(*r[:5], r[5].tolist(), r[6].tolist()) for r in rows]
            return spark.createDataFrame(rows, "a bigint, b bigint, linked boolean, w double, whole double, tokens array<bigint>, weights array<double>")

    bands = spark.createDataFrame(bands or [(7, i) for i in range(len(sets))], "key bigint, id bigint")
    got = {r["id"]: r["root"] for r in cluster.link_classes(cluster.shared_buckets(bands), verify, contrast, 0.8).collect()}
    return got, sum(seen)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(13)
    sets = grouped_sets(rng, 40)
    got, pairs = clustered(spark, monkeypatch, sets)
    expected = union_find(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert [got.get(i, i) for i in range(len(sets))] == expected and 3 < len(set(expected)) < len(sets) - 20
    assert pairs < len(sets) ** 2 / 8


def test_large_buckets_of_weighted_sets_lose_no_link(spark, monkeypatch):
    rng = random.Random(14)
    sets = grouped_sets(rng, 30)
    common = {k: rng.uniform(0.6, 3) for x in sets for k in x}
    weights = {(i, k): common[k] + (rng.random() < 0.1) for i, x in enumerate(sets) for k in sorted(x)}
    got, pairs = clustered(spark, monkeypatch, sets, weights)
    bags = [(np.array(sorted(x), np.uint64), np.array([weights[i, k] for k in sorted(x)])) for i, x in enumerate(sets)]
    expected = union_find(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if near_dedup.similarity(bags[a], bags[b]) >= 0.8])
    assert [got.get(i, i) for i in range(len(sets))] == expected and len(set(expected)) < len(sets) - 15
    assert pairs < len(sets) ** 2 / 4


def test_pairs_grow_with_a_group_of_near_copies(spark, monkeypatch):
    counts = []
    for n in (60, 240):
        rng = random.Random(15)
        base, new = set(range(100)), iter(range(1000, 10**9))
        # half of the copies are linked to the base, half to nothing
        sets = [base] + [(base - set(rng.sample(range(100), k))) | {next(new) for _ in range(k)} for k in (8, 18) for _ in range(n)]
        least = lambda x, k: min(hash((k, v)) for v in x)
        bands = [(hash((b, *(least(x, 3 * b + r) for r in range(3)))), i) for i, x in enumerate(sets) for b in range(8)]
        counts.append(clustered(spark, monkeypatch, sets, bands=bands)[1])
    assert counts[1] <= 6 * counts[0]


def test_among_keeps_all_that_is_wanted(spark):
    rows = spark.range(-3000, 3000).select(F.xxhash64("id").alias("h"), "id")
    wanted = rows.where("id % 50 = 0").select("h")
    kept = cluster.among(rows, "h", wanted, "h")
    assert kept.join(wanted, "h").count() == 120 and kept.count() < 200


def test_language(spark):
    texts, langs = [], []
    for lang, letters in (("aa", "abcdefgh"), ("bb", "hijklmno"), ("cc", "opqrstuv")):
        for _ in range(60):
            texts.append(" ".join("".join(RNG.choice(letters) for _ in range(5)) for _ in range(30)))
            langs.append(lang)
    rows = docs(spark, [*texts, *EDGE], [*langs, *[None] * len(EDGE)])
    model = language_id.fit(rows.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in language_id.predict(rows, model, F.col("doc_id") % 4 == 2).collect()}
    assert all(got[i]["lang_pred"] == x for i, x in enumerate(langs))
    for k, text in enumerate(EDGE):
        r = got[len(texts) + k]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1
    none = language_id.predict(rows, language_id.fit(rows.where("false")), F.lit(False))
    assert none.where("lang_pred <> 'und'").count() == 0


def test_many_languages_in_two_words():
    grams = [np.arange(i * 50, i * 50 + 50) for i in range(70)]
    model = language_id.Filter([f"l{i}" for i in range(70)], grams)
    for i in (0, 63, 64, 69):
        places = model.places(grams[i].astype(np.uint64))
        mask = model.table[i // 64][places[0]] & model.table[i // 64][places[1]] & model.table[i // 64][places[2]]
        assert ((mask >> np.uint64(i % 64)) & np.uint64(1)).all()


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav><div class='ad'>buy</div>{}<footer>&copy; x</footer></body></html>"


def test_html():
    article = "<article><h1>T &amp; t</h1><p>a <b>b\n c</b><br>d<p>e&nbsp;f<ul><li>g<li>h</ul><aside>no</aside><form>no</form><div class='comments'>no</div></article>"
    kept = lambda page: [x for x, good, _ in html_text.blocks(page) if good]
    assert kept(PAGE.format(article)) == ["T & t", "a b c d", "e f", "g", "h"]
    assert kept("plain <  text &lt;b&gt;") == ["plain < text <b>"]
    assert kept(None) == kept("") == kept("<!-- only") == []
    assert kept('<p hidden>x<p aria-hidden="true">y<p style="display: none">z<p>ok') == ["ok"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=9), st.lists(st.sampled_from("abcde"), max_size=9))
def test_longest_common_lines(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = sorted(html_text.shared(a, b))
    rest = iter(b)
    assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


def test_page_differencing(spark):
    body = lambda x: f"<html><body><p>Welcome to the site</p><p>{x}</p><p>All about us</p></body></html>"
    rows = [(0, "http://h/a/1", body("first text of this page")), (1, "http://h/a/2?q", body("second text of that page")), (2, "http://other/a/1", body("third")), (3, None, None), (4, "http://h/z", PAGE.format("<article><p>Welcome to the site</p><p>own</p></article>")), (5, "http://c/1", body("copied")), (6, "http://c/2", body("copied"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_text.extract(pages.coalesce(1)).collect()}
    assert len(got) == 7 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert (got[3]["text"], got[3]["url"]) == ("", None)
    assert got[4]["text"] == "Welcome to the site\nown"
    # copies keep their text, whatever they share
    assert got[5]["text"] == got[6]["text"] == "Welcome to the site\ncopied\nAll about us"
    assert html_text.extract(pages.limit(0)).count() == 0
    assert html_lib.unescape("&amp;") == "&"


def test_differencing_inside_the_article_whatever_the_partitions(spark):
    page = lambda k, more: f"<html><body><main><p>Shared head line</p><h1>Title {k}</h1><p>{prose(20, random.Random(k))}</p><p>Read our other pages</p>{more}</main></body></html>"
    quoted = "<p>a sentence that two of the articles quote</p>"
    rows = [(k, f"http://h/a/{k:04}", page(k, quoted if k % 4 == 0 else "")) for k in range(600)] + [(600, "http://h/a/0003x", page(3, "")), (601, None, None), (601, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    results = []
    for n in (1, 8, 64):
        results.append(sorted((r["page_id"], r["text"]) for r in html_text.extract(pages.repartition(n)).collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)
    for k, text in results[0][:600]:
        assert text == f"Title {k}\n{prose(20, random.Random(k))}" + "\na sentence that two of the articles quote" * (k % 4 == 0)


def plain_template(pages):
    """Deleted places by page, with all neighbours looked up in plain lists and a quadratic alignment."""
    order, out = sorted(range(len(pages)), key=lambda k: (pages[k]["host"], pages[k]["path"], k)), {}
    for at, k in enumerate(order):
        page = pages[k]
        sides = [order[at + d] for d in (-1, 1, -2, 2) if 0 <= at + d < len(order) and pages[order[at + d]]["host"] == page["host"]]
        sides.sort(key=lambda j: -html_text.near(pages[j]["path"], page["path"]))
        total, seen = sum(s for s, g in zip(page["size"], page["good"]) if g), []
        for j in sides:
            common = html_text.shared(page["line"], pages[j]["line"])
            if sum(page["size"][i] for i in common if page["good"][i]) <= html_text.COPY * total:
                seen.append(common)
        out[k] = [i for i, g in enumerate(page["good"]) if g and seen and i in seen[0] and (not page["main"][i] or len(seen) > 1 and i in seen[1])]
    return out


def test_differencing_against_plain_lists(spark):
    rng = random.Random(41)
    lines = [f"line number {i} of all" for i in range(12)]
    rows = []
    for k in range(300):
        body = "".join(f"<{t}>{rng.choice(lines) if rng.random() < 0.4 else prose(8, rng)}</{t}>" for t in rng.choices(["p", "div", "h2"], k=rng.randint(1, 8)))
        rows.append((k, f"http://h{rng.randint(0, 3)}/{k:05}", f"<body><p>{rng.choice(lines)}</p><main>{body}</main></body>"))
    pages = []
    for _, url, page in rows:
        found = html_text.blocks(page)
        pages.append({"host": url.split("/")[2], "path": "/" + url.split("/")[3], "line": [t for t, _, _ in found], "size": [len(t) for t, _, _ in found], "good": [g for _, g, _ in found], "main": [m for _, _, m in found]})
    gone = plain_template(pages)
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert any(gone.values()) and got == {k: html_text.result(rows[k][2], gone[k]) for k in got}


def test_markup_of_all_kinds():
    kept = lambda page: [x for x, good, _ in html_text.blocks(page) if good]
    assert kept("<p title=it's>hello <b>w</b></p>") == ["hello w"]
    assert kept("<form><div><p>the whole article stands in a form</p></div></form><nav>menu</nav>") == ["the whole article stands in a form"]
    assert kept('<div class="post-header"><h1>Title</h1><p>lead</p></div><p class="related">text</p><p class="ad">buy</p>') == ["Title", "lead", "text"]
    assert kept("<p>long enough text of a page<div class=sidebar>beside</div><svg><p>after</p>") == ["long enough text of a page", "after"]
    for page in ("<p '" * 1_200_000, "<!" * 500_000, "<div>" * 200_000 + "</span></p>" * 200_000, "<svg>" * 300_000, "<p a=\"" * 300_000, "<" * 1_000_000):
        start = time.time()
        html_text.blocks(page)
        assert time.time() - start < 8


def near_texts():
    rng = random.Random(5)
    texts = [*EDGE, *EDGE]
    for _ in range(40):
        words = prose(rng.randint(20, 160), rng).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates_against_all_pairs(spark):
    texts = near_texts()
    rows = docs(spark, texts)
    weights = near_dedup.document_weights(rows)
    bags = []
    for t in texts:
        shingle, count = near_dedup.bag(t)
        bags.append((shingle, count * weights[(shingle >> np.uint64(20)).astype(np.int64) & (near_dedup.FEATURES - 1)]))
    same = [(a, b) for a in range(len(texts)) for b in range(a) if (texts[a] or "") == (texts[b] or "")]
    links = lambda least: [(a, b) for a in range(len(texts)) for b in range(a) if near_dedup.similarity(bags[a], bags[b]) >= least]
    expected = union_find(len(texts), same + links(0.8))
    got = {r["i"]: r["class_id"] for r in near_dedup.classes(rows).collect()}
    assert len(got) == len(texts)
    wrong = sum(got[i] != expected[i] for i in got)
    assert wrong <= 1
    kept = {r["doc_id"] for r in near_dedup.keep_one(rows.withColumn("h1", F.lit(0))).collect()}
    assert kept == {i for i in got if got[i] == i}
    # twice the rows have other document frequencies, so a pair at the threshold may change sides
    twice = [r["doc_id"] for r in near_dedup.keep_one(rows.unionByName(rows)).collect()]
    assert len(twice) == len(set(twice)) and abs(len(twice) - len(kept)) <= 2
    assert near_dedup.classes(rows.limit(0)).count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(1)
    shingles = np.sort(rng.integers(1, 2**63, 300).astype(np.uint64))
    a, b = rng.random(300) + 0.2, rng.random(300) + 0.2
    got = near_dedup.samples(np.concatenate([shingles, shingles]), np.concatenate([a, b]).astype(np.float32), np.array([0, 300, 600]), 1500)
    assert (got[:, 0] == got[:, 1]).mean() == pytest.approx(near_dedup.similarity((shingles, a), (shingles, b)), abs=0.05)


def test_passages(spark):
    rng = random.Random(31)
    passage = [prose(60, rng) for _ in range(6)]
    texts = [prose(90, rng) + " " + passage[i % 6] + " " + prose(50, rng) for i in range(12)] + [prose(150, rng) for _ in range(20)] + EDGE
    line = prose(80, rng)
    texts += [line, line.replace(line.split()[40], "changed"), "own words. " + passage[0] + "\n" + prose(30, rng) + " " + passage[0], "loop " * 300]
    rows = docs(spark, texts).withColumn("k0", F.lit("clash"))
    got = defaultdict(list)
    for r in passage_dedup.removed_spans(rows).collect():
        got[r["doc_id"]].append(r)
    n = len(texts)
    covered = lambda i: {w for r in got[i] for w in range(r["first_word"], r["last_word"] + 1)}
    assert set(got) == {*range(6, 12), n - 3, n - 2, n - 1}
    for i in range(6, 12):
        assert {x for r in got[i] for x in r["keep_doc_ids"]} == {i - 6}
        # the whole passage, and a neighbour only if it happens to be equal
        assert covered(i) >= set(range(90, 150)) and len(covered(i)) <= 62
    assert covered(n - 3) == set(range(80)) and covered(n - 2) == {*range(2, 62), *range(92, 152)}
    # of a text that repeats itself the first copy stays
    assert 0 not in covered(n - 1) and max(covered(n - 1)) == 299 and min(covered(n - 1)) >= passage_dedup.BLOCK
    assert passage_dedup.removed_spans(rows.unionByName(rows)).count() == sum(map(len, got.values()))
    assert passage_dedup.removed_spans(rows.limit(0)).count() == 0


def test_paragraphs_against_all_pairs(spark):
    rng = random.Random(32)
    lines = []
    for _ in range(150):
        words = prose(rng.randint(3, 70), rng).split()
        lines.append(words)
        for _ in range(rng.randint(0, 2)):
            lines.append([w if rng.random() > 0.02 else rng.choice(VOCABULARY) for w in words])
    rng.shuffle(lines)
    rows = docs(spark, [" ".join(x) for x in lines])
    bags = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if bags[a] and bags[b] and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])]
    root = union_find(len(lines), links)
    expected = {i: r for i, r in enumerate(root) if i != r}
    got = {r["i"]: r["keep_i"] for r in passage_dedup.paragraph_classes(passage_dedup.sketches(rows).where("k0 is not null"), rows.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("th"), F.col("text").alias("t"))).collect()}
    assert got.items() <= expected.items() and len(got) >= 0.98 * len(expected) > 50


def test_any_long_passage_shares_a_block():
    from strataloom.llm.common import hash_words

    rng = random.Random(9)
    for _ in range(60):
        shared = prose(passage_dedup.NEAR + passage_dedup.BLOCK - 1, rng).split()
        befores = [prose(rng.randint(0, 60), rng).split() for _ in range(3)]
        texts = [b + shared + prose(rng.randint(0, 60), rng).split() for b in befores]
        owner, at = passage_dedup.blocks(hash_words([w for t in texts for w in t]), np.array([len(t) for t in texts]))
        starts = [{x - len(b) for x in at[owner == k].tolist() if 0 <= x - len(b) < passage_dedup.NEAR} for k, b in enumerate(befores)]
        assert starts[0] & starts[1] & starts[2]


def test_decontamination(spark):
    items = [(0, "If a train runs 60 km in 2 hours then how far does Anna Smith get in 5 hours on it?"), (1, prose(30)), (2, None), (3, ""), (4, "only four short words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("h", F.lit(1))
    texts = [
        prose(40) + ". If a train runs 75 km in 3 hours then how far does Bob Jones get in 8 hours on it? " + prose(20),
        prose(40) + " " + items[1][1] + " " + prose(10),
        "If a train runs 75 km in 75 hours then how far does Bob Jones get in 75 hours on it?",
        prose(200),
        "so: only four short words",
        *EDGE,
    ]
    rows = docs(spark, texts).withColumn("_i", F.lit(0))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(rows, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 0), (4, 4)}
    assert got[0, 0]["n_changed"] > 0 and got[1, 1]["n_changed"] == 0 and got[1, 1]["coverage"] == 1
    # 2 in the item meets 3 and then 4: the slots contradict each other
    twice = spark.createDataFrame([(0, "take 2 of the red balls and then take 2 of the blue balls away")], "item_id bigint, text string")
    odd = docs(spark, ["take 3 of the red balls and then take 4 of the blue balls away", "take 3 of the red balls and then take 3 of the blue balls away"])
    assert [r["doc_id"] for r in decontaminate.leaks(odd, twice).collect()] == [1]
    kept = decontaminate.decontaminate(rows, bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {0, 1, 2, 4} and kept.columns == rows.columns
    assert decontaminate.decontaminate(rows, bench.limit(0)).count() == len(texts)
    assert decontaminate.leaks(rows.limit(0), bench).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    leak = prose(40, rng)
    texts = [prose(120, rng) for _ in range(30)]
    texts += [texts[0], texts[1].replace(texts[1].split()[60], "other"), prose(80, rng) + " " + leak, " ".join(["same words again"] * 60), "short", None, ""]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(10)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # the copies lose their only line and become empty; of empty texts one stays
    assert set(range(30)) <= set(got) and not {32, 33, 34, 35, 36} & set(got) and len(set(got) & {30, 31}) == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"]


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(entry.queries()) | {"pipeline"} <= names and {x.split("_")[0] for x in entry.queries()} == {f"op{i}" for i in range(1, 14)}
