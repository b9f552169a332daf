import pytest
from pyspark.sql import functions as F

from strataloom.config import Settings
from strataloom.operators import tree

MD = "# Bölüm 1: Giriş\ngiriş metni\n## Alt Bölüm 1.1: Amaç\namaç\n## Alt Bölüm 1.2: Kapsam\nkapsam\n### Detay 1.2.1: Algoritma\nadımlar\n# Bölüm 2: Sonuç\nson"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "document_id bigint, text string")


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("document_id", "node_id").collect()]


def test_levels_parents_and_paths(spark):
    nodes = tree.markdown_tree(docs(spark, MD))
    assert rows(nodes, "node_id", "level", "parent_id", "is_leaf") == [(1, 1, None, 0), (2, 2, 1, 1), (3, 2, 1, 0), (4, 3, 3, 1), (5, 1, None, 1)]
    assert rows(nodes, "path")[3][0] == "Bölüm 1: Giriş > Alt Bölüm 1.2: Kapsam > Detay 1.2.1: Algoritma"
    assert rows(nodes, "content", "start_line", "end_line")[3] == ("adımlar", 7, 8)


def test_edges_of_documents(spark):
    nodes = tree.markdown_tree(docs(spark, None, "", "\n\nyalnız metin\n", "###### altı\n   ## Girintili\nx", "önce\n# H\n<!-- Page 3 -->\ny"))
    got = rows(nodes, "document_id", "node_id", "heading", "content", "start_page", "end_page")
    assert got == [
        (0, 1, "Belge İçeriği", "", 1, 1),
        (1, 1, "Belge İçeriği", "", 1, 1),
        (2, 1, "Giriş", "yalnız metin", 1, 1),
        (3, 1, "Giriş", "###### altı", 1, 1),
        (3, 2, "Girintili", "x", 1, 1),
        (4, 1, "Giriş", "önce", 1, 1),
        (4, 2, "H", "y", 1, 3),
    ]


def test_fold_and_noise(spark):
    deep = docs(spark, "# A\na\n## B\nb\n### C\nc\n#### D\nd\n# İçindekiler\nx\n## Kalan\ny")
    nodes = tree.markdown_tree(deep, Settings(max_tree_depth=3))
    assert rows(nodes, "node_id", "parent_id", "is_leaf", "content") == [(1, None, 0, "a"), (2, 1, 0, "b"), (3, 2, 1, "c\n\n#### D\nd"), (6, None, 1, "y")]
    assert rows(nodes, "path")[3][0] == "İçindekiler > Kalan"


def test_raw_nodes(spark):
    raw = spark.createDataFrame([(0, 1, "A", 1, "a", 1, 2), (0, 2, "B", 2, "b", 2, 3), (0, 3, "C", 1, "c", 4, None)], "document_id bigint, seq int, heading string, level int, content string, start_page int, end_page int")
    assert rows(tree.tree_from_raw(raw), "parent_id", "is_leaf", "start_line") == [(None, 0, None), (1, 1, None), (None, 1, None)]


def test_walks(spark):
    nodes = spark.createDataFrame([(0, 1, None), (0, 5, None), (0, 2, 1), (0, 3, 1), (0, 4, 3)], "document_id bigint, node_id int, parent_id int")
    roots = spark.createDataFrame([(0, 0, 1), (1, 0, 5)], "query_id bigint, document_id bigint, root int")
    got = {(r["query_id"], r["node_id"]) for r in tree.subtree(nodes, roots).collect()}
    assert got == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 5)}
    assert [r["node_id"] for r in tree.children(nodes, None).collect()] == [1, 5]
    assert [r["node_id"] for r in tree.children(nodes, 1).collect()] == [2, 3]


def test_abstracts_and_gate(spark):
    nodes = spark.createDataFrame([(0, i, h) for i, h in enumerate([" Özet ", "ABSTRACT", "Other"])] + [(1, i, "x") for i in range(40)], "document_id bigint, node_id int, heading string")
    assert [r["node_id"] for r in tree.abstract_nodes(nodes).orderBy("node_id").collect()] == [0, 1]
    assert [r["document_id"] for r in tree.worth_descending(nodes).collect()] == [1]


@pytest.mark.parametrize("levels", [[1, 3, 2, 5, 4, 1], [2, 2, 1, 4, 3, 3, 2, 5]])
def test_parents_like_a_stack(spark, levels):
    raw = spark.createDataFrame([(0, i, str(i), v, "", 1, 1) for i, v in enumerate(levels)], "document_id bigint, seq int, heading string, level int, content string, start_page int, end_page int")
    expected, stack = [], []
    for i, v in enumerate(levels, 1):
        while stack and stack[-1][1] >= v:
            stack.pop()
        expected.append(stack[-1][0] if stack else None)
        stack.append((i, v))
    assert [r[0] for r in rows(tree.tree_from_raw(raw.withColumn("level", F.col("level"))), "parent_id")] == expected


def test_deep_chains(spark):
    nodes = spark.createDataFrame([(0, i, i - 1 if i else None) for i in range(21)], "document_id bigint, node_id int, parent_id int")
    got = {r["node_id"]: r["up"] for r in tree.ancestors(nodes).collect()}
    assert got == {i: list(range(i, -1, -1)) for i in range(21)}
    circle = spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "document_id bigint, node_id int, parent_id int")
    with pytest.raises(ValueError):
        tree.ancestors(circle)


def test_intervals_of_any_forest(spark):
    import random

    r = random.Random(4)
    links, below, order = [], {}, {}
    for d in range(12):
        n = r.choice([1, 2, 9, 40])
        ids = r.sample(range(1000), n)
        parent = {v: (r.choice([None, *ids[:k], *ids[max(0, k - 1) : k]]) if k else r.choice([None, 5000])) for k, v in enumerate(ids)}
        links += [(d, v, p) for v, p in parent.items()]

        def walk(v, d=d, parent=parent):
            order[d, v] = len([1 for x in order if x[0] == d]) + 1
            kids = sorted(x for x, p in parent.items() if p == v)
            below[d, v] = {v}.union(*[walk(x) for x in kids]) if kids else {v}
            return below[d, v]

        for v in sorted(v for v, p in parent.items() if p not in parent):
            walk(v)
    nodes = spark.createDataFrame(links, "document_id bigint, node_id int, parent_id int")
    numbered = tree.intervals(nodes)
    got = {(x.document_id, x.node_id): (x.first, x.last, x.n_below) for x in numbered.collect()}
    assert got == {k: (order[k], order[k] + len(below[k]) - 1, len(below[k])) for k in below}
    roots = nodes.where("node_id % 3 = 0").select("document_id", F.col("node_id").alias("root"), F.col("node_id").alias("top"))
    assert {tuple(x) for x in tree.below(numbered, roots).select("document_id", "top", "node_id").collect()} == {(d, v, x) for (d, v), xs in below.items() if v % 3 == 0 for x in xs}
    assert tree.intervals(nodes.limit(0)).count() == 0
    chain = spark.range(3000).select(F.lit(0).cast("bigint").alias("document_id"), F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert tree.intervals(chain).agg(F.sum("n_below"), F.max("last")).first()[:] == (3000 * 3001 // 2, 3000)
    circle = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 2, None)], "document_id bigint, node_id int, parent_id int")
    with pytest.raises(ValueError):
        tree.intervals(circle)


def test_any_levels(spark):
    raw = lambda levels: spark.createDataFrame([(0, i, str(i), v, "", 1, 1) for i, v in enumerate(levels)], "document_id bigint, seq int, heading string, level int, content string, start_page int, end_page int")
    assert rows(tree.tree_from_raw(raw([3, 40, 900, 40, 17, 0]), Settings(max_tree_depth=1000)), "parent_id", "path") == [(None, "0"), (1, "0 > 1"), (2, "0 > 1 > 2"), (1, "0 > 3"), (1, "0 > 4"), (None, "5")]
    with pytest.raises(ValueError):
        tree.with_parents(raw(range(1, tree.MAX_LEVELS + 2)))


def test_raw_nodes_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tree, "TASK_NODES", 10, raising=False)
    raw = spark.range(100).select((F.col("id") % 20).alias("document_id"), F.col("id").alias("seq"), (F.col("id") % 3 + 1).cast("int").alias("level"), F.lit("h").alias("heading"), F.lit("c").alias("content"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"))
    nodes = tree.tree_from_raw(raw)
    assert nodes.count() == 100 and nodes.rdd.getNumPartitions() == 11
