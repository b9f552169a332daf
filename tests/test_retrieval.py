import math

from pyspark.sql import functions as F

from strataloom.config import Settings
from strataloom.operators import context, descent, evaluate, retrieve


def candidates(spark, query, *docs):
    return spark.createDataFrame([(0, f"c{i}", query, d, s) for i, (d, s) in enumerate(docs)], "query_id bigint, chunk_id string, query string, content string, similarity double")


def test_bm25_against_plain_python(spark):
    docs = ["kedi köpek kuş kedi", "köpek köpek balık", "kuş", ""]
    got = {r["chunk_id"]: r["bm25"] for r in retrieve.lexical_scores(candidates(spark, "Kedi kuş kedi", *[(d, 0.5) for d in docs])).collect()}
    toks = [d.replace("ö", "o").replace("ş", "s").split() for d in docs]
    avg = sum(map(len, toks)) / len(toks)
    for i, t in enumerate(toks):
        score = 0.0
        for q in {"kedi", "kus"}:
            df, tf = sum(q in x for x in toks), t.count(q)
            score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(len(t), 1) / avg))
        assert abs(got[f"c{i}"] - score) < 1e-9


def test_rerank_prefers_words_and_is_stable(spark):
    got = retrieve.rerank(candidates(spark, "hangi arşiv", ("bambaşka metin", 0.5), ("devlet arşivinden belgeler", 0.5), ("bambaşka metin", 0.5)), 3).orderBy("hybrid_rank").collect()
    assert [r["chunk_id"] for r in got] == ["c1", "c0", "c2"]


def test_vectors_scope_and_zero(spark):
    passages = spark.createDataFrame([(0, 1, "a", [1.0, 0.0]), (0, 2, "b", [0.6, 0.8]), (0, 3, "z", [0.0, 0.0]), (9, 1, "x", [1.0, 0.0])], "document_id bigint, node_id int, chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [-1.0, 0.0])], "query_id bigint, document_id bigint, query_vector array<float>")
    got = {(r["query_id"], r["chunk_id"]): r["similarity"] for r in retrieve.nearest(queries, passages, 5).collect()}
    assert got == {(0, "a"): 1.0, (0, "b"): 0.6, (0, "z"): 0.0, (1, "a"): 0.0, (1, "b"): 0.0, (1, "z"): 0.0}
    scope = spark.createDataFrame([(0, 2)], "query_id bigint, node_id int")
    assert {(r["query_id"], r["chunk_id"]) for r in retrieve.nearest(queries, passages, 1, scope).collect()} == {(0, "b"), (1, "a")}


def tree(spark):
    return spark.createDataFrame([(0, 1, None), (0, 2, 1), (0, 3, 1), (0, 4, 3)], "document_id bigint, node_id int, parent_id int")


def test_heat(spark):
    hits = spark.createDataFrame([(0, 0, 4, 0.9, 1), (0, 0, 2, 0.3, 2), (0, 0, 2, 0.2, 3)], "query_id bigint, document_id bigint, node_id int, hybrid_score double, hybrid_rank int")
    heat = retrieve.heat_map(hits)
    assert {r["node_id"]: r["heat"] for r in heat.collect()} == {4: 0.9, 2: 0.33}
    assert {r["node_id"]: r["heat"] for r in retrieve.spread_heat(heat, tree(spark)).collect()} == {1: 0.9, 2: 0.33, 3: 0.9, 4: 0.9}


def frontier_tree(spark, summary="s"):
    rows = [(0, 1, None, 1, 0), (0, 2, 1, 2, 1), (0, 3, 1, 2, 0), (0, 4, 3, 3, 1), (0, 5, None, 1, 1)]
    return spark.createDataFrame([(*r, f"h{r[1]}", summary) for r in rows], "document_id bigint, node_id int, parent_id int, level int, is_leaf int, heading string, summary string")


def scripted(spark, rounds):
    def decide(frontier, step):
        replies = [(0, *rounds[step])] if step < len(rounds) else []
        return spark.createDataFrame(replies, "query_id bigint, select array<string>, descend array<string>, confidence string")

    return decide


def walk(spark, rounds):
    queries = spark.createDataFrame([(0, 0)], "query_id bigint, document_id bigint")
    heat = spark.createDataFrame([(0, 1, 0.5)], "query_id bigint, node_id int, heat double")
    targets, opened, sure = descent.descend(frontier_tree(spark), queries, heat, scripted(spark, rounds))
    ids = lambda df: {r["node_id"] for r in df.collect()}
    return ids(targets), ids(opened), [r["confidence"] for r in sure.collect()]


def test_descent_by_script(spark):
    assert walk(spark, [([], ["1"], "HIGH"), (["2", "99", "x"], ["3"], "HIGH"), (["4"], [], "HIGH")]) == ({2, 4}, {1, 3}, ["HIGH"])
    assert walk(spark, []) == (set(), set(), ["LOW"])
    assert walk(spark, [([], ["5"], "HIGH")]) == ({5}, set(), ["HIGH"])


def test_descent_by_a_model(spark):
    class Scripted:
        """Replies by what the prompt shows; the first one of a round cannot be read."""

        def generate(self, prompt, json_mode=False, temperature=None):
            if not json_mode:
                return "hm"
            assert "Question: where" in prompt
            return '{"select": ["2", 99], "descend": [3], "confidence": "high",}' if "[ID:2]" in prompt else '{"select": [4], "descend": []}' if "[ID:4]" in prompt else '{"descend": [1, "5"]}'

    queries = spark.createDataFrame([(0, 0, "where")], "query_id bigint, document_id bigint, query string")
    heat = spark.createDataFrame([(0, 1, 0.5)], "query_id bigint, node_id int, heat double")
    targets, opened, sure = descent.descend(frontier_tree(spark), queries, heat, descent.model_navigator(Scripted()))
    assert {r["node_id"] for r in targets.collect()} == {5, 2, 4} and {r["node_id"] for r in opened.collect()} == {1, 3}
    assert [r["confidence"] for r in sure.collect()] == ["MEDIUM"]


def test_frontier_and_prompt(spark):
    wide = spark.createDataFrame([(0, i, {49: 0.9, 10: 0.8}.get(i)) for i in range(50)], "query_id bigint, node_id int, heat double")
    kept = {r["node_id"] for r in descent.cap_frontier(wide, Settings(frontier_cap=5)).collect()}
    assert kept == {49, 10, 0, 1, 2}
    prompt = descent.descent_prompt(frontier_tree(spark, "a\nb").withColumn("query_id", F.lit(0)).withColumn("heat", F.lit(0.5))).first()["prompt"]
    assert "[ID:2] h2 (leaf)[50%]\n    özet: a b" in prompt


def test_heat_alone_sees_a_wide_frontier_whole(spark):
    rows = [(0, i, None, 1, 1, "h") for i in range(1, 41)]
    nodes = spark.createDataFrame(rows, "document_id bigint, node_id int, parent_id int, level int, is_leaf int, heading string")
    heat = nodes.select(F.col("document_id").alias("query_id"), "node_id", F.lit(0.9).alias("heat"))
    queries = spark.createDataFrame([(0, 0)], "query_id bigint, document_id bigint")
    targets, _, _ = descent.descend(nodes, queries, heat, descent.heat_navigator(0.6))
    assert {r["node_id"] for r in targets.collect()} == set(range(1, 41))


def test_packing(spark):
    blocks = spark.createDataFrame([(0, 1, "a b c"), (0, 2, "w " * 20), (0, 3, "d e")], "query_id bigint, ord int, block string")
    got = context.pack_fitting(blocks, 8).first()
    assert (got["blocks"], got["used"]) == (["a b c", "d e"], 6)
    assert [r["ord"] for r in context.pack_prefix(blocks, 8).collect()] == [1]


def test_answers(spark):
    row = spark.createDataFrame([(" ", ["a", "b", "c", "d"]), (" ja ", ["a"]), (None, [])], "said string, blocks array<string>")
    assert [r[0] for r in row.select(context.answer(F.col("said"), F.col("blocks"))).collect()] == ["a\n\nb\n\nc", "ja", None]


def test_golden(spark):
    cases = spark.createDataFrame([("full", ["Evet"], None, [1], [1, 2], " EVET   tabii", 1.0), ("full", ["x"], None, None, [], "y", 3.0), ("flat", [], ["yok"], [1], [], "bu YOK", 1.0)], "mode string, expect_any array<string>, forbid_any array<string>, expected_node_ids array<bigint>, selected_node_ids array<bigint>, answer string, latency double")
    got = {r["mode"]: (r["n"], r["n_passed"], r["n_routed"], r["n_routable"], r["mean_latency"]) for r in evaluate.summary(evaluate.judge(cases)).collect()}
    assert got == {"full": (2, 1, 1, 1, 2.0), "flat": (1, 0, 0, 1, 1.0)}
    assert evaluate.ablation_delta(evaluate.summary(evaluate.judge(cases))).first()["delta"] == 0.5
    assert "| full | 2 | 1 |" in evaluate.report(evaluate.summary(evaluate.judge(cases)))
