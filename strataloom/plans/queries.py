"""The operators as queries over the tables. Each has SQL of its own in plans.oracle.

Trees come from the tables: every document becomes Markdown with a heading before each third line; region, nation, customer and order form
a tree as well. Questions are the benchmark's texts, each asked of one source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings
from ..functions.text import approx_tokens, char_ngrams, extractive_summary, fold, heat_class, repair_json, tokens, valid_ids, words
from ..operators import chunk, context, evaluate, layout, retrieve, tree, vectors
from ..operators import descent as descent_module
from ..operators.checkpoints import cut, shared_folder
from ..sources.store import Store


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def markdown_docs(spark: SparkSession, sf: str) -> DataFrame:
    """(document_id, text): a heading of level 1 to 4 before each third line, a page mark before each fifth."""

    def line(x, i):
        level = F.element_at(F.array(*[F.lit(n) for n in (1, 2, 3, 2, 4)]), (F.floor(i / 3) % 5 + 1).cast("int"))
        page = F.when(i % 5 == 0, F.concat(F.lit("<!-- Page "), (F.floor(i / 5) + 1).cast("string"), F.lit(" -->\n"))).otherwise("")
        head = F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.when(i % 15 == 12, F.lit("İçindekiler")).otherwise(F.concat(F.lit("Part "), i.cast("string"))), F.lit("\n"))).otherwise("")
        return F.concat(page, head, x)

    docs = read(spark, sf, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("document_id"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def _tree(spark, sf, settings: Settings = DEFAULT):
    return cut(tree.markdown_tree(markdown_docs(spark, sf), settings))


def text_features(spark, sf):
    docs = read(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(fold(F.col("text")).cast("binary")).alias("folded"), F.size(tokens(F.col("text"))).alias("n_tokens"), approx_tokens(F.col("text")).alias("approx_tokens"), F.size(words(F.col("text"))).alias("n_words"))


def ngram_counts(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.size(char_ngrams(F.col("text"))).alias("n_grams"))


def summaries(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", extractive_summary(F.col("text"), F.col("source")).alias("summary"))


def chunks(spark, sf):
    docs = read(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(chunk.chunk_text(F.regexp_replace("text", r"(?m)^\s*\|", "-"))).alias("p_idx", "content"))


def table_chunks(spark, sf):
    """Lines of each brand's parts as one table a part type."""
    rows = read(spark, sf, "part").select(F.split("p_type", " ")[0].alias("kind"), "p_partkey", F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), F.col("p_name"), F.lit(" |")).alias("row")).where("p_name is not null")
    grouped = rows.groupBy("kind").agg(F.array_join(F.concat(F.array(F.lit("| key | name |"), F.lit("|---|---|")), F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda x: x["row"])), "\n").alias("t"))
    return grouped.select("kind", F.posexplode(chunk.chunk_table(F.col("t"))).alias("p_idx", "content"))


def markdown_sections(spark, sf):
    nodes = tree.with_parents(tree.raw_sections(markdown_docs(spark, sf)), tree.MARKDOWN_LEVELS)
    return nodes.select("document_id", "node_id", "level", "heading", "parent_id", "path", "start_line", "end_line", "start_page", "end_page", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def folded_tree(spark, sf):
    """Without noise headings and folded to depth 2."""
    nodes = tree.markdown_tree(markdown_docs(spark, sf), Settings(max_tree_depth=2))
    return nodes.select("document_id", "node_id", "level", "parent_id", "is_leaf", "end_page", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def tree_stats(spark, sf):
    return tree.level_histogram(_tree(spark, sf)).select("level", "n", "leaves")


def subtree_sizes(spark, sf):
    nodes = _tree(spark, sf)
    every = nodes.select("document_id", F.col("node_id").alias("root"), F.col("node_id").alias("top"))
    return tree.subtree(nodes, every).groupBy("document_id", F.col("top").alias("node_id")).agg(F.count(F.lit(1)).alias("n_below"))


def descent_gate(spark, sf):
    return tree.worth_descending(_tree(spark, sf))


def node_chunks(spark, sf):
    """Chunks of sections with their apportioned pages."""
    return chunk.chunk_nodes(_tree(spark, sf)).select("chunk_id", "document_id", "node_id", "p_idx", "start_page", F.length("content").alias("n_chars"))


def _vectors(spark, sf, documents: int = 1):
    """Every twentieth vector as a query, all vectors as passages; of one document, or dealt to several by their label."""
    rows = read(spark, sf, "embeddings")
    passages = rows.select((F.col("label") % documents).cast("bigint").alias("document_id"), F.col("label").alias("node_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("label") % documents).cast("bigint").alias("document_id"), F.col("embedding").alias("query_vector"))
    return queries, passages


def knn(spark, sf):
    queries, passages = _vectors(spark, sf)
    return retrieve.nearest(queries, passages, DEFAULT.scoped_top_k).select("query_id", "chunk_id", "node_id", "similarity", "rank")


def knn_index(spark, sf):
    """The same search in an index, in as many cells as reach a recall of 0.95; similarities are exact, a neighbour may be missing."""
    queries, passages = _vectors(spark, sf)
    index = vectors.build(passages)
    index = vectors.Index(index.centers, cut(index.rows))
    cells, _ = vectors.probes(index, queries, DEFAULT.scoped_top_k)
    return index.search(queries, DEFAULT.scoped_top_k, cells).select("query_id", "chunk_id", "node_id", "similarity", "rank")


def knn_index_exact(spark, sf):
    """The index with all cells open, which is exact."""
    queries, passages = _vectors(spark, sf)
    index = vectors.build(passages)
    return index.search(queries, DEFAULT.context_passages, len(index.centers)).select("query_id", "chunk_id", "node_id", "similarity", "rank")


def store_versions(spark, sf):
    """Documents and their lines go through the store: all are added, a third is indexed again as quotations, a seventh deleted, and all is read after a compaction."""
    found = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "none")
    docs = read(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), F.lit("/").alias("file_path"), "text")
    nodes = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("node_id", "content"), F.col("filename").alias("heading"))
    chunks = docs.select("document_id", F.col("document_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    found.add(docs, nodes, chunks)
    third = F.col("document_id") % 3 == 0
    found.add(docs.where(third), nodes.where(third).withColumn("content", F.concat(F.lit("> "), "content")), chunks.where(third).withColumn("content", F.lit("again")))
    found.delete_all(docs.where("document_id % 7 = 0"))
    found.compact()
    lines = found.read("nodes").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "content"))), lambda x: x["content"]), "\n").cast("binary")).alias("text_md5"))
    kept = found.read("documents").join(lines, "document_id").join(found.read("chunks").select("document_id", F.length("content").alias("n_chars")), "document_id")
    return kept.select("document_id", "filename", "n_lines", "text_md5", "n_chars")


def knn_scoped(spark, sf):
    """Only labels that the query's id allows; queries without any search their whole document."""
    queries, passages = _vectors(spark, sf, 2)
    labels = spark.range(10).select(F.col("id").cast("int").alias("node_id"))
    scope = queries.where("query_id % 3 <> 0").select("query_id").join(F.broadcast(labels), F.col("node_id") % 5 == F.col("query_id") % 5)
    return retrieve.nearest(queries, passages, DEFAULT.context_passages, scope).select("query_id", "chunk_id", "node_id", "similarity", "rank")


def label_heat(spark, sf):
    queries, passages = _vectors(spark, sf)
    hits = retrieve.nearest(queries, passages, DEFAULT.scoped_top_k).withColumn("hybrid_score", F.col("similarity")).withColumn("hybrid_rank", F.col("rank"))
    return retrieve.heat_map(hits).select("query_id", "node_id", "heat", heat_class(F.col("heat")).alias("heat_class"))


def _candidates(spark, sf):
    """Lines of a source that share words with a question, the 30 with the best cosine of word sets. One join on (source, word)."""
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), F.col("text").alias("query")).where("query is not null")
    lines = read(spark, sf, "documents").where("text is not null").select("source", F.col("doc_id").alias("node_id"), F.posexplode(F.split("text", "\n")).alias("p", "content")).where(F.trim("content") != "")
    lines = lines.select("source", "node_id", F.format_string("%010d-%06d", "node_id", "p").alias("chunk_id"), "content")
    words_of = lambda c: F.array_distinct(tokens(F.col(c)))
    q = asked.withColumn("w", words_of("query")).withColumn("nq", F.size("w")).select("query_id", "source", "nq", F.explode("w").alias("w"))
    d = lines.withColumn("w", words_of("content")).withColumn("nd", F.size("w")).select("source", "chunk_id", "nd", F.explode("w").alias("w"))
    shared = d.join(q, ["source", "w"]).groupBy("query_id", "source", "chunk_id", "nq", "nd").agg(F.count(F.lit(1)).alias("both"))
    scored = shared.withColumn("similarity", F.round(F.col("both") / F.sqrt(F.col("nq").cast("double") * F.col("nd")), 4))
    best = retrieve.top(scored, DEFAULT.scoped_top_k, F.desc("similarity"), F.asc("chunk_id")).select("query_id", "source", "chunk_id", "similarity", "rank")
    return best.join(lines, ["source", "chunk_id"]).join(asked.select("query_id", "query"), "query_id")


def rank_passages(spark, sf):
    return retrieve.rerank(cut(_candidates(spark, sf)), DEFAULT.context_passages).select("query_id", "chunk_id", "node_id", "similarity", F.round("bm25", 4).alias("bm25"), F.round("lexical", 4).alias("lexical"), "hybrid_score", "hybrid_rank")


def _hits(spark, sf):
    hits = retrieve.rerank(cut(_candidates(spark, sf)), DEFAULT.scoped_top_k)
    return cut(hits.withColumn("document_id", F.col("source")).withColumn("path", F.concat_ws(" > ", "source", F.col("node_id").cast("string"))).withColumn("start_page", (F.col("node_id") % 7).cast("int")))


def passage_heat(spark, sf):
    return retrieve.heat_map(_hits(spark, sf)).select("query_id", "node_id", "heat", heat_class(F.col("heat")).alias("heat_class"))


def hottest_nodes(spark, sf):
    return context.heat_top(retrieve.heat_map(_hits(spark, sf))).select("query_id", "node_id", "heat", "heat_rank")


def flat_context(spark, sf):
    return context.flat_context(_hits(spark, sf), Settings(token_budget=300)).select("query_id", "ord", "block", "total")


def fitting_blocks(spark, sf):
    """Greedy packing that passes over what is too large."""
    blocks = context.passage_blocks(_hits(spark, sf))
    packed = context.pack_fitting(blocks, 200)
    return packed.select("query_id", F.size("blocks").alias("n_blocks"), "used", F.md5(F.array_join("blocks", "\n").cast("binary")).alias("blocks_md5"))


def _star(spark, sf):
    """Region, nation, customer and order as one tree; ids are strings."""
    region = read(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"))
    nation = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    customer = read(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    orders = read(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"))
    return region.union(nation).union(customer).union(orders).withColumn("document_id", F.lit(0).cast("bigint"))


def _long_chain(spark, sf):
    """Orders of a customer as one chain, each the parent of the next: trees of any depth."""
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("node_id"))
    return rows.withColumn("parent_id", F.lag("node_id").over(Window.partitionBy("document_id").orderBy("node_id")))


def chain_sizes(spark, sf):
    """Nodes at or below each node of the chains."""
    return tree.intervals(_long_chain(spark, sf)).select("document_id", "node_id", "n_below")


def tree_intervals(spark, sf):
    """Numbers of the sections of documents in the order of their trees, and how far those below a section reach."""
    return tree.intervals(_tree(spark, sf)).select("document_id", "node_id", "first", "last")


def chain_heat(spark, sf):
    """The greatest price at or below each node of the chains."""
    heat = read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").alias("heat"))
    return retrieve.spread_heat(heat, cut(_long_chain(spark, sf))).select("document_id", "node_id", "heat")


def raw_tree(spark, sf):
    """Lines of an order as raw nodes whose levels go up and down by quantity, skip, and reach fifty."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.row_number().over(order).alias("seq"), F.col("l_quantity").cast("int").alias("level"), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("heading"), F.col("l_returnflag").alias("content"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"))
    nodes = tree.tree_from_raw(rows, Settings(max_tree_depth=50))
    return nodes.select("document_id", "node_id", "level", "parent_id", "path", "is_leaf")


def ancestor_heat(spark, sf):
    """The greatest line price below each region, nation and customer."""
    heat = read(spark, sf, "lineitem").groupBy(F.concat(F.lit("o"), "l_orderkey").alias("node_id")).agg(F.max("l_extendedprice").alias("heat")).select(F.lit(0).cast("bigint").alias("query_id"), F.lit(0).cast("bigint").alias("document_id"), "node_id", "heat")
    spread = retrieve.spread_heat(heat, cut(_star(spark, sf)))
    return spread.where("node_id not like 'o%'").select("node_id", "heat")


def descent(spark, sf):
    """Targets and opened nodes of a descent through each document's tree by the heat of its sections."""
    nodes = _tree(spark, sf)
    heat = nodes.select(F.col("document_id").alias("query_id"), "document_id", "node_id", F.round(F.length("content") % 100 / 100.0, 4).alias("heat"))
    queries = nodes.select(F.col("document_id").alias("query_id"), "document_id").distinct().join(tree.worth_descending(nodes, Settings(descent_min_nodes=3)), "document_id", "left_semi")
    targets, opened, _ = descent_module.descend(nodes, queries, cut(retrieve.spread_heat(heat, nodes)), descent_module.heat_navigator(0.6))
    return targets.withColumn("kind", F.lit("target")).unionByName(opened.withColumn("kind", F.lit("opened"))).select("query_id", "node_id", "kind")


def frontier(spark, sf):
    """Orders of a customer as a frontier of at most eight, by price."""
    rows = read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("node_id"), F.col("o_totalprice").alias("heat"))
    return descent_module.cap_frontier(rows, Settings(frontier_cap=8)).select("query_id", "node_id")


def replies(spark, sf):
    """Model replies with thoughts, fences and trailing commas, made from the events."""
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit("<think>{x}</think>```json\n{\"select\": ["), k, F.lit(", \"7\", \"x\", 2.5,], \"confidence\": \""), F.col("event_type"), F.lit("\",}\n``` bye"))
    parsed = descent_module.parse_reply(raw)
    return read(spark, sf, "events").where(k.isNotNull()).select("event_id", repair_json(raw).alias("repaired"), parsed["confidence"].alias("confidence"), F.array_join(valid_ids(parsed["select"], F.sequence(F.lit(0), F.lit(50))), ",").alias("ids"))


def bookmarks(spark, sf):
    marks = read(spark, sf, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("seq"), F.lit(1).alias("level"), F.when(F.col("role") == "system", "Blank Page").otherwise(F.col("text")).alias("title"), (F.col("turn") * 3 + F.col("conv_id") % 3).cast("int").alias("page"), F.lit(24).alias("page_count"))
    return layout.usable_bookmarks(marks).select("document_id", "n", F.round("share", 4).alias("share"), "usable")


def bookmark_tree(spark, sf):
    turns = read(spark, sf, "conversations").where("text is not null")
    marks = turns.where("role = 'user'").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("seq"), F.lit(1).alias("level"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("title"), (F.col("turn") + 1).cast("int").alias("page"), F.lit(8).alias("page_count"))
    pages = turns.select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text")
    nodes = layout.bookmark_nodes(marks, pages)
    return nodes.select("document_id", "seq", "heading", "start_page", "end_page", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def spans_of(spark, sf):
    """Lines of documents as spans: ten lines a page, larger and bold ones in between, some numbered."""
    lines = read(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("p", "raw"))
    text = F.when(F.col("p") % 7 == 3, F.concat(F.lit("2."), F.col("p").cast("string"), F.lit(" "), F.regexp_replace("raw", r"[.!?,:;]+\s*$", ""))).otherwise(F.col("raw"))
    size = F.when(F.col("p") % 4 == 1, 16.0).when(F.col("p") % 9 == 5, 12.0).otherwise(10.0)
    y = (F.col("p") % 10) * 40.0
    return lines.select("document_id", (F.floor(F.col("p") / 10) + 1).cast("int").alias("page_no"), (F.col("p") % 10).cast("int").alias("block_no"), F.lit(0).alias("line_no"), F.lit(0).alias("span_no"), F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 20).alias("y1"), text.alias("text"), size.alias("size"), F.when(F.col("p") % 2 == 0, 2).otherwise(0).alias("flags"))


def layout_headings(spark, sf):
    lines = layout.layout_lines(spans_of(spark, sf))
    return lines.where("is_heading").select("document_id", "page_no", "block_no", "text", "level")


def boxes_outside(spark, sf):
    """Lines that lie in no table; each page has one table over its third to fifth line."""
    spans = spans_of(spark, sf)
    tables = spans.select("document_id", "page_no").distinct().select("document_id", "page_no", F.lit(40.0).alias("x0"), F.lit(80.0).alias("y0"), F.lit(510.0).alias("x1"), F.lit(180.0).alias("y1"))
    return layout.outside_tables(spans, tables).groupBy("document_id", "page_no").agg(F.count(F.lit(1)).alias("n"))


def renumbered(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", F.concat(F.lit("## "), F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_size") % 7).cast("string"), F.lit(".1 "))).when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(" "))).otherwise(""), F.col("p_type"), F.lit("\nbody # no")).alias("m"))
    return rows.select("p_partkey", tree.renumber_headings(F.col("m")).alias("markdown"))


def golden(spark, sf):
    """Each benchmark text is asked of one document in two modes; the answer is that document's text."""
    items = read(spark, sf, "benchmark").where("text is not null")
    docs = read(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").alias("answer"))
    modes = spark.createDataFrame([("full", 0), ("flat", 3)], "mode string, shift int")
    cases = items.join(F.broadcast(modes)).select("mode", F.col("text").alias("t"), "item_id", (F.col("item_id") * 5 + F.col("shift")).alias("doc_id"))
    cases = cases.join(docs, "doc_id").select("mode", F.array(F.col("t")).alias("expect_any"), F.array(F.lit("zzzz")).alias("forbid_any"), F.array((F.col("item_id") % 4).cast("bigint")).alias("expected_node_ids"), F.array((F.col("doc_id") % 3).cast("bigint")).alias("selected_node_ids"), "answer", F.lit(1.0).alias("latency"))
    return evaluate.summary(evaluate.judge(cases)).select("mode", "n", "n_passed", F.round("pass_rate", 6).alias("pass_rate"), "n_routed", "n_routable", "mean_latency")


QUERIES = {f.__name__: f for f in (text_features, ngram_counts, summaries, chunks, table_chunks, markdown_sections, folded_tree, tree_stats, subtree_sizes, descent_gate, node_chunks, knn, knn_index, knn_index_exact, knn_scoped, store_versions, label_heat, rank_passages, passage_heat, hottest_nodes, flat_context, fitting_blocks, chain_sizes, tree_intervals, chain_heat, raw_tree, ancestor_heat, descent, frontier, replies, bookmarks, bookmark_tree, layout_headings, boxes_outside, renumbered, golden)}
