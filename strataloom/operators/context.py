"""Scope, packing of summaries and passages under a token budget, prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings
from ..functions.text import approx_tokens
from .retrieve import top
from .tree import abstract_nodes, subtree


def page_suffix(page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)).isin(0, -1), F.lit("")).otherwise(F.concat(F.lit(", s."), page.cast("string")))


def heat_top(heat: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The hottest nodes of each query; ties by the hit that came first."""
    return top(heat, settings.heat_top, F.desc("heat"), F.asc("first_rank"), F.asc("node_id"), rank="heat_rank")


def scope(nodes: DataFrame, structural: DataFrame, hottest: DataFrame) -> DataFrame:
    """(query_id, document_id, node_id): structural targets, hottest nodes and abstracts of the document, each with all below. structural (query_id, document_id, node_id)."""
    asked = structural.select("query_id", "document_id").unionByName(hottest.select("query_id", "document_id")).distinct()
    roots = structural.select("query_id", "document_id", "node_id").unionByName(hottest.select("query_id", "document_id", "node_id")).unionByName(asked.join(abstract_nodes(nodes).select("document_id", "node_id"), "document_id").select("query_id", "document_id", "node_id")).distinct()
    return subtree(nodes, roots.withColumnRenamed("node_id", "root"))


def summary_blocks(nodes: DataFrame, structural: DataFrame, hottest: DataFrame) -> DataFrame:
    """(query_id, document_id, ord, block): structural nodes by (level, id), then hottest ones that are not structural, by heat."""
    first = structural.select("query_id", "document_id", "node_id").distinct().withColumn("grp", F.lit(0)).withColumn("heat_rank", F.lit(0))
    rest = hottest.select("query_id", "document_id", "node_id", "heat_rank").join(structural.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_anti").withColumn("grp", F.lit(1))
    named = first.unionByName(rest).join(nodes.select("document_id", "node_id", "level", "path", "summary"), ["document_id", "node_id"])
    order = Window.partitionBy("query_id").orderBy("grp", F.when(F.col("grp") == 0, F.col("level")).otherwise(0), "heat_rank", "node_id")
    return named.select("query_id", "document_id", F.row_number().over(order).alias("ord"), F.concat(F.lit("[ÖZET — "), "path", F.lit("]: "), "summary").alias("block"))


def pack_fitting(blocks: DataFrame, budget: int) -> DataFrame:
    """(query_id, blocks, used): in order, each block that still fits; a block that is too large is passed over. blocks (query_id, ord, block)."""
    sized = blocks.withColumn("n", approx_tokens(F.col("block")))
    rows = sized.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "block", "n"))).alias("all"))
    start = F.struct(F.array().cast("array<string>").alias("blocks"), F.lit(0).alias("used"))

    def add(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["n"] <= budget
        return F.struct(F.when(fits, F.array_append(acc["blocks"], x["block"])).otherwise(acc["blocks"]).alias("blocks"), F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"))

    return rows.select("query_id", F.aggregate("all", start, add).alias("a")).select("query_id", "a.blocks", "a.used")


def pack_prefix(blocks: DataFrame, budget: int, used: DataFrame | None = None) -> DataFrame:
    """(query_id, ord, block, total): blocks up to the first that no longer fits, after what is used already (query_id, used)."""
    sized = blocks.withColumn("n", approx_tokens(F.col("block")))
    if used is not None:
        sized = sized.join(used.select("query_id", "used"), "query_id", "left")
    base = F.coalesce(F.col("used"), F.lit(0)) if used is not None else F.lit(0)
    running = F.sum("n").over(Window.partitionBy("query_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sized.withColumn("total", (base + running).cast("int")).where(F.col("total") <= budget).select("query_id", "ord", "block", "total")


def passage_blocks(hits: DataFrame, label: str = "Pasaj", numbered: bool = False) -> DataFrame:
    """(query_id, ord, block) of reranked hits."""
    number = F.concat(F.lit(" #"), F.col("hybrid_rank").cast("string")) if numbered else F.lit("")
    head = F.concat(F.lit(f"--- {label}"), number, F.lit(" ("), F.col("path"), page_suffix(F.col("start_page")), F.lit(") ---\n"))
    return hits.select("query_id", F.col("hybrid_rank").alias("ord"), F.concat(head, "content").alias("block"))


def pack_context(summaries: DataFrame, scoped_hits: DataFrame, global_hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, blocks, context_tokens, fallback): summaries within their share, then scoped passages within the rest; global hits only for queries without any block."""
    first = pack_fitting(summaries, int(settings.token_budget * settings.summary_share))
    passages = pack_prefix(passage_blocks(scoped_hits), settings.token_budget, first)
    body = passages.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]).alias("more"), F.max("total").alias("total"))
    both = first.join(body, "query_id", "full").select("query_id", F.concat(F.coalesce("blocks", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))).alias("blocks"), F.coalesce("total", "used").alias("context_tokens"), F.lit(False).alias("fallback")).where("size(blocks) > 0")
    rest = global_hits.where(F.col("hybrid_rank") <= settings.rerank_top_k).join(both.select("query_id"), "query_id", "left_anti")
    spare = pack_prefix(passage_blocks(rest, "Semantik Parça", numbered=True), settings.token_budget).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]).alias("blocks"), F.max("total").alias("context_tokens")).withColumn("fallback", F.lit(True))
    return both.unionByName(spare)


def flat_context(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The ablation without a tree: the best passages of the reranked hits."""
    return pack_prefix(passage_blocks(hits.where(F.col("hybrid_rank") <= settings.context_passages), numbered=True), settings.token_budget)


def synthesis_prompt(query: Column, blocks: Column) -> Column:
    return F.concat(F.lit("Answer the question from the context only. Cite the section and page of what you use. Say so if the context does not hold the answer.\n\nContext:\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nQuestion: "), query)


def extractive_answer(blocks: Column) -> Column:
    """The first three blocks; what a model's answer falls back to."""
    return F.when(F.size(blocks) > 0, F.array_join(F.slice(blocks, 1, 3), "\n\n"))


def answer(generated: Column, blocks: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(generated, r"^\s+|\s+$", ""), F.lit("")), extractive_answer(blocks))
