"""The engine: index documents, list and delete them, and answer batches of questions."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import approx_tokens, extractive_summary
from ..operators.checkpoints import cut
from ..operators.chunk import chunk_nodes
from ..operators.context import answer, extractive_answer, flat_context, heat_top, pack_context, scope, summary_blocks, synthesis_prompt
from ..operators.descent import Navigator, descend, heat_navigator, model_navigator
from ..operators.retrieve import hash_vector, heat_map, nearest, rerank, spread_heat
from ..operators.tree import markdown_tree, worth_descending
from ..sources.providers import embed, generate
from ..sources.store import Store


def _works(call) -> bool:
    try:
        call()
    except Exception:  # the answer is that it does not
        return False
    return True


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder=None, llm=None, navigator: Navigator | None = None, settings: Settings = DEFAULT):
        self.spark, self.settings, self.embedder, self.llm = spark, settings, embedder, llm
        self.navigator = navigator or (model_navigator(llm) if llm else heat_navigator())
        self.store = Store(spark, root, getattr(embedder, "model_key", "hash:64"))

    def _vectors(self, rows: DataFrame, text_col: str) -> DataFrame:
        return embed(rows, self.embedder, text_col) if self.embedder else rows.withColumn("embedding", hash_vector(F.col(text_col)))

    def index(self, documents: DataFrame) -> None:
        """documents (document_id, filename, path, text) in Markdown or plain text."""
        self.index_nodes(documents, markdown_tree(documents.select("document_id", "text"), self.settings))

    def index_nodes(self, documents: DataFrame, nodes: DataFrame) -> None:
        """For documents whose nodes come from another parser."""
        plain = extractive_summary(F.col("content"), F.col("heading"))
        if self.llm and self.settings.use_llm_summaries:
            prompt = F.when(F.col("content") != "", F.concat(F.lit("Summarise in two sentences:\n"), F.left("content", F.lit(2000))))
            nodes = generate(nodes.withColumn("_prompt", prompt), self.llm, "_prompt", "_said").withColumn("summary", F.coalesce("_said", plain)).drop("_prompt", "_said")
        else:
            nodes = nodes.withColumn("summary", plain)
        nodes = cut(nodes.withColumn("token_count", approx_tokens(F.col("content"), self.settings)))
        chunks = self._vectors(chunk_nodes(nodes, self.settings), "content")
        self.store.add(documents.select("document_id", "filename", F.col("path").alias("file_path")), nodes, chunks)

    def list_documents(self) -> DataFrame:
        return self.store.list_documents()

    def table_of_contents(self, document_id: int) -> DataFrame:
        return self.store.nodes(document_id)

    def document(self, document_id: int):
        """The row of a document; KeyError for one that is not there."""
        row = self.store.document(document_id)
        if row is None:
            raise KeyError(document_id)
        return row

    def delete(self, document_id: int) -> None:
        """KeyError for a document that is not there."""
        self.document(document_id)
        self.store.delete(document_id)

    def health(self) -> dict:
        """Which parts answer: the store, and with a word each the embedder and the language model."""
        return {"store": _works(lambda: self.store.read("documents").limit(1).count()), "embedder": _works(lambda: self.embedder.query("x")) if self.embedder else None, "llm": _works(lambda: self.llm.generate("x")) if self.llm else None}

    def query(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, document_id, query[, ablation]) -> (query_id, answer, selected_node_ids, execution_policy, fallback_triggered, context_tokens, heatmap_scores, blocks, prompt)."""
        s = self.settings
        asked = queries.select("query_id", "document_id", "query", F.coalesce(F.col("ablation") if "ablation" in queries.columns else F.lit(None).cast("string"), F.lit(s.ablation)).alias("mode"))
        asked = cut(self._vectors(asked, "query").withColumnRenamed("embedding", "query_vector"))
        words = asked.select("query_id", "query")
        nodes, chunks = self.store.read("nodes"), self.store.read("chunks")
        hits = cut(rerank(nearest(asked, chunks, s.scoped_top_k).join(words, "query_id"), s.scoped_top_k, s))
        heat = cut(heat_map(hits, s))
        flat = flat_context(hits.join(asked.where("mode = 'flat'"), "query_id", "left_semi"), s)
        flat = flat.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]).alias("blocks"), F.max("total").alias("context_tokens"))
        flat = flat.select("query_id", "blocks", "context_tokens", F.lit(False).alias("fallback"), F.array().cast("array<int>").alias("selected"), F.lit("Flat RAG (ablation)").alias("policy"))
        deep = asked.where("mode <> 'flat'")
        targets, opened, confidence = descend(nodes, deep.join(worth_descending(nodes, s), "document_id", "left_semi"), spread_heat(heat, nodes), self.navigator, s)
        structural = cut(targets.unionByName(opened).distinct())
        hottest = cut(heat_top(heat.join(deep, "query_id", "left_semi"), s))
        inside = scope(nodes, structural, hottest)
        scoped = rerank(nearest(deep, chunks, s.scoped_top_k, inside).join(inside.select("query_id").distinct(), "query_id", "left_semi").join(words, "query_id"), s.context_passages, s)
        packed = pack_context(summary_blocks(nodes, structural, hottest), scoped, hits.join(deep, "query_id", "left_semi"), s)
        by_tree = structural.groupBy("query_id").agg(F.sort_array(F.collect_set("node_id")).alias("by_tree"))
        by_heat = hottest.groupBy("query_id").agg(F.sort_array(F.collect_set("node_id")).alias("by_heat"))
        full = packed.join(by_tree, "query_id", "left").join(by_heat, "query_id", "left").join(confidence, "query_id", "left")
        sure = F.coalesce((F.col("confidence") != "LOW") & F.col("by_tree").isNotNull(), F.lit(False))
        full = full.select("query_id", "blocks", "context_tokens", (~sure).alias("fallback"), F.coalesce("by_tree", "by_heat", F.array().cast("array<int>")).alias("selected"), F.when(sure, "Dual pipeline").otherwise("Heat fallback").alias("policy"))
        scores = heat.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "heat"))).alias("heatmap_scores"))
        known = asked.select("query_id", "query").join(full.unionByName(flat), "query_id", "left").join(scores, "query_id", "left")
        blocks = F.coalesce("blocks", F.array().cast("array<string>"))
        known = known.withColumn("blocks", blocks).withColumn("prompt", synthesis_prompt(F.col("query"), F.col("blocks")))
        if self.llm:
            known = generate(known, self.llm, "prompt", "_said")
            said = answer(F.col("_said"), F.col("blocks"))
        else:
            said = extractive_answer(F.col("blocks"))
        return known.select("query_id", said.alias("answer"), F.col("selected").alias("selected_node_ids"), F.col("policy").alias("execution_policy"), F.col("fallback").alias("fallback_triggered"), F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"), "heatmap_scores", "blocks", "prompt")

    def stream(self, document_id: int, query: str) -> Iterator[str]:
        """A line of JSON about the query, then the answer in pieces; the extractive answer if the model gives none. KeyError for a document that is not there."""
        self.document(document_id)
        row = self.query(self.spark.createDataFrame([(0, document_id, query)], "query_id bigint, document_id bigint, query string")).first()
        yield json.dumps({"selected_node_ids": row["selected_node_ids"] or [], "execution_policy": row["execution_policy"], "fallback_triggered": row["fallback_triggered"], "context_tokens": row["context_tokens"], "heatmap_scores": row["heatmap_scores"] or {}}, ensure_ascii=False) + "\n"
        said = False
        if self.llm and hasattr(self.llm, "generate_stream"):
            for piece in self.llm.generate_stream(row["prompt"]):
                said = True
                yield piece
        if not said and row["answer"]:
            yield row["answer"]
