"""Nearest passages by vectors, lexical scores on candidates, hybrid order, and heat of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings
from ..functions.text import char_ngrams, containment, let, tokens
from .vectors import exactly


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; 0 if either is zero or they differ in length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def nearest(queries: DataFrame, passages: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, passage columns, similarity, rank): the k passages of the query's document that are nearest, exactly.

    queries (query_id, document_id, query_vector), passages (document_id, node_id, chunk_id, embedding, …). scope (query_id, node_id)
    keeps a query to its nodes; a query without a row in it searches its whole document. vectors.Index searches a part of the passages.
    """
    return exactly(queries, passages, k, scope)


def top(rows: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("query_id",), rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def lexical_scores(candidates: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """candidates (query_id, chunk_id, query, content, …) with lexical: BM25 in the candidate set of each query, as a share of its best, and n-gram containment.

    Candidates are at most k a query, so each of the windows below holds k rows; terms are kept as arrays and only query terms explode.
    """
    k1, b = settings.bm25_k1, settings.bm25_b
    one = Window.partitionBy("query_id")
    rows = candidates.withColumn("_terms", tokens(F.col("content"))).withColumn("_asked", F.array_sort(F.array_distinct(tokens(F.col("query")))))
    rows = rows.withColumn("_dl", F.size("_terms")).withColumn("_n", F.count(F.lit(1)).over(one))
    mean = F.avg("_dl").over(one)
    rows = rows.withColumn("_avg", F.when(mean == 0, F.lit(1.0)).otherwise(mean)).withColumn("_dl", F.greatest("_dl", F.lit(1)))
    rows = rows.withColumn("_tf", F.transform("_asked", lambda t: F.size(F.filter("_terms", lambda x: x == t))))
    hits = rows.select("query_id", "chunk_id", F.posexplode("_tf").alias("_pos", "_f")).where("_f > 0").groupBy("query_id", "_pos").agg(F.count(F.lit(1)).alias("_df"))
    dfs = hits.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_df"))).alias("_df"))
    rows = rows.join(dfs, "query_id", "left")

    def term(f: Column, i: Column) -> Column:
        df = F.coalesce(F.try_element_at("_df", i), F.lit(0)).cast("double")
        idf = F.ln(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        return F.when(f == 0, F.lit(0.0)).otherwise(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_dl") / F.col("_avg"))))

    rows = rows.withColumn("bm25", F.aggregate(F.transform("_tf", term), F.lit(0.0), lambda s, x: s + x))
    best = F.max("bm25").over(one)
    share = F.when(best > 0, F.col("bm25") / best).otherwise(F.lit(0.0))
    grams = containment(char_ngrams(F.col("query"), settings.ngram_n), char_ngrams(F.col("content"), settings.ngram_n))
    return rows.withColumn("lexical", settings.bm25_share * share + settings.ngram_share * grams).drop("_terms", "_asked", "_dl", "_n", "_avg", "_tf", "_df")


def rerank(candidates: DataFrame, k: int, settings: Settings = DEFAULT) -> DataFrame:
    """The k best by hybrid_score; ties keep the order of similarity, then of chunk_id."""
    scored = lexical_scores(candidates, settings)
    scored = scored.withColumn("hybrid_score", F.round(settings.cosine_weight * F.col("similarity") + settings.lexical_weight * F.col("lexical"), 4))
    return top(scored, k, F.desc("hybrid_score"), F.desc("similarity"), F.asc("chunk_id"), rank="hybrid_rank")


def heat_map(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, document_id, node_id, heat, first_rank): the best hit of a node, raised a little by the number of its hits."""
    heat = F.round(F.max("hybrid_score") * (1 + F.lit(float(settings.heat_concentration)) * F.log2(F.count(F.lit(1)))), 4)
    return hits.groupBy("query_id", "document_id", "node_id").agg(heat.alias("heat"), F.min("hybrid_rank").alias("first_rank"))


def spread_heat(heat: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, document_id, node_id, heat): each node of the query's document with the greatest heat in its subtree, 0 without any."""
    from .tree import ancestors

    up = ancestors(nodes.select("document_id", "node_id", "parent_id")).select("document_id", "node_id", F.explode("up").alias("a"))
    warm = heat.join(up, ["document_id", "node_id"]).groupBy("query_id", "document_id", F.col("a").alias("node_id")).agg(F.max("heat").alias("heat"))
    frame = heat.select("query_id", "document_id").distinct().join(nodes.select("document_id", "node_id"), "document_id")
    return frame.join(warm, ["query_id", "document_id", "node_id"], "left").select("query_id", "document_id", "node_id", F.coalesce("heat", F.lit(0.0)).alias("heat"))


def hash_vector(text: Column, size: int = 64) -> Column:
    """A reproducible embedding without a model: n-grams counted in `size` buckets by checksum."""
    buckets = lambda grams: F.transform(grams, lambda g: (F.crc32(g.cast("binary")) % size).cast("int"))
    return let(buckets(char_ngrams(text)), lambda found: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(found, lambda x: x == i)).cast("float")))
