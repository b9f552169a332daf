"""Nearest vectors in blocks: exactly, or by an inverted file of cells.

Passages and queries meet in blocks of bounded size. A bucket (a document, or a set of cells of a document) with more than BLOCK passages
is dealt to several blocks by a hash of its rows, and its queries are copied to each of them; small buckets share a block. Queries are
dealt to groups of QUERIES as well, so that no task holds all of a hot bucket. In a block products of matrices give all similarities,
from norms that stand with the vectors, for as many queries at once as make PRODUCT numbers; only the k best of each query leave it.

The index has cells around centers that are fitted on a bounded sample (SAMPLE vectors, the ones with the least hashes of their ids); every
vector is assigned to its nearest center, and zero vectors to the first. A search opens the cells nearest to the query and scores their
vectors exactly. Cells are dealt to sets of about BLOCK vectors, and a query goes once to each set that holds some of its cells. How many cells that takes is measured: probes() compares a bounded set of queries with the exact search over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from pyspark.sql.window import Window

#: Passages and queries of a block; vectors and rounds that centers are fitted with; most cells and rows of a table that is broadcast.
BLOCK, QUERIES, SAMPLE, ROUNDS, MAX_CELLS, BROADCAST = 20_000, 2_000, 20_000, 12, 4_096, 100_000
#: Numbers that a product of matrices may have (or one row of it), and rows of the k best that a block gathers before it drops all but the k best of each query.
PRODUCT, GATHERED = 1_000_000, 500_000
DIGITS = 4


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a column; those of another length than the first, and null ones, are zero."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    size = int(lengths.max(initial=0))
    out = np.zeros((len(column), size))
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        out[rows, :n] = np.nan_to_num(np.asarray(flat.take(pa.array(rows)).flatten(), np.float64)).reshape(len(rows), n)
    return out


def similarities(vectors: np.ndarray, norms: np.ndarray, lengths: np.ndarray, queries: np.ndarray, query_lengths: np.ndarray) -> np.ndarray:
    """Cosines, a row for each query, as rounded and cut at 0 as similarities are; 0 for a zero vector or another length."""
    size = min(vectors.shape[1], queries.shape[1])
    length = np.sqrt((queries**2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (queries[:, :size] @ vectors[:, :size].T) / (length[:, None] * norms[None, :])
    out[~np.isfinite(out) | (query_lengths[:, None] != lengths[None, :])] = 0
    return np.maximum(np.round(out, DIGITS), 0)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _first_of_each(owners: np.ndarray, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each owner; ties by place."""
    order = np.lexsort((places, -scores, owners))
    owners = owners[order]
    rank = np.arange(len(owners)) - np.searchsorted(owners, owners)
    order = order[rank < k]
    return owners[rank < k], places[order], scores[order]


def best_in_blocks(queries: DataFrame, passages: DataFrame, k: int, by: list[str], allowed: str | None = None, cells: str | None = None) -> DataFrame:
    """(query_id, the passages' columns but embedding and norm, similarity): for each query the k best of each block of its buckets, or more.

    queries (query_id, *by, query_vector[, allowed, cells]), passages (*by, node_id, chunk_id, embedding, norm, …). allowed names an array
    of the node ids that a query may meet; null means all. cells names an array of the cells that it opens, of those in the passages' cell.
    """
    asked = queries.groupBy(*by).agg(F.count(F.lit(1)).alias("_q"))
    sizes = passages.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).join(asked, by)
    more = sizes.select(*by, "_n", "_q", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"), F.ceil(F.col("_q") / QUERIES).cast("int").alias("_groups"))
    # one row; what needs no second block nor group is not looked up
    small = F.expr("_blocks = 1 and _groups = 1")
    whole = more.agg(*[F.coalesce(F.sum(F.when(small, F.col(c))), F.lit(0)).alias(c) for c in ("_n", "_q")], F.count_if(~small).alias("large")).first()
    large = more.where(~small).drop("_n", "_q")
    large = F.broadcast(large) if whole["large"] <= BROADCAST else large
    shared = max(1, -(-whole["_n"] // BLOCK), -(-whole["_q"] // QUERIES))

    def dealt(rows: DataFrame, block: Column, group: Column) -> DataFrame:
        """rows with _part and _group. Small buckets share parts, of about as many passages and queries as one block; each block of a large one is a part."""
        rows = rows.join(large, by, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_blocks", "_groups")})
        rows = rows.withColumn("_block", block).withColumn("_group", group)
        part = F.when(small, F.pmod(F.xxhash64(*by), F.lit(shared)).cast("long")).otherwise(F.xxhash64(*by, "_block"))
        return rows.withColumn("_part", part).drop("_blocks", "_groups", "_block")

    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = dealt(passages.join(queries.select(*by).distinct(), by, "left_semi"), one("chunk_id", "_blocks"), every("_groups"))
    right = dealt(queries, every("_blocks"), one("query_id", "_groups"))
    kept = [f for f in passages.schema.fields if f.name not in ("embedding", "norm")]
    schema = StructType([queries.schema["query_id"], *kept]).add("similarity", "double")

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({f.name: rows.column(f.name).slice(0, 0) if f.name in rows.column_names else asked.column("query_id").slice(0, 0) if f.name == "query_id" else pa.array([], pa.float64()) for f in schema.fields})
        rows = rows.sort_by("chunk_id")
        places, owners = {}, {}
        for i, key in enumerate(zip(*(rows.column(c).to_pylist() for c in [*by, *(["cell"] if cells else [])]))):
            places.setdefault(key, []).append(i)
        opened = asked.column(cells).to_pylist() if cells else None
        for i, key in enumerate(zip(*(asked.column(c).to_pylist() for c in by))):
            for one in [key] if opened is None else [(*key, c) for c in opened[i]]:
                owners.setdefault(one, []).append(i)
        nodes = np.asarray(rows.column("node_id"))
        out, gathered = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        for key, mine in owners.items():
            there = np.array(places.get(key, []), np.int64)
            if not len(there):
                continue
            part = rows.take(pa.array(there))
            lengths = np.asarray(pc.fill_null(pc.list_value_length(part.column("embedding")), 0))
            vectors, norms = matrix(part.column("embedding")), np.asarray(part.column("norm"), np.float64)
            step = max(1, PRODUCT // len(there))
            for at in range(0, len(mine), step):
                those = asked.take(pa.array(mine[at : at + step]))
                asked_lengths = np.asarray(pc.fill_null(pc.list_value_length(those.column("query_vector")), 0))
                found = similarities(vectors, norms, lengths, matrix(those.column("query_vector")), asked_lengths)
                limits = those.column(allowed).to_pylist() if allowed else [None] * len(those)
                for q, limit, scores in zip(mine[at : at + step], limits, found):
                    open_ = np.arange(len(there)) if limit is None else np.flatnonzero(np.isin(nodes[there], limit))
                    mine_scores = scores[open_]
                    if len(open_) > k:
                        # all that tie with the k-th stay for now; rows stand in the order of ids
                        open_ = open_[mine_scores >= np.partition(mine_scores, -k)[-k]]
                        open_ = open_[np.argsort(-scores[open_], kind="stable")[:k]]
                    out.append((np.full(len(open_), q), there[open_], scores[open_]))
                    gathered += len(open_)
                if gathered > GATHERED:
                    out = [_first_of_each(*map(np.concatenate, zip(*out)), k)]
                    # at least as many again, so that sorting stays in proportion
                    gathered = -len(out[0][0])
        out_queries, out_rows, out_scores = _first_of_each(*map(np.concatenate, zip(*out)), k)
        got = rows.select([f.name for f in kept]).take(pa.array(out_rows))
        ids = asked.column("query_id").take(pa.array(out_queries))
        return pa.table({f.name: ids if f.name == "query_id" else pa.array(out_scores) if f.name == "similarity" else got.column(f.name) for f in schema.fields})

    return left.groupBy("_part", "_group").cogroup(right.groupBy("_part", "_group")).applyInArrow(score, schema)


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("chunk_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_scope(queries: DataFrame, scope: DataFrame | None) -> DataFrame:
    """queries with allowed: the nodes that a query is kept to, null for one without a row in scope."""
    if scope is None:
        return queries.withColumn("allowed", F.lit(None).cast("array<bigint>"))
    return queries.join(scope.groupBy("query_id").agg(F.collect_set(F.col("node_id").cast("bigint")).alias("allowed")), "query_id", "left")


@dataclass(frozen=True)
class Index:
    """Centers, one a row, and the passages with their cells: (cell, norm, the passages' columns)."""

    centers: np.ndarray
    rows: DataFrame

    def search(self, queries: DataFrame, k: int, probes: int, scope: DataFrame | None = None) -> DataFrame:
        """(query_id, passages' columns, similarity, rank): the k nearest of the query's document in its probes nearest cells; with all cells, exactly what the exact search gives."""
        asked = with_scope(queries.select("query_id", "document_id", "query_vector"), scope)
        if probes >= len(self.centers):
            # cells that are all open need not be told apart
            return best(best_in_blocks(asked, self.rows, k, ["document_id"], "allowed"), k).drop("cell")
        # sets of cells: as many as the rows make blocks, if no document has more of them
        sets = max(1, min(len(self.centers), -(-self.rows.count() // BLOCK)))
        own = lambda c: F.pmod(c, F.lit(sets))
        opened = _cells(asked, "query_vector", self.centers, probes).withColumnRenamed("cell", "_open")
        opened = opened.withColumn("_set", F.explode(F.array_distinct(F.transform("_open", own)))).withColumn("_open", F.filter("_open", lambda c: own(c) == F.col("_set")))
        rows = self.rows.withColumn("_set", own(F.col("cell")))
        return best(best_in_blocks(opened, rows, k, ["document_id", "_set"], "allowed", "_open"), k).drop("cell", "_set")

    def write(self, path: str) -> None:
        """Partitioned by cell, so that a search reads only the cells that it opens; the centers beside it."""
        self.rows.write.partitionBy("cell").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(self.centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")

    @staticmethod
    def read(spark, path: str) -> "Index":
        # at most MAX_CELLS rows
        centers = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()
        return Index(np.array([r["center"] for r in centers]), spark.read.parquet(f"{path}/rows"))


def _cells(rows: DataFrame, column: str, centers: np.ndarray, n: int) -> DataFrame:
    """rows with cell: the n cells whose centers are nearest, the nearest first; a zero vector has the first ones."""
    n = min(n, len(centers))
    size = np.sqrt((centers**2).sum(1))
    units = np.divide(centers, size[:, None], out=np.zeros_like(centers), where=size[:, None] > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PRODUCT // len(units))
        for batch in batches:
            vectors = matrix(batch.column(column))
            width = min(vectors.shape[1], units.shape[1])
            order = [np.argsort(-(vectors[at : at + step, :width] @ units[:, :width].T), axis=1, kind="stable")[:, :n].astype(np.int32) for at in range(0, len(vectors), step)]
            order = np.concatenate([np.zeros((0, n), np.int32), *order])
            cells = pa.ListArray.from_arrays(np.arange(0, order.size + 1, n, dtype=np.int32), order.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cell"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("cell", ArrayType(IntegerType())))


def build(passages: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """An index of passages (document_id, node_id, chunk_id, embedding, …), the root of their number in cells if no number is given.

    Centers come from spherical k-means over at most sample vectors; the first ones are spread over the sample by its order of hashes.
    """
    normed = passages.withColumn("norm", F.coalesce(norm(F.col("embedding")), F.lit(0.0)))
    # at most sample rows
    taken = normed.where("norm > 0").select("embedding", "norm", F.xxhash64("document_id", "chunk_id").alias("h")).orderBy("h", "embedding").limit(sample).toArrow()
    units = matrix(taken.column("embedding")) / np.asarray(taken.column("norm"))[:, None]
    wanted = cells or int(passages.count() ** 0.5)
    n = max(1, min(wanted, MAX_CELLS, len(units)))
    centers = units[np.linspace(0, len(units) - 1, n).astype(int)] if len(units) else np.zeros((1, 1))
    for _ in range(ROUNDS if len(units) else 0):
        nearest = np.concatenate([(part @ centers.T).argmax(1) for part in np.array_split(units, len(units) // 4096 + 1)])
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, units)
        size = np.sqrt((sums**2).sum(1))
        centers = np.where(size[:, None] > 0, np.divide(sums, size[:, None], out=np.zeros_like(sums), where=size[:, None] > 0), centers)
    return Index(centers, _cells(normed, "embedding", centers, 1).withColumn("cell", F.get("cell", F.lit(0))))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's rows whose similarity a query reaches at that rank, so that ties count as found."""
    both = exact.select("query_id", "rank", F.col("similarity").alias("want")).join(found.select("query_id", "rank", "similarity"), ["query_id", "rank"], "left")
    row = both.agg(F.avg((F.coalesce("similarity", F.lit(-1.0)) >= F.col("want")).cast("double")).alias("share")).first()
    return 1.0 if row["share"] is None else row["share"]


def probes(index: Index, queries: DataFrame, k: int, least: float = 0.95, sample: int = 200) -> tuple[int, float]:
    """The least of 1, 2, 4, 7, 11, 17, … cells (or all) at which a search of sample queries, the ones with the least hashes of their ids, has a recall of least against all rows, and that recall."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    exact = exactly(some, index.rows.drop("cell"), k)
    n = 1
    while n < len(index.centers):
        found = recall(index.search(some, k, n), exact)
        if found >= least:
            return n, found
        n += n // 2 + 1
    return len(index.centers), 1.0


def exactly(queries: DataFrame, passages: DataFrame, k: int, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, passages' columns, similarity, rank): the k nearest of the query's document, over all its passages."""
    if "norm" not in passages.columns:
        passages = passages.withColumn("norm", F.coalesce(norm(F.col("embedding")), F.lit(0.0)))
    asked = with_scope(queries.select("query_id", "document_id", "query_vector"), scope)
    return best(best_in_blocks(asked, passages, k, ["document_id"], "allowed"), k)
