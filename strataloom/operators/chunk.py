"""Sentence-aware chunks with overlap; tables stay whole or repeat their head. Folds run inside a row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.text import let, sentences, squeeze, strip

_STRINGS = "array<string>"


def chunk_prose(text: Column, settings: Settings = DEFAULT) -> Column:
    """Words broken at a line end are joined, white space is single, whole sentences are packed up to the size; a new chunk starts with the end of the last one."""
    clean = squeeze(F.regexp_replace(text, r"-\s*\n\s*", ""))
    start = F.struct(F.array().cast(_STRINGS).alias("out"), F.lit("").alias("cur"))

    def add(acc: Column, s: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(s) + 1 > settings.chunk_chars)
        tail = F.concat(strip(F.right(acc["cur"], F.lit(settings.chunk_overlap))), F.lit(" "), s)
        joined = strip(F.concat(acc["cur"], F.lit(" "), s))
        return F.struct(F.when(full, F.array_append(acc["out"], strip(acc["cur"]))).otherwise(acc["out"]).alias("out"), F.when(full, tail).otherwise(joined).alias("cur"))

    finish = lambda acc: F.when(strip(acc["cur"]) != "", F.array_append(acc["out"], strip(acc["cur"]))).otherwise(acc["out"])
    return let(clean, lambda c: F.when(c == "", F.array().cast(_STRINGS)).otherwise(F.aggregate(sentences(c), start, add, finish)))


def chunk_table(table: Column, settings: Settings = DEFAULT) -> Column:
    """A table that fits is one chunk; else rows are packed under its first two rows, which each piece repeats. Lengths leave line ends out."""
    size = settings.chunk_chars

    def cut(rows: Column) -> Column:
        head = F.slice(rows, 1, 2)
        head_size = F.aggregate(head, F.lit(0), lambda a, x: a + F.length(x))
        start = F.struct(F.array().cast(_STRINGS).alias("out"), head.alias("cur"), head_size.alias("n"))

        def add(acc: Column, row: Column) -> Column:
            full = (acc["n"] + F.length(row) > size) & (F.size(acc["cur"]) > F.size(head))
            return F.struct(
                F.when(full, F.array_append(acc["out"], F.array_join(acc["cur"], "\n"))).otherwise(acc["out"]).alias("out"),
                F.when(full, F.array_append(head, row)).otherwise(F.array_append(acc["cur"], row)).alias("cur"),
                (F.when(full, head_size).otherwise(acc["n"]) + F.length(row)).alias("n"),
            )

        finish = lambda acc: F.when((F.size(acc["cur"]) > F.size(head)) | (F.size(acc["out"]) == 0), F.array_append(acc["out"], F.array_join(acc["cur"], "\n"))).otherwise(acc["out"])
        return F.aggregate(F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0))), start, add, finish)

    return F.when(F.length(table) <= size, F.array(table)).otherwise(let(F.split(table, "\n"), cut))


def islands(content: Column) -> Column:
    """Runs of table lines (that start with a bar) and of other lines: array<struct<table boolean, text string>>. A blank line ends a table, not prose."""
    is_table = lambda x: F.regexp_replace(x, r"^\s+", "").startswith("|")
    start = F.array().cast("array<struct<t:boolean,x:string>>")

    def add(acc: Column, line: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce(last["t"] == is_table(line), F.lit(False))
        return F.when(same, F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["t"].alias("t"), F.concat(last["x"], F.lit("\n"), line).alias("x")))).otherwise(F.array_append(acc, F.struct(is_table(line).alias("t"), line.alias("x"))))

    # prose is one island as long as no line is a table, which needs no fold
    has_table = F.coalesce(content.rlike(r"(?m)^\s*\|"), F.lit(False))
    return F.when(has_table, F.aggregate(F.split(content, "\n"), start, add)).otherwise(F.array(F.struct(F.lit(False).alias("t"), content.alias("x"))))


def chunk_text(content: Column, settings: Settings = DEFAULT) -> Column:
    parts = F.filter(F.transform(islands(F.coalesce(content, F.lit(""))), lambda p: F.struct(p["t"].alias("t"), strip(p["x"]).alias("x"))), lambda p: p["x"] != "")
    return F.flatten(F.transform(parts, lambda p: F.when(p["t"], chunk_table(p["x"], settings)).otherwise(chunk_prose(p["x"], settings))))


def page_of(p_idx: Column, n: Column, start: Column, end: Column) -> Column:
    """The page of chunk p_idx of n, spread evenly over the section's pages; -1 without a page."""
    spread = start + F.bround(p_idx * (end - start) / (n - 1)).cast("int")
    return F.when(F.coalesce(start, F.lit(0)) == 0, F.lit(-1)).when((n <= 1) | F.coalesce(end <= start, F.lit(True)), start).otherwise(spread)


def chunk_nodes(nodes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(chunk_id, document_id, node_id, p_idx, path, heading, start_page, content) of the nodes that have content."""
    rows = nodes.where(strip(F.coalesce("content", F.lit(""))) != "").withColumn("chunks", chunk_text(F.col("content"), settings))
    rows = rows.select("document_id", "node_id", "path", "heading", F.col("start_page").alias("sp"), F.col("end_page").alias("ep"), F.size("chunks").alias("n"), F.posexplode("chunks").alias("p_idx", "content"))
    page = page_of(F.col("p_idx"), F.col("n"), F.col("sp"), F.col("ep"))
    return rows.select(F.format_string("doc_%s_node_%s_p_%s", F.col("document_id").cast("string"), F.col("node_id").cast("string"), F.col("p_idx").cast("string")).alias("chunk_id"), "document_id", "node_id", "p_idx", "path", "heading", page.alias("start_page"), "content")
