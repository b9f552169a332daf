"""From the spans of page layouts to Markdown, and trees from bookmarks.

spans: (document_id, page_no, block_no, line_no, span_no, x0, y0, x1, y1, text, size, flags); x0…y1 are the block's box. Any decoder of a binary
format that gives such rows can stand in front (see sources.parsers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings
from ..functions.text import squeeze, strip

BODY_SIZE, BOLD_FLAG, TOLERANCE = 10.0, 2, 2.0
BLANK_PAGES = ("boş sayfa", "bos sayfa", "blank page")
_MULTI, _CHAPTER, _LEADER = r"^[1-9]\d{0,2}\.\d+(\.\d+){0,3}\.?\s+\S", r"^\d+\s+[A-ZÇĞİÖŞÜ]", r"\.{4,}\s*\d+\s*$"


def common_size(spans: DataFrame, *by: str, name: str) -> DataFrame:
    """The most frequent rounded size; the first seen at a tie."""
    place = F.min(F.struct("page_no", "block_no", "line_no", "span_no"))
    counts = spans.groupBy(*by, F.round("size", 1).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), place.alias("_p"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "_p")))
    return best.where("_r = 1").select(*by, F.col("_s").alias(name))


def body_sizes(spans: DataFrame) -> DataFrame:
    """(document_id, page_no, body, page_body): the common size over sampled pages of the document, and over the text of the page."""
    pages = spans.groupBy("document_id").agg(F.max("page_no").alias("n"))
    start, step = F.greatest(F.lit(1), F.expr("n div 10")), F.greatest(F.lit(1), F.expr("(n - greatest(1, n div 10)) div 10"))
    index = F.col("page_no") - 1
    sampled = (F.col("n") <= 5) | ((index >= start) & ((index - start) % step == 0) & ((index - start) / step < 10))
    whole = common_size(spans.join(pages, "document_id").where(sampled), "document_id", name="body")
    page = common_size(spans.where(strip(F.col("text")) != ""), "document_id", "page_no", name="page_body")
    every = spans.select("document_id", "page_no").distinct()
    return every.join(whole, "document_id", "left").join(page, ["document_id", "page_no"], "left").select("document_id", "page_no", F.coalesce("body", F.lit(BODY_SIZE)).alias("body"), F.coalesce("page_body", "body", F.lit(BODY_SIZE)).alias("page_body"))


def heading_level(size: Column, body: Column, page_body: Column, text: Column, numbered: Column) -> Column:
    token = F.get(F.split(text, r"\s+"), F.lit(0))
    dots = F.length(token) - F.length(F.replace(token, F.lit("."), F.lit("")))
    diff, ratio = size - body, F.when(page_body > 0, size / page_body).otherwise(1.0)
    plain = F.when(diff >= 6, 1).when(diff >= 4, 2).when(diff >= 2, 3).when(diff >= 0.5, 4).otherwise(5)
    relative = F.when(ratio >= 1.6, 1).when(ratio >= 1.4, 2).when(ratio >= 1.25, 3).when(ratio >= 1.18, 4).otherwise(5)
    return F.when(numbered, F.least(F.lit(5), F.greatest(F.lit(1), dots + 1))).otherwise(F.least(plain, relative))


def layout_lines(spans: DataFrame) -> DataFrame:
    """(document_id, page_no, block_no, line_no, x0, y0, x1, y1, text, is_heading, level) of lines with text; dotted table-of-contents lines are left out."""
    there = spans.where(strip(F.col("text")) != "")
    chars = F.length("text")
    parts = F.array_sort(F.collect_list(F.struct("span_no", strip(F.col("text")).alias("t"))))
    lines = there.groupBy("document_id", "page_no", "block_no", "line_no").agg(
        *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")],
        squeeze(F.array_join(F.transform(parts, lambda x: x["t"]), " ")).alias("text"),
        F.max("size").alias("size"),
        (F.sum(F.when(F.col("flags").bitwiseAND(BOLD_FLAG) != 0, chars).otherwise(0)) / F.greatest(F.sum(chars), F.lit(1))).alias("bold"),
    )
    lines = lines.where(~F.col("text").rlike(_LEADER) & (F.col("text") != "")).join(body_sizes(spans), ["document_id", "page_no"])
    numbered = F.col("text").rlike(_MULTI) | F.col("text").rlike(_CHAPTER)
    short = (F.size(F.split("text", r"\s+")) <= 18) & (F.length("text") <= 140) & ~F.right("text", F.lit(1)).isin(*".!?,:;")
    ratio = F.when(F.col("page_body") > 0, F.col("size") / F.col("page_body")).otherwise(1.0)
    big = (F.col("size") > F.col("body") + 1.5) | ((F.col("size") > F.col("body") + 0.5) & (F.col("bold") > 0.6)) | (ratio >= 1.18)
    lines = lines.withColumn("is_heading", short & (big | numbered))
    return lines.withColumn("level", F.when(F.col("is_heading"), heading_level(F.col("size"), F.col("body"), F.col("page_body"), F.col("text"), numbered))).drop("size", "bold", "body", "page_body")


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a Markdown table; null cells are empty, line ends in cells are spaces."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(row(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), row)), "\n")


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """lines whose box lies in no table of the page, with some tolerance. An anti-join on the page with four inequalities."""
    t = tables.select(F.col("document_id").alias("_d"), F.col("page_no").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = (F.col("document_id") == F.col("_d")) & (F.col("page_no") == F.col("_p")) & (F.col("x0") >= F.col("_x0") - TOLERANCE) & (F.col("y0") >= F.col("_y0") - TOLERANCE) & (F.col("x1") <= F.col("_x1") + TOLERANCE) & (F.col("y1") <= F.col("_y1") + TOLERANCE)
    return lines.join(t, inside, "left_anti")


def to_markdown(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(document_id, text): page marks, headings, paragraphs and tables in reading order. tables: (document_id, page_no, x0, y0, x1, y1, cells array<array<string>>)."""
    lines = layout_lines(spans)
    if tables is not None:
        lines = outside_tables(lines, tables)
    order = Window.partitionBy("document_id", "page_no", "block_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # body lines between two headings of a block are one paragraph
    lines = lines.withColumn("run", F.count_if("is_heading").over(order))
    parts = lines.groupBy("document_id", "page_no", "block_no", "run", "is_heading").agg(
        F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.min("line_no").alias("line_no"), F.max("level").alias("level"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    text = F.when(F.col("is_heading"), F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    band = F.bround(F.col("y0") / 10) * 10
    pieces = parts.select("document_id", "page_no", band.alias("band"), F.lit(1).alias("kind"), F.col("y0").alias("y"), "x0", "block_no", "line_no", text.alias("piece"))
    if tables is not None:
        # of tables at the same height the last one stays; a table stands before the first block that begins below it
        tabs = tables.groupBy("document_id", "page_no", "y0").agg(F.max_by("cells", "x0").alias("cells"))
        first = parts.select("document_id", "page_no", F.col("y0").alias("_y"), (F.bround(F.col("y0") / 10) * 10).alias("_band"), F.col("x0").alias("_x"), F.col("block_no").alias("_b"))
        below = tabs.join(first, ["document_id", "page_no"], "left").groupBy("document_id", "page_no", "y0").agg(F.first("cells").alias("cells"), F.min(F.when(F.col("_y") > F.col("y0"), F.struct("_band", "_x", "_b"))).alias("at"))
        pieces = pieces.unionByName(below.select("document_id", "page_no", F.coalesce("at._band", F.lit(1e18)).alias("band"), F.lit(0).alias("kind"), F.col("y0").alias("y"), F.coalesce("at._x", F.lit(0.0)).alias("x0"), F.coalesce("at._b", F.lit(0)).alias("block_no"), F.lit(-1).alias("line_no"), table_markdown(F.col("cells")).alias("piece")))
    marks = spans.select("document_id", "page_no").distinct().select("document_id", "page_no", F.lit(-1e18).alias("band"), F.lit(-1).alias("kind"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x0"), F.lit(0).alias("block_no"), F.lit(-2).alias("line_no"), F.format_string("<!-- Page %d -->", "page_no").alias("piece"))
    every = pieces.unionByName(marks)
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "band", F.struct("x0", "block_no", "kind", "line_no").alias("o"), "piece")))
    joined = every.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n\n").alias("text"))
    return joined.withColumn("text", strip(F.regexp_replace("text", r"\n{3,}", "\n\n")))


def usable_bookmarks(marks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(document_id, n, share, usable) from bookmarks (document_id, seq, level, title, page, page_count): enough of them, and no slice between neighbours too large. Blank titles do not count."""
    named = meaningful(marks)
    gap = F.lead("page").over(Window.partitionBy("document_id").orderBy("page", "seq"))
    gaps = named.withColumn("gap", F.coalesce(gap, F.col("page_count") + 1) - F.col("page"))
    found = gaps.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(F.max("gap"), F.max("page_count")), F.lit(1e9)).alias("share"), F.max("page_count").alias("_c"))
    return found.select("document_id", "n", "share", ((F.col("n") >= settings.bookmark_min) & (F.col("_c") > 0) & (F.col("share") <= settings.bookmark_max_share)).alias("usable"))


def meaningful(marks: DataFrame) -> DataFrame:
    return marks.where((strip(F.col("title")) != "") & ~F.lower(strip(F.col("title"))).isin(*BLANK_PAGES))


def bookmark_nodes(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """Raw nodes (document_id, seq, level, heading, content, start_page, end_page) from usable bookmarks; pages (document_id, page_no, text).

    A node's text reaches to the next bookmark in list order, so of bookmarks on one page all but the last have none.
    """
    order = Window.partitionBy("document_id").orderBy("seq")
    named = meaningful(marks).join(usable_bookmarks(marks).where("usable").select("document_id"), "document_id", "left_semi")
    named = named.withColumn("next", F.coalesce(F.lead("page").over(order), F.col("page_count") + 1)).withColumn("start_page", F.greatest(F.lit(1), F.col("page")))
    named = named.withColumn("end_page", F.greatest("start_page", F.least("page_count", F.col("next") - 1)))
    # page ranges become rows, so that the join is by equal pages
    spread = named.withColumn("page_no", F.explode_outer(F.when(F.least("page_count", F.col("next") - 1) >= F.col("start_page"), F.sequence("start_page", F.least("page_count", F.col("next") - 1)))))
    filled = spread.join(pages.select("document_id", "page_no", "text"), ["document_id", "page_no"], "left")
    return filled.groupBy("document_id", "seq", "level", F.col("title").alias("heading"), "start_page", "end_page").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page_no", "text")))), lambda x: x["text"]), "\n")).alias("content")).select("document_id", "seq", "level", "heading", "content", "start_page", "end_page")


def items_to_markdown(items: DataFrame) -> DataFrame:
    """(document_id, text) of labelled items (document_id, pos, page, label, text): a page mark where the page changes, headings for titles and sections."""
    order = Window.partitionBy("document_id").orderBy("pos")
    changed = ~F.col("page").eqNullSafe(F.lag("page").over(order)) & F.col("page").isNotNull()
    piece = F.when(F.lower("label").rlike("header|title|section"), F.concat(F.lit("## "), F.col("text"))).otherwise(F.col("text"))
    rows = items.withColumn("piece", F.concat(F.when(changed, F.format_string("<!-- Page %d -->\n\n", "page")).otherwise(""), piece))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "\n\n").alias("text"))
