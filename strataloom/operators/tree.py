"""Heading trees: from Markdown or raw nodes, folded, and walked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings
from ..functions.text import fold, strip
from .checkpoints import cut

# Names of synthetic sections, and headings that are only lists of what a document holds.
PREAMBLE, WHOLE = "Giriş", "Belge İçeriği"
NOISE = ("icindekiler", "sekiller listesi", "tablolar listesi", "sekil listesi", "tablo listesi")
ABSTRACTS = ("özet", "abstract", "ozet", "öz", "summary")
#: Distinct levels that raw nodes may have; more are refused. Markdown has MARKDOWN_LEVELS.
MAX_LEVELS, MARKDOWN_LEVELS = 64, (1, 2, 3, 4, 5)
#: Raw nodes of a task, about: what a task sorts and gathers is many times what its nodes take in a shuffle, by which Spark joins partitions.
TASK_NODES = 200_000
#: Doubling steps after which a chain of parents must be a circle.
MAX_STEPS = 40
HEADING, MARKER = r"^(#{1,5})\s+(.+)$", r"^<!-- Page (\d+) -->"


def raw_sections(docs: DataFrame) -> DataFrame:
    """(document_id, seq, level, heading, content, start_line, end_line, start_page, end_page) of Markdown documents (document_id, text).

    One shuffle by document; each line then knows its section by a running count of headings.
    """
    lines = docs.select("document_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "raw"))
    line = strip(F.col("raw"))
    lines = lines.withColumn("line", line).withColumn("no", F.col("pos") + 1)
    lines = lines.withColumn("marker", F.regexp_extract("line", MARKER, 1)).withColumn("is_head", F.col("line").rlike(HEADING) & (F.col("marker") == ""))
    upto = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy("document_id")
    lines = lines.withColumn("page", F.coalesce(F.last(F.when(F.col("marker") != "", F.col("marker").cast("int")), ignorenulls=True).over(upto), F.lit(1)))
    lines = lines.withColumn("heads", F.count_if("is_head").over(upto)).withColumn("last_no", F.max("no").over(everything))
    # text before the first heading makes a section if it is more than blank lines
    body = ~F.col("is_head") & (F.col("marker") == "")
    early = F.count_if(body & (F.col("heads") == 0) & (F.col("line") != "")).over(everything) > 0
    # a document without any section is one empty node
    whole = (F.max("heads").over(everything) == 0) & ~F.col("early")
    lines = lines.withColumn("early", early).withColumn("whole", whole).where("heads > 0 or early or whole")
    lines = lines.withColumn("seq", F.col("heads") + F.when(F.col("early") | F.col("whole"), 1).otherwise(0))
    first_text = F.min(F.when((F.col("heads") == 0) & body & (F.col("line") != ""), F.col("no")))
    grouped = lines.groupBy("document_id", "seq").agg(
        F.max(F.when(F.col("is_head"), F.length(F.regexp_extract("line", HEADING, 1)))).alias("level"),
        F.max(F.when(F.col("is_head"), strip(F.regexp_extract("line", HEADING, 2)))).alias("heading"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("pos", "raw")))), lambda x: x["raw"]), "\n")).alias("content"),
        F.coalesce(F.max(F.when(F.col("is_head"), F.col("no"))), first_text, F.lit(1)).alias("start_line"),
        F.max("no").alias("end_line"),
        F.coalesce(F.max(F.when(F.col("is_head"), F.col("page"))), F.min(F.when(body & (F.col("line") != ""), F.col("page"))), F.lit(1)).alias("start_page"),
        F.max("page").alias("end_page"),
        F.max("whole").alias("whole"),
    )
    found = grouped.withColumn("level", F.coalesce("level", F.lit(1))).withColumn("heading", F.coalesce("heading", F.when(F.col("whole"), WHOLE).otherwise(PREAMBLE)))
    return found.withColumn("end_page", F.when(F.col("whole"), 1).otherwise(F.col("end_page"))).drop("whole")


def _noise(heading: Column) -> Column:
    return strip(fold(heading)).isin(*NOISE)


def with_parents(sections: DataFrame, levels: tuple[int, ...] | None = None) -> DataFrame:
    """Adds node_id (1-based in order), parent_id (the nearest earlier node of a lower level), path (the headings from the root, joined by ' > ') and up: structs (node_id, level, heading, noise) of the ancestors, the root first.

    Levels may skip; below 1 they count as 1. levels are those that may occur; without them they are looked up (at most MAX_LEVELS, else
    ValueError). One window by document gives it all: the last node of level k before a node is its ancestor if no node of a lower level
    has come since.
    """
    sections = sections.withColumn("level", F.greatest("level", F.lit(1)))
    if levels is None:
        # at most MAX_LEVELS + 1 rows
        found = sections.groupBy("level").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LEVELS + 1).collect()
        levels = sorted(r["level"] for r in found)
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"nodes of more than {MAX_LEVELS} levels")
        sections = sections.repartition(sum(r["n"] for r in found) // TASK_NODES + 1, "document_id")
    order = Window.partitionBy("document_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = sections.withColumn("node_id", F.row_number().over(order))
    own = F.struct("node_id", "level", "heading", _noise(F.col("heading")).alias("noise"))
    last = [F.when(F.col("level") > k, F.max(F.when(F.col("level") == k, F.struct("node_id", "level", "heading", "noise"))).over(before)) for k in levels[:-1]]
    nodes = nodes.withColumn("noise", own["noise"])
    if not last:
        kind = "array<struct<node_id:int,level:int,heading:string,noise:boolean>>"
        return nodes.drop("noise").withColumn("up", F.array().cast(kind)).withColumn("parent_id", F.lit(None).cast("int")).withColumn("path", F.col("heading"))
    nodes = nodes.withColumn("up", F.array_compact(F.array(*last))).drop("noise")
    open_ = lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, 1, i), lambda y: y["node_id"] > x["node_id"]))
    nodes = nodes.withColumn("up", open_(F.col("up")))
    nodes = nodes.withColumn("parent_id", F.try_element_at("up", F.lit(-1))["node_id"])
    return nodes.withColumn("path", F.array_join(F.concat(F.transform("up", lambda x: x["heading"]), F.array("heading")), " > "))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(document_id, node_id, up): ids of the node and of its ancestors, the root last, by pointer doubling until no chain grows.

    Only ids take part. Each step is cut, as its plan would hold the one before twice. Parents in a circle are an error.
    """
    out = cut(nodes.select("document_id", "node_id", F.when(F.col("parent_id").isNull(), F.array("node_id")).otherwise(F.array("node_id", "parent_id")).alias("up")))
    for _ in range(MAX_STEPS):
        top = out.where("size(up) > 1").select(F.col("document_id").alias("_d"), F.col("node_id").alias("_n"), F.col("up").alias("_up"))
        if top.isEmpty():
            return out
        joined = out.join(top, (F.col("document_id") == F.col("_d")) & (F.element_at("up", -1) == F.col("_n")), "left")
        out = cut(joined.select("document_id", "node_id", F.coalesce(F.concat("up", F.expr("slice(_up, 2, size(_up))")), F.col("up")).alias("up"), F.col("_up").isNotNull().alias("grew")))
        # one row
        state = out.agg(F.max("grew").alias("grew"), F.max(F.size(F.array_distinct("up")) < F.size("up")).alias("again")).first()
        if state["again"]:
            break
        out = out.drop("grew")
        if not state["grew"]:
            return out
    raise ValueError("the parents of some nodes form a circle")


def finalize(nodes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Without list-of-contents headings; nodes deeper than the limit are folded into their nearest kept ancestor; leaves are marked.

    nodes are those of with_parents. Children of a removed node become roots and keep their path. What hangs too deep below a removed
    node is lost. A node knows its ancestors, so each row says where its text goes and whose child it is; one group-by does the rest.
    """
    limit = settings.max_tree_depth
    kept = nodes.where(~_noise(F.col("heading")))
    # from the parent up to the first removed node
    chain = F.reverse("up")
    kept = kept.withColumn("_chain", F.transform(F.filter(chain, lambda x, i: ~F.exists(F.slice(chain, 1, i + 1), lambda y: y["noise"])), lambda x: F.struct(x["node_id"].alias("node_id"), x["level"].alias("level"))))
    kept = kept.withColumn("parent_id", F.get("_chain", F.lit(0))["node_id"])
    home = F.when(F.col("level") <= limit, F.col("node_id")).otherwise(F.get(F.filter("_chain", lambda x: x["level"] <= limit), F.lit(0))["node_id"])
    columns = [c for c in nodes.columns if c not in ("document_id", "up")]
    text = F.regexp_replace(F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("heading"), F.lit("\n"), F.coalesce("content", F.lit(""))), r"\s+$", "")
    kept = kept.withColumn("_home", home).where("_home is not null")
    stays = F.col("level") <= limit
    said = F.array_compact(F.array(
        F.struct(F.col("_home").alias("at"), F.when(stays, F.struct(*columns)).alias("own"), F.when(~stays, F.struct("node_id", text.alias("text"), "end_page")).alias("more"), F.lit(False).alias("inner")),
        F.when(stays & F.col("parent_id").isNotNull(), F.struct(F.col("parent_id").alias("at"), F.lit(None).alias("own"), F.lit(None).alias("more"), F.lit(True).alias("inner"))),
    ))
    told = kept.select("document_id", F.inline(said))
    whole = told.groupBy("document_id", "at").agg(F.max("own").alias("own"), F.array_sort(F.collect_list("more")).alias("f"), F.max("inner").alias("inner"))
    out = whole.where("own is not null").select("document_id", "own.*", "f", "inner")
    joined = F.array_join(F.transform("f", lambda x: x["text"]), "")
    out = out.withColumn("content", F.when(F.size("f") == 0, F.col("content")).otherwise(strip(F.concat(F.coalesce("content", F.lit("")), joined))))
    last = F.try_element_at(F.filter(F.transform("f", lambda x: x["end_page"]), lambda x: x.isNotNull()), F.lit(-1))
    return out.withColumn("end_page", F.coalesce(last, "end_page")).withColumn("is_leaf", F.when(F.col("inner"), 0).otherwise(1)).drop("f", "inner")


def markdown_tree(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return finalize(with_parents(raw_sections(docs), MARKDOWN_LEVELS), settings)


def tree_from_raw(raw: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Nodes of a parser (document_id, seq, heading, level, content, start_page, end_page); line numbers are unknown."""
    return finalize(with_parents(raw.withColumn("start_line", F.lit(None).cast("int")).withColumn("end_line", F.lit(None).cast("int"))), settings)


def children(nodes: DataFrame, parent: Column | int | None) -> DataFrame:
    """Children of a node, the roots for None."""
    at = F.lit(parent) if not isinstance(parent, Column) else parent
    return nodes.where(F.col("parent_id").eqNullSafe(at)).orderBy("node_id")


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(…roots' columns, node_id) of all nodes at or below the roots (document_id, root, …). Each node names its ancestors, so one join is enough."""
    up = ancestors(nodes.select("document_id", "node_id", "parent_id")).select("document_id", "node_id", F.explode("up").alias("root"))
    return roots.join(up, ["document_id", "root"]).drop("root").distinct()


def intervals(nodes: DataFrame) -> DataFrame:
    """(document_id, node_id, first, last, n_below): numbers of the nodes of a document in the order of its tree, siblings by id; those from first to last are the node and all below it, n_below of them.

    A walk around the tree enters and leaves each node once. Each of these steps knows the next one, and how many nodes are entered from
    a step on is found by pointer jumping: in every round a step adds what its next one has counted and takes that one's next. So rows
    stay twice the nodes, however deep a tree is, and rounds are the logarithm of the largest tree. Roots follow each other; a node whose
    parent is not there is a root. Parents in a circle are an error.
    """
    own = nodes.select("document_id", F.col("node_id").cast("bigint").alias("v"), F.col("parent_id").cast("bigint").alias("p"))
    there = own.select("document_id", F.col("v").alias("p"), F.lit(True).alias("there"))
    own = own.join(there, ["document_id", "p"], "left").withColumn("p", F.when(F.col("there"), F.col("p"))).drop("there")
    siblings = Window.partitionBy("document_id", "p").orderBy("v")
    own = own.withColumn("after", F.lead("v").over(siblings))
    down = own.where("p is not null").groupBy("document_id", F.col("p").alias("v")).agg(F.min("v").alias("child"))
    enter, leave = lambda x: F.col(x) * 2, lambda x: F.col(x) * 2 + 1
    walk = own.join(down, ["document_id", "v"], "left").select(
        "document_id",
        F.inline(F.array(
            F.struct(enter("v").alias("step"), F.coalesce(enter("child"), leave("v")).alias("next"), F.lit(1).cast("bigint").alias("n")),
            F.struct(leave("v").alias("step"), F.coalesce(enter("after"), leave("p")).alias("next"), F.lit(0).cast("bigint").alias("n")),
        )),
    )
    walk = cut(walk)
    # a jump doubles what a step has counted, so the longest walk ends after the logarithm of all steps
    for _ in range(walk.count().bit_length() + 1):
        open_ = walk.where("next is not null")
        if open_.isEmpty():
            break
        further = walk.select("document_id", F.col("step").alias("next"), F.col("next").alias("then"), F.col("n").alias("more"))
        walk = cut(walk.where("next is null").unionByName(open_.join(further, ["document_id", "next"]).select("document_id", "step", F.col("then").alias("next"), (F.col("n") + F.col("more")).alias("n"))))
    else:
        if not walk.where("next is not null").isEmpty():
            raise ValueError("the parents of some nodes form a circle")
    # nodes entered from a step on to the document's end
    by_node = walk.groupBy("document_id", F.shiftright("step", 1).alias("node_id")).agg(F.max(F.when(F.col("step") % 2 == 0, F.col("n"))).alias("from"), F.max(F.when(F.col("step") % 2 == 1, F.col("n"))).alias("behind"))
    whole = by_node.groupBy("document_id").agg(F.max("from").alias("whole"))
    first = F.col("whole") - F.col("from") + 1
    n_below = F.col("from") - F.col("behind")
    return by_node.join(whole, "document_id").select("document_id", "node_id", first.alias("first"), (first + n_below - 1).alias("last"), n_below.alias("n_below"))


def below(numbered: DataFrame, roots: DataFrame) -> DataFrame:
    """(…roots' columns, node_id) of all nodes at or below the roots (document_id, root, …), from intervals: a test of ranges within the document."""
    top = numbered.select("document_id", F.col("node_id").alias("root"), F.col("first").alias("_from"), F.col("last").alias("_to"))
    open_ = roots.withColumn("root", F.col("root").cast("bigint")).join(top, ["document_id", "root"])
    return open_.join(numbered.select("document_id", "node_id", "first"), "document_id").where("first between _from and _to").drop("root", "_from", "_to", "first").distinct()


def abstract_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.lower(strip(F.col("heading"))).isin(*ABSTRACTS))


def worth_descending(nodes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(document_id) of the documents with enough nodes."""
    return nodes.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {settings.descent_min_nodes}").select("document_id")


def renumber_headings(markdown: Column) -> Column:
    """Each heading's level by the dots of its leading number; without a number 1; 5 at most."""

    def one(line: Column) -> Column:
        text = F.regexp_extract(line, r"^#{1,6}\s+(.*)$", 1)
        number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)", 1)
        level = F.when(number == "", 1).otherwise(F.least(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1, F.lit(5)))
        return F.when(line.rlike(r"^#{1,6}\s+\S"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), strip(text))).otherwise(line)

    return F.array_join(F.transform(F.split(markdown, "\n"), one), "\n")


def level_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_leaf") == 1).alias("leaves"))
