"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Equal lines (128 bits of hash of the line without outer white space) are one item, made before anything else is computed. An item's
shingles are all its runs of SHINGLE code points, in lower case (a shorter line is one shingle). Each shingle is a row, and a MinHash is
a least value of a hash function over the rows of an item, so that hashes and least values run in generated code; shingles are rows
inside a task only, as they are grouped by the key that items are dealt by. ROWS MinHashes form a band; BANDS bands find a pair of
similarity 0.8 with a probability of 0.997. Items that share a band are verified by the exact Jaccard similarity of their shingles.
Components of the links keep their first line; later lines go.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import alike_sets, among, dense, placed, set_classes, shared_buckets, with_contents
from .common import cut, let, table

SHINGLE, SIMILARITY, BANDS, ROWS = 9, 0.8, 8, 3
#: Shingles that start in a piece of a line.
PIECE = 32
# one match at each code point that a whole shingle follows, or one for a shorter line
_EACH = rf"(?s)(?=(.{{{SHINGLE}}}|\A.{{1,{SHINGLE - 1}}}\z))."
# pieces that hold each of these shingles once, and cost no walk from the line's start
_PIECES = rf"(?s)(?=(.{{{SHINGLE},{PIECE + SHINGLE - 1}}}|\A.{{1,{SHINGLE - 1}}}\z)).{{1,{PIECE}}}"
_SPACE = " \t\r\x0b\x0c"


def shingles(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(_EACH), F.lit(1))


def shingle_set(line: Column) -> Column:
    """Hashes of 64 bits of the distinct shingles."""
    return F.array_distinct(F.transform(shingles(line), lambda x: F.xxhash64(x)))


def shingle_rows(items: DataFrame, *keep: str) -> DataFrame:
    """(keep, s): a row with the hash of 64 bits for each shingle of line, repeated ones included."""
    pieces = items.select(*keep, F.explode(F.regexp_extract_all(F.lower("line"), F.lit(_PIECES), F.lit(1))).alias("piece"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.length("piece") - (SHINGLE - 1), F.lit(1))))
    return pieces.select(*keep, "piece", starts.alias("at")).select(*keep, F.xxhash64(F.col("piece").substr(F.col("at"), F.lit(SHINGLE))).alias("s"))


def band_keys(items: DataFrame) -> DataFrame:
    """(h1, h2, n, k0, ...) of items (h1, h2, n, line) of distinct lines with a character that is not white space: BANDS keys each."""
    halves = []
    for j in range(-(-BANDS * ROWS // 2)):
        # one hash gives the values of two functions
        h = F.xxhash64(F.col("s").bitwiseXOR(F.lit(j + 1).cast("long")))
        halves += [h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32)]
    mins = shingle_rows(items, "h1", "h2", "n").groupBy("h1", "h2").agg(F.max("n").alias("n"), *[F.min(x).alias(f"m{i}") for i, x in enumerate(halves[: BANDS * ROWS])])
    return mins.select("h1", "h2", "n", *[F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]).alias(f"k{b}") for b in range(BANDS)])


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, th, pos, line, h1, h2) of each line with more than white space; line is without outer white space."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "raw"))
    # btrim walks the whole line, so only lines with something to take off go through it
    edge = reduce(or_, [test(F.lit(x)) for x in _SPACE for test in (F.col("raw").startswith, F.col("raw").endswith)])
    rows = rows.select("i", "th", "pos", F.when(edge, F.btrim("raw", F.lit(_SPACE))).otherwise(F.col("raw")).alias("line")).where("line <> ''")
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64("line", F.lit("second")))


#: Whether a line is the one of its class that stays.
_STAYS = "i <=> keep_i and th = keep_th and pos = keep_pos"


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, th, pos, class, keep_i, keep_th, keep_pos) of each line that equals or resembles another one.

    The first line of a class by (id, hash of the text, place) stays; a null id comes before all others. Rows with equal id and text are
    one document, also with a null id. A long line is compared whole; an empty table gives an empty result.
    """
    lines = lines_of(docs, id_col, text_col)
    distinct = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    items = cut(band_keys(distinct).withColumn("id", F.monotonically_increasing_id()))
    bands = items.select("id", F.explode(F.array(*[f"k{b}" for b in range(BANDS)])).alias("key"))
    buckets = dense(shared_buckets(bands))
    wanted = dense(items.join(buckets.select("id").distinct(), "id").select("h1", "h2", "id"))
    # any of the equal lines gives the text
    found = among(lines.select("h1", "h2", "line"), "h1", wanted, "h1").join(wanted, ["h1", "h2"])
    texts = placed(found.groupBy("id").agg(F.min("line").alias("line")))

    def verify(pairs: DataFrame) -> DataFrame:
        sides = with_contents(pairs, texts, "line")
        return sides.where(alike_sets(shingle_set(F.col("x")), shingle_set(F.col("y")), SIMILARITY)).select("a", "b")

    roots = set_classes(buckets, verify, texts, shingle_set(F.col("line")), SIMILARITY)
    member = items.select("h1", "h2", "id", "n").join(roots, "id", "left").where("n > 1 or root is not null").select("h1", "h2", F.coalesce("root", "id").alias("class"))
    member = cut(member)
    places = among(lines.select("i", "th", "pos", "h1", "h2"), "h1", member, "h1").join(member, ["h1", "h2"]).select("class", "i", "th", "pos")
    places = cut(places)
    first = places.groupBy("class").agg(F.min(F.struct("i", "th", "pos")).alias("first"))
    return places.join(first, "class").select("i", "th", "pos", "class", F.col("first.i").alias("keep_i"), F.col("first.th").alias("keep_th"), F.col("first.pos").alias("keep_pos"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of text; all rows and columns stay, n_chars follows the text if there is such a column.

    A null or empty text stays as it is; a text whose lines all go becomes empty. Lines of white space only stay where they are unless
    all other lines go. Ties are settled by (id, hash of the text, place); rows with equal id and text keep the same lines.
    """
    gone = classes(docs).where(f"not ({_STAYS})").distinct().groupBy("i", "th").agg(F.collect_set("pos").alias("_gone"))
    gone = gone.select(F.col("i").alias("_i"), F.col("th").alias("_th"), "_gone")
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_i"]) & (F.xxhash64(docs["text"]) == gone["_th"]), "left")
    kept = let(F.split(docs["text"], "\n", -1), lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), gone["_gone"]), lambda p: F.get(all_, p)), "\n"))
    kept = let(kept, lambda x: F.when(F.btrim(x, F.lit(_SPACE + "\n")) == "", F.lit("")).otherwise(x))
    text = F.when(gone["_gone"].isNull(), docs["text"]).otherwise(kept)
    columns = {"text": text} | ({"n_chars": F.when(gone["_gone"].isNull(), docs["n_chars"]).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return joined.select(*[columns.get(c, docs[c]).alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line that has an equal or similar one: where it stands, and the line of its class that stays."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("i").alias("doc_id"), F.col("pos").alias("line_no"), F.col("keep_i").alias("keep_doc_id"), F.col("keep_pos").alias("keep_line_no"), F.expr(_STAYS).alias("kept"))


QUERIES, SQL = {"op5_line_dedup": op5_line_dedup}, {}
