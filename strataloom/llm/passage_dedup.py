"""Repeated passages: MinHash banding of paragraphs, and runs of equal words inside them.

A paragraph is a line of at least PARAGRAPH words, as many as a shingle has. Paragraphs get BANDS bands of ROWS MinHashes over their runs of WORDS words (so a pair of
similarity 0.8 meets with a probability of 0.997); those that share a band are verified by the exact Jaccard similarity of these runs,
links form components, the first paragraph of a component stays.

Passages are also copied into the middle of other text. For these, blocks of BLOCK words are compared: they start where a run of three
words has the least hash among NEAR neighbours (winnowing), so that two copies of any passage of NEAR + BLOCK - 1 words or more choose a
common block inside it, wherever the copies stand. The first of equal blocks stays. Blocks of a document that stand elsewhere as well and
touch are one run, and runs are extended on both sides, word by word, as far as the text agrees that the first (last) block meets: a
flank holds no block, so it has at most NEAR words.

Removed paragraphs and runs of a document that overlap or touch are one removed span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cluster import among, placed, set_classes, shared_buckets, with_contents
from .common import cut, hash_words, mix, slices, stored, sweep, table, windows

WORDS, PARAGRAPH, BLOCK, NEAR, SIMILARITY, BANDS, ROWS = 5, 5, 24, 26, 0.8, 8, 3
KEYS = [f"k{b}" for b in range(BANDS)]
_MOST = np.uint64(2**64 - 1)


def paragraphs(text: str, least: int = PARAGRAPH) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of the text, and first and last word + 1 of each line of at least least words (WORDS or more)."""
    words, edges = [], [0]
    for line in text.split("\n"):
        words += line.split()
        edges.append(len(words))
    bounds = np.array(edges)
    whole = np.flatnonzero(np.diff(bounds) >= max(least, WORDS))
    return words, bounds[whole], bounds[whole + 1]


def blocks(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which text each block is of, and its first word there, from the hashes of the words of all texts; texts of fewer than BLOCK words have none."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    full = np.flatnonzero(lengths >= BLOCK)
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the places of each text's possible blocks, with a gap of NEAR before the next text
    sizes = lengths[full] - BLOCK + 1
    begin = np.concatenate([[0], np.cumsum(sizes + NEAR)])
    owner = np.repeat(np.arange(len(full)), sizes)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = windows(hashes, 3)[starts[full][owner] + inner]
    padded = np.full(begin[-1], _MOST)
    padded[begin[owner] + inner] = h
    # of a run of equal ones only the first can be the least
    same = np.flatnonzero((padded[1:] == padded[:-1]) & (padded[1:] != _MOST)) + 1
    padded[same] = _MOST - np.uint64(1)
    least = np.lib.stride_tricks.sliding_window_view(padded, NEAR)
    firsts = begin[owner] + inner
    firsts = firsts[inner < np.maximum(sizes - NEAR + 1, 1)[owner]]
    at = np.unique(np.concatenate([least[part].argmin(1) + part for part in np.array_split(firsts, len(firsts) // 100_000 + 1)]))
    text = np.searchsorted(begin, at, "right") - 1
    return full[text], at - begin[text]


def minhashes(grams: np.ndarray, first: np.ndarray, stop: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n MinHashes of each paragraph (of at least WORDS words) over its runs of WORDS words."""
    edges = np.stack([first, stop - WORDS + 1], 1).ravel()
    out = np.empty((n, len(first)), np.uint64)
    for k in range(n):
        out[k] = np.minimum.reduceat(np.append(mix(grams, k + 1), _MOST), edges)[::2] if len(first) else []
    return out


def _sums(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Prefix sums from which any run of words gets a hash of its words and their order."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    pair = mix(hashes, seed)
    pair[:-1] = mix(hashes[:-1] ^ mix(hashes[1:], seed), seed + 1)
    with np.errstate(over="ignore"):
        np.cumsum(pair, out=out[1:])
    return out


def _run_hash(sums: np.ndarray, hashes: np.ndarray, first: np.ndarray, stop: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(sums[stop - 1] - sums[first] + mix(hashes[stop - 1], seed + 2) + (stop - first).astype(np.uint64), seed).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PARAGRAPH) -> DataFrame:
    """(h, h2, i, th, place, k0, k1, …): a row for each paragraph and block; h and h2 are hashes of its words, place is first word << 32 | last word + 1, the k are its bands (null for a block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            found = [paragraphs(text or "", least) for text in texts]
            lengths = np.array([len(w) for w, _, _ in found], np.int64)
            start = np.concatenate([[0], np.cumsum(lengths)])
            hashes = hash_words([w for words, _, _ in found for w in words])
            owner = np.repeat(np.arange(len(found)), [len(x) for _, x, _ in found])
            first = np.concatenate([x for _, x, _ in found]).astype(np.int64)
            stop = np.concatenate([x for _, _, x in found]).astype(np.int64)
            if not len(hashes) or not len(first):
                first, stop, owner = (np.zeros(0, np.int64) for _ in range(3))
            of_block, at = blocks(hashes, lengths)
            got = minhashes(windows(hashes, WORDS), first + start[owner], stop + start[owner]) if len(first) else np.zeros((BANDS * ROWS, 0), np.uint64)
            keys = np.stack([_band(got[b * ROWS : (b + 1) * ROWS], b) for b in range(BANDS)], 1).view(np.int64)
            every = np.concatenate([owner, of_block])
            first, stop = np.concatenate([first, at]), np.concatenate([stop, at + BLOCK])
            if not len(every):
                continue
            h, h2 = (_run_hash(_sums(hashes, s), hashes, first + start[every], stop + start[every], s) for s in (3, 17))
            block = np.concatenate([np.zeros(len(keys), bool), np.ones(len(at), bool)])
            keys = np.concatenate([keys, np.zeros((len(at), BANDS), np.int64)])
            i, th = (np.asarray(part.column(x))[every] for x in ("i", "th"))
            columns = [*(pa.array(x, pa.int64()) for x in (h, h2, i, th, (first << 32) + stop)), *(pa.array(k, pa.int64(), mask=block) for k in keys.T)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "h2", "i", "th", "place", *KEYS])

    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "h long, h2 long, i long, th long, place long, " + ", ".join(f"{k} long" for k in KEYS))


def _band(rows: np.ndarray, band: int) -> np.ndarray:
    out = np.full(rows.shape[1], band, np.uint64)
    for row in rows:
        out = mix(out ^ row)
    return out


def _words(docs: DataFrame, places: DataFrame, give, columns: str) -> DataFrame:
    """(id, ...): what give makes of the words and a place, for places (i, th, id, first, stop); docs has i, th, t. Each text is read once for all of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            rows = []
            for at, text in zip(part.column("at").to_pylist(), texts):
                words = (text or "").split()
                rows += [(x["id"], *give(words, x["first"], x["stop"])) for x in at]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    names = ["id", *(x.split()[0] for x in columns.split(", "))]
    kinds = [pa.int64(), *(pa.list_(pa.int64()) if "array" in x else pa.string() for x in columns.split(", "))]
    wanted = places.groupBy("i", "th").agg(F.collect_list(F.struct("id", "first", "stop")).alias("at"))
    return docs.join(wanted, ["i", "th"]).dropDuplicates(["i", "th"]).select("t", "at").mapInArrow(run, f"id long, {columns}")


def _grams(words: list[str], first: int, stop: int) -> tuple:
    return (np.unique(windows(hash_words(words[first:stop]), WORDS)).view(np.int64),)


def _flanks(words: list[str], first: int, stop: int) -> tuple:
    """Hashes of the words before (the nearest first) and behind, NEAR of each."""
    before, behind = words[max(0, first - NEAR) : first][::-1], words[stop : stop + NEAR]
    return hash_words(before).view(np.int64), hash_words(behind).view(np.int64)


def paragraph_classes(lines: DataFrame, docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(i, th, place, keep_i) of the paragraphs that go. lines: (h, h2, i, th, place, k0, k1, …)."""
    # equal paragraphs have equal keys, and any of them stands for all; numbers alone fit the fast aggregate
    one = F.xxhash64("i", "th", "place")
    items = lines.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one"), *[F.min(k).alias(k) for k in KEYS])
    items = cut(items.withColumn("id", F.monotonically_increasing_id()))
    buckets = cut(shared_buckets(items.select("id", F.explode(F.array(*KEYS)).alias("key"))))
    wanted = cut(items.select("h", "h2", "one", "id").join(buckets.select("id").distinct(), "id"))
    lines = lines.drop(*KEYS)
    there = among(lines, "h", wanted, "h").withColumn("one", one).join(wanted, ["h", "h2", "one"]).select("i", "th", "id", *_place())
    sets = placed(_words(docs, there, _grams, "s array<bigint>"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                both = len(np.intersect1d(x.values, y.values, assume_unique=True))
                good.append(both >= threshold * (len(x.values) + len(y.values) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        return with_contents(pairs, sets, "s").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long")

    roots = set_classes(buckets, verify, sets, F.col("s"), threshold)
    named = items.select("h", "h2", "id", "n").join(roots, "id", "left").where("n > 1 or root is not null").select("h", "h2", F.coalesce("root", "id").alias("class"))
    named = cut(named)
    members = cut(among(lines, "h", named, "h").join(named, ["h", "h2"]).select("class", "i", "th", "place"))
    first = members.groupBy("class").agg(F.min(F.struct("i", "th", "place")).alias("keep"))
    return members.join(first, "class").where("i <> keep.i or th <> keep.th or place <> keep.place").select("i", "th", "place", F.col("keep.i").alias("keep_i"))


def _place() -> list:
    return [F.shiftright("place", 32).cast("int").alias("first"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("stop")]


def equal_runs(inner: DataFrame, docs: DataFrame) -> DataFrame:
    """(i, th, first, stop, keep_i, keeps) of the runs of words that stand elsewhere as well, extended to their full length; keep_i holds the first part, keeps are all that hold a part. inner: (h, h2, i, th, place) of blocks."""
    # most blocks stand in one place and go here; only a key and a number are shuffled for that
    several = inner.select("h", F.xxhash64("i", "th", "place").alias("d")).groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("h")
    several = cut(several)
    rows = cut(among(inner, "h", several, "h").join(several, "h"))
    first = rows.groupBy("h", "h2").agg(F.min(F.struct("i", "th", "place")).alias("keep"))
    gone = rows.join(first, ["h", "h2"]).where("i <> keep.i or th <> keep.th or place <> keep.place")
    begin = lambda x: F.shiftright(x, 32).cast("int")
    gone = gone.select("i", "th", begin("place").alias("first"), F.col("keep.i").alias("keep_i"), F.col("keep.th").alias("keep_th"), begin("keep.place").alias("at")).distinct()
    gone = gone.withColumn("shift", F.col("at") - F.col("first"))
    # a block that overlaps the one that stays would take that away
    same = (F.col("i") == F.col("keep_i")) & (F.col("th") == F.col("keep_th"))
    gone = gone.where(~same | (F.col("first") >= F.col("at") + BLOCK))
    # blocks that touch or overlap are one run; so are neighbours with a small gap that meet the same text at the same distance
    line = Window.partitionBy("i", "th").orderBy("first")
    alike = F.coalesce(F.struct("keep_i", "keep_th", "shift") == F.lag(F.struct("keep_i", "keep_th", "shift")).over(line), F.lit(False))
    gap = F.col("first") - F.lag("first").over(line) - BLOCK
    new = F.coalesce(gap > F.when(alike, NEAR - BLOCK).otherwise(0), F.lit(True))
    runs = gone.withColumn("new", new).withColumn("k", F.count_if("new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    end = F.struct("first", "keep_i", "keep_th", "shift")
    runs = runs.groupBy("i", "th", "k").agg(F.min(end).alias("left"), F.max(end).alias("right"), F.collect_set("keep_i").alias("keeps"))
    runs = cut(runs.withColumn("id", F.monotonically_increasing_id()))
    # before its first block and behind its last one a run may go on, as far as the text that it meets there does
    own = {"left": ("i", "th", "left.first"), "right": ("i", "th", "right.first")}
    met = {k: (f"{k}.keep_i", f"{k}.keep_th", f"{k}.at") for k in own}
    sides = runs.select("id", "i", "th", *[F.struct(*[F.col(f"{k}.{c}").alias(c) for c in ("first", "keep_i", "keep_th", "shift")], (F.col(f"{k}.first") + F.col(f"{k}.shift")).alias("at")).alias(k) for k in own])
    asked = None
    for places in (own, met):
        for x, y, z in places.values():
            part = sides.select(F.col(x).alias("i"), F.col(y).alias("th"), F.col(z).alias("first"))
            asked = part if asked is None else asked.unionByName(part)
    # many runs may meet one place, so each place is taken once
    spots = cut(asked.distinct().withColumn("stop", F.col("first") + BLOCK).withColumn("id", F.monotonically_increasing_id()))
    # read four times below; the texts are shuffled for it, and those files may go before the next ones are written
    flanks = stored(spots.join(_words(docs, spots, _flanks, "before array<bigint>, behind array<bigint>"), "id"), compression="zstd")
    sweep(docs.sparkSession)

    def agreed(a: str, b: str):
        """How many elements agree from the start."""
        unlike = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
        return F.when(unlike == 0, F.least(F.size(a), F.size(b))).otherwise(unlike - 1).cast("int")

    def grown(side: str, flank: str) -> DataFrame:
        """(id, side: by how many words the run grows there)."""
        out = sides.select("id", *[F.col(c).alias(f"_{n}") for n, c in enumerate(own[side])], *[F.col(c).alias(f"_{n + 3}") for n, c in enumerate(met[side])])
        for n, name in ((0, "x"), (3, "y")):
            out = out.join(flanks.select(*[F.col(c).alias(f"_{n + m}") for m, c in enumerate(("i", "th", "first"))], F.col(flank).alias(name)), [f"_{n}", f"_{n + 1}", f"_{n + 2}"])
        return out.select("id", agreed("x", "y").alias(f"grow_{side}"))

    out = runs.join(grown("left", "before"), "id").join(grown("right", "behind"), "id")
    out = out.withColumn("stop", F.col("right.first") + BLOCK + F.col("grow_right"))
    # inside a document the copy that stays ends where the other may begin
    here = (F.col("i") == F.col("left.keep_i")) & (F.col("th") == F.col("left.keep_th"))
    least = F.when(here, F.least(F.col("left.first"), F.col("left.first") + F.col("left.shift") + BLOCK)).otherwise(0)
    return out.select("i", "th", F.greatest(least, F.col("left.first") - F.col("grow_left")).alias("first"), "stop", F.col("left.keep_i").alias("keep_i"), "keeps")


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = PARAGRAPH) -> DataFrame:
    """(doc_id, first_word, last_word, n_words, keep_doc_id, keep_doc_ids): the spans to remove from each document, by places of its words.

    keep_doc_id is the document that keeps the first part of the span, keep_doc_ids all that keep a part of it; it may be the document
    itself, whose later copies of a passage go. Rows with a null id are left out, null and empty texts have no paragraphs; rows with equal
    id and text are one document and have their spans once. Lines of fewer than least words are no paragraphs, texts of fewer than BLOCK
    words have no blocks. Ties are settled by (id, hash of the text, place). Other columns are ignored, whatever their names; an empty
    table gives an empty result. A very long text needs memory in proportion to its own length only.
    """
    found = stored(sketches(docs, id_col, text_col, least))
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    whole = paragraph_classes(found.where("k0 is not null"), source).select("i", "th", *_place(), "keep_i", F.array("keep_i").alias("keeps")).distinct()
    gone = whole.unionByName(equal_runs(found.where("k0 is null").drop(*KEYS), source))
    # overlapping or touching parts of a document
    line = Window.partitionBy("i", "th").orderBy("first", "stop")
    opened = gone.withColumn("new", F.coalesce(F.col("first") > F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    numbered = opened.withColumn("span", F.count_if("new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = numbered.groupBy("i", "th", "span").agg(F.min("first").alias("first_word"), (F.max("stop") - 1).alias("last_word"), F.min(F.struct("first", "keep_i"))["keep_i"].alias("keep_doc_id"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("keeps")))).alias("keep_doc_ids"))
    return spans.select(F.col("i").alias("doc_id"), "first_word", "last_word", (F.col("last_word") - F.col("first_word") + 1).alias("n_words"), "keep_doc_id", "keep_doc_ids")


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op2_passage_dedup": op2_passage_dedup}, {}
