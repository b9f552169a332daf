"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders; what remains are lower-case words without punctuation. Windows of WINDOW canonical
tokens of the benchmark are hash-joined with those of the documents. The values behind the placeholders are slots: a document leaks an
item if some occurrence in it holds at least COVERAGE of the item's windows and each value of a slot of the item always meets the same
value there. Hits whose place in the document less that in the item is the same are an occurrence, so are those where it differs by less
than one of WIDTHS (words put in or left out), and so is the whole document; further copies with other values do not hide one that is
consistent. So a question whose numbers or names were replaced is found, and a text that only shares the frame by chance, with slots that
contradict each other, is not.

Before the join, windows of documents are tested against a bitmap of BITS bits that holds the benchmark's windows; its size does not
depend on the tables. It only drops windows that cannot join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hash_words, per_worker, slices, table, windows

WINDOW, COVERAGE, BITS, CACHED = 8, 0.3, 1 << 24, 400_000
WIDTHS = (16, 128)
NUMBER, NAME, UNIT, NONE = (np.uint64(x) for x in (1, 2, 3, 0))
UNITS = frozenset(
    "% ° mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons lb lbs oz ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents pound pounds usd eur gbp percent degrees mph kmh w kw v a hz gb mb kb".split()
)
_NUMBER = re.compile(r"[+\-]?[$€£¥]?\d[\d.,:/]*(?:[^\W\d_]{1,3}|%)?")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Canon:
    """Canonical tokens; keeps what it knows about raw words (at most CACHED of them)."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.index, self.n = {}, 0
        self.info = np.zeros((CACHED * 2, 2), np.uint64)

    def learn(self, words: list[str]) -> None:
        if self.n + len(words) > len(self.info):
            self.info = np.concatenate([self.info, np.zeros((self.n + len(words), 2), np.uint64)])
        bare = [_EDGE.sub("", w) for w in words]
        lower = [w.lower() for w in bare]
        at = slice(self.n, self.n + len(words))
        self.info[at, 0] = np.maximum(hash_words(lower), np.uint64(16))
        # bits: 1 capital, 2 ends a sentence, 4 number, 8 unit, 16 nothing but punctuation
        self.info[at, 1] = [
            (bool(b) and b[0].isupper()) + 2 * (w.rstrip("\"')]»”’")[-1:] in (".", "!", "?", ":")) + 4 * bool(_NUMBER.fullmatch(w.strip(".,;:!?()[]\"'"))) + 8 * (x in UNITS or w in UNITS) + 16 * (not b and w not in UNITS)
            for w, b, x in zip(words, bare, lower)
        ]
        self.index.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Canonical tokens, the place of each among the words of the text, and the words. Neighbouring names are one."""
        words = text.split()
        if self.n > CACHED:
            self.clear()
        if new := [w for w in set(words) if w not in self.index]:
            self.learn(new)
        known = self.info[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]
        token, bits = known[:, 0].copy(), known[:, 1]
        first = np.ones(len(words), bool)
        first[1:] = (bits[:-1] & np.uint64(2)) != 0
        number = (bits & np.uint64(4)) != 0
        name = ((bits & np.uint64(1)) != 0) & ~first & ~number
        unit = (bits & np.uint64(8)) != 0
        unit[:1] = False
        unit[1:] &= number[:-1]
        token[name], token[number], token[unit] = NAME, NUMBER, UNIT
        keep = ((bits & np.uint64(16)) == 0) | number | unit
        keep[1:] &= ~(name[1:] & name[:-1])
        return token[keep], np.flatnonzero(keep), words


def _slots(token: np.ndarray, place: np.ndarray, words: list[str], start: int, size: int) -> list[str]:
    """The values behind the placeholders of a window; a name takes all its words."""
    out = []
    for i in range(start, start + size):
        if token[i] <= UNIT:
            end = place[i] + 1
            if token[i] == NAME:
                stop = place[i + 1] if i + 1 < len(place) else len(words)
                while end < stop and words[end][:1].isupper():
                    end += 1
            out.append(f"{int(token[i])} " + _EDGE.sub("", " ".join(words[place[i] : end])).lower())
    return out


def benchmark_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, item_id, at, n, size, slots): the windows of each item; an item with fewer tokens is one window of its own size, one without tokens has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = per_worker("canon", Canon)
        for part, texts in slices(batches, "t"):
            rows = []
            for item, text in zip(part.column("i").to_pylist(), texts):
                token, place, words = canon.tokens(text or "")
                found = windows(token, window).view(np.int64).tolist()
                size = min(window, len(token))
                rows += [(h, item, at, len(found), size, _slots(token, place, words, at, size)) for at, h in enumerate(found)]
            a, b, c, d, e, f = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array(x, pa.int32()) for x in (c, d, e)), pa.array(f, pa.list_(pa.string()))], ["h", "item_id", "at", "n", "size", "slots"])

    return items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "h long, item_id long, at int, n int, size int, slots array<string>")


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, item_id, coverage, n_slots, n_changed): the items that each document leaks, by its best occurrence; documents without a leak have no row.

    text_hash is xxhash64 of the text: with the id it names rows with equal text, which share their rows here. Null and empty texts leak
    nothing; an empty table on either side gives an empty result. Other columns are ignored.
    """
    bench = cut(benchmark_windows(items, window))
    low = F.col("h").bitwiseAND(F.lit(BITS - 1))
    high = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(BITS - 1))
    bits = bench.select(F.explode(F.array(low, high)).alias("b")).select(F.expr("b div 64").alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m"))
    bitmap = np.zeros(BITS // 64, np.int64)
    # at most BITS / 64 rows
    for row in bits.groupBy("w").agg(F.bit_or("m").alias("m")).toLocalIterator():
        bitmap[row["w"]] = row["m"]
    bitmap = bitmap.view(np.uint8)
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most `window` rows

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = per_worker("canon", Canon)

        def there(h: np.ndarray, shift: int) -> np.ndarray:
            at = (h >> np.uint64(shift)) & np.uint64(BITS - 1)
            return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

        for part, texts in slices(batches, "t"):
            rows = []
            for i, th, text in zip(part.column("i").to_pylist(), part.column("th").to_pylist(), texts):
                if not text:
                    continue
                token, place, words = canon.tokens(text)
                for size in sizes:
                    if len(token) < size:
                        continue
                    found = windows(token, size)
                    for at in np.flatnonzero(there(found, 0) & there(found, 32)).tolist():
                        rows.append((int(found[at : at + 1].view(np.int64)[0]), i, th, at, _slots(token, place, words, at, size)))
            a, b, c, d, e = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (a, b, c, d)), pa.array(e, pa.list_(pa.string()))], ["h", "i", "th", "place", "values"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    found = source.mapInArrow(probe, "h long, i long, th long, place long, values array<string>")
    pairs = found.join(bench, "h").where(F.size("values") == F.size("slots"))
    # each hit counts for all the occurrences that it may belong to; of two shifted rows of stretches one holds any two near hits
    shift = F.col("place") - F.col("at")
    near = [F.floor((shift + half) / width) for width in WIDTHS for half in (0, width // 2)]
    pairs = pairs.withColumn("part", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), x.cast("long").alias("key")) for kind, x in enumerate([F.lit(0), shift, *near])])))
    pairs = pairs.groupBy("i", "th", "item_id", "part", "at", "n").agg(F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("slots", "values")))).alias("met"))
    whole = pairs.groupBy("i", "th", "item_id", "part").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    whole = whole.withColumn("n_slots", F.size(F.array_distinct(F.transform("met", lambda x: x["slots"]))))
    whole = whole.withColumn("n_changed", F.size(F.filter("met", lambda x: x["slots"] != x["values"])))
    kept = whole.where((F.col("hits") >= coverage * F.col("n")) & (F.size("met") == F.col("n_slots")))
    # the occurrence with the most windows, then with the fewest changed values
    best = kept.groupBy("i", "th", "item_id").agg(F.max(F.struct((F.col("hits") / F.col("n")).alias("coverage"), (-F.col("n_changed")).alias("same"), "n_slots")).alias("x"))
    return best.select(F.col("i").alias(id_col), F.col("th").alias("text_hash"), "item_id", "x.coverage", "x.n_slots", (-F.col("x.same")).alias("n_changed"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that leak an item. A null id or text never leaks; all columns stay, whatever their names."""
    found = leaks(docs, items).select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).distinct()
    return docs.join(found, (docs["doc_id"] == found["_i"]) & (F.xxhash64(docs["text"]) == found["_h"]), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


QUERIES, SQL = {"op9_decontaminate": op9_decontaminate}, {}
