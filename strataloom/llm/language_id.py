"""Language identification with a bit-sliced Bloom filter of character n-grams.

Each language's commonest n-grams are put into a Bloom filter of SLOTS bits. The filters are sliced: slot i of the table holds bit i of
all filters, one bit for each language. A look-up ANDs the slots of an n-gram and so gets the set of all languages that contain it.
Set bits are counted by language over a text, and corrected for the share of false positives that each filter's fill implies. The
language with most corrected hits wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix, per_worker, slices, table

#: The model is fitted on about SAMPLE documents of each language (or all, if it has fewer), taken by a hash of the id.
SAMPLE, ORDERS, GRAMS, SLOTS, PROBES = 4000, (3, 4), 4000, 1 << 18, 3
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def grams(texts: list[str | None], orders: tuple[int, ...] = ORDERS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """By order: 64-bit n-grams of lower-cased words, a space before and after each, and the text each belongs to. And the letters of each text."""
    letters = per_worker("letters", _letters)
    lowered = [(x or "").lower() for x in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(lowered)), np.fromiter((len(x) + 1 for x in lowered), np.int64, len(lowered)))[: len(codes)]
    is_letter = letters[codes] if len(codes) else np.zeros(0, bool)
    n_letters = np.bincount(owner[is_letter], minlength=len(lowered))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    codes, owner, is_letter = codes[keep], owner[keep], is_letter[keep]
    codes = np.where(is_letter, codes, 32)
    codes, owner, is_letter = np.concatenate([[32], codes, [32]]).astype(np.uint64), np.concatenate([[0], owner, [0]]), np.concatenate([[False], is_letter, [False]])
    out, owners = [], []
    for n in orders:
        size = max(0, len(codes) - n + 1)
        gram, whole = np.full(size, n, np.uint64), np.ones(size, bool)
        for i in range(n):
            gram = (gram << np.uint64(21)) + codes[i : i + size] if n <= 2 else mix(gram) + codes[i : i + size]
            if 0 < i < n - 1:
                whole &= is_letter[i : i + size]
        out.append(gram[whole])
        owners.append(owner[1 : 1 + size][whole])
    return out, owners, n_letters


class Filter:
    """The sliced table. Languages beyond the 64 bits of a word get further words."""

    def __init__(self, languages: list[str], members: list[np.ndarray], slots: int = SLOTS, probes: int = PROBES):
        self.languages, self.slots, self.probes = languages, slots, probes
        self.table = np.zeros((-(-len(languages) // 64), slots), np.uint64)
        for i, found in enumerate(members):
            for at in self.places(found.astype(np.uint64)):
                self.table[i // 64, at] |= np.uint64(1 << (i % 64))
        fill = [float(((self.table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
        self.false = np.array(fill) ** probes
        if len(languages) <= 8:
            self.table = self.table.astype(np.uint8)

    def places(self, found: np.ndarray) -> list[np.ndarray]:
        h = mix(found, 7)
        return [(h >> np.uint64(20 * i)) & np.uint64(self.slots - 1) for i in range(self.probes)]

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits, by text and language, and the letters of each text."""
        found, owners, n_letters = grams(texts)
        total, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for gram, owner in zip(found, owners):
            places = self.places(gram)
            seen += np.bincount(owner, minlength=len(texts))
            for word, row in enumerate(self.table):
                masks = row[places[0]]
                for at in places[1:]:
                    masks = masks & row[at]
                for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                    bit = (masks >> masks.dtype.type(i % 64)) & masks.dtype.type(1)
                    total[:, i] += np.bincount(owner[bit.astype(bool)], minlength=len(texts))
        return np.maximum(0, (total - seen[:, None] * self.false) / (1 - self.false)), n_letters


def fit(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter:
    """Learns from labelled rows only. Rows with a null text or language are left out. The driver gets GRAMS n-grams of each order and language."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    # the count of each language sets the share of its rows that is taken; languages are few
    shares = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()
    if not shares:
        return Filter([], [])
    share = F.create_map(*[F.lit(x) for r in shares for x in (r["l"], float(min(1, sample / r["n"])))])
    taken = rows.where((F.xxhash64(F.lit("fit"), "i").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < share[F.col("l")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            langs = np.array(part.column("l").to_pylist(), dtype=object)
            found, owners, _ = grams(texts)
            for order, gram, owner in zip(ORDERS, found, owners):
                if len(gram):
                    got = pd.DataFrame({"l": langs[owner], "g": gram.view(np.int64)}).groupby(["l", "g"]).size().reset_index(name="n")
                    yield pa.RecordBatch.from_pandas(got.assign(o=order)[["l", "o", "g", "n"]], preserve_index=False)

    counts = taken.mapInArrow(count, "l string, o long, g long, n long").groupBy("l", "o", "g").agg(F.sum("n").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("l", "o").orderBy(F.desc("n"), "g"))).where(F.col("r") <= GRAMS).select("l", "g").toPandas()
    # languages in order of their number of rows, so that ties go to the commoner one
    languages = [r["l"] for r in sorted(shares, key=lambda r: (-r["n"], r["l"]))]
    return Filter(languages, [best.g[best.l == x].to_numpy(np.int64) for x in languages])


def predict(docs: DataFrame, model: Filter, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, n_letters) of every whole text.

    A text that is null or has no letter is 'und' with score 0; so are all texts of a model without languages. score is the share of
    the winner in all corrected hits; a text without hits gets the commonest language and score 0. Ties go to the commoner language.
    Repeated rows stay, other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            hits, letters = model.hits(texts)
            names = np.array([*model.languages, UNKNOWN], dtype=object)
            if model.languages:
                best, total = hits.argmax(1), hits.sum(1)
                score = np.where(total > 0, hits.max(1) / np.maximum(total, 1e-300), 0.0)
            else:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            best[letters == 0] = len(model.languages)
            score[letters == 0] = 0
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("h"), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.int64())], ["i", "held_out", "lang_pred", "score", "n_letters"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(held_out, F.lit(False)).alias("h"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "i long, held_out boolean, lang_pred string, score double, n_letters long").withColumnRenamed("i", id_col)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return predict(docs, fit(docs.where(~held_out)), held_out)


QUERIES, SQL = {"op1_language_id": op1_language_id}, {}
