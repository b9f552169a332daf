"""An interpolated modified Kneser-Ney model of n-grams, counted in Spark, stored as sorted hash arrays and memory-mapped by the workers.

Tokens are words and one end mark a text; ORDER - 1 begin marks stand before a text as context. The counts of the highest order are
n-grams; a lower order counts how many different words stand before its n-gram. With c the count of a word after a context, t the sum over
the context, and N1, N2, N3 how many words follow it once, twice, more often,

    p(word | context) = max(c - D(c), 0) / t + (D1 N1 + D2 N2 + D3 N3) / t * p(word | context without its first word)

down to the uniform distribution over the vocabulary and one unknown word; a context that was never seen leaves it to the shorter one. The
three discounts of an order come from how many of its n-grams have counts of 1, 2, 3 and 4.

Every order is one pass: n-grams are dealt by their hash to shards, summed, and each shard is written as sorted arrays; the same rows,
split to the word behind and the context, are summed to the next lower order. Scoring maps the arrays, looks up the distinct n-grams of a
slice of texts in sorted order, and needs no memory for the model but the pages that it touches. The arrays stand in a folder that all
workers see as a file system (spark.checkpoint.dir, if it is one); a shard is written under another name and then renamed, so a
task that runs twice leaves it whole.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _folder, per_worker, sha_safe, slices, stored, table

ORDER, FOLDS, HELD_OUT, HELD, BITS = 2, 5, 1, 3_000_000, 42
STATS = ["t", "n1", "n2", "n3", "n4", "types"]
#: HELD: tokens that a task counts before it hands n-grams on.
#: xxhash64 is a published hash; these are its primes, and Spark's seed.
_P1, _P2, _P3, _P4, _P5, _SEED = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 42))


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def key_of(words: list[np.ndarray]) -> np.ndarray:
    """The hash that F.xxhash64 gives for columns of 64-bit numbers."""
    out = _SEED
    with np.errstate(over="ignore"):
        for w in words:
            h = out + _P5 + np.uint64(8)
            h = _rotate(h ^ (_rotate(w * _P2, 31) * _P1), 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out = h ^ (h >> np.uint64(32))
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of BITS bits, so that an n-gram is short where it travels; of a thousand million words one in 4,000 shares its hash with another."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) >> np.uint64(64 - BITS) if words else np.zeros(0, np.uint64)


#: No word holds white space, so these stand for no word.
END, BEGIN = word_hashes([b" ", b"\n"])


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return sha_safe(text).lower().split() if text else []


def sequences(texts: list[str | None], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashes of each token of all texts and of the order - 1 tokens before it (the token's last), and the tokens of each text."""
    number: dict[bytes, int] = {b"\n": 0, b" ": 1}
    ids, lengths = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = words_of(text)
        lengths[k] = len(words) + 1
        ids += [0] * (order - 1)
        ids += [number.setdefault(w, len(number)) for w in words]
        ids.append(1)
    hashes = word_hashes(list(number))[np.array(ids, np.int64)]
    # places of the tokens, without begin marks
    real = np.arange(len(hashes)) if order == 1 else np.flatnonzero(np.array(ids) != 0)
    return [hashes[real - d] for d in range(order - 1, -1, -1)], lengths


def names(order: int) -> list[str]:
    return [f"w{k}" for k in range(1, order + 1)]


class Packing:
    """The words of an n-gram as one row of bits, in columns p1, p2, … of 63 bits, the last one with what is left; its count stands above those bits where 42 are free there, else in a column of its own."""

    def __init__(self, order: int):
        total = BITS * order
        self.order, self.last = order, (total - 1) % 63 + 1
        self.shared = self.last <= 63 - 42
        self.columns = [f"p{k + 1}" for k in range(-(-total // 63))]
        # (column, its bits to the right, width, bits of the word to the right) of the parts of each word
        self.parts: list[list[tuple[int, int, int, int]]] = []
        for k in range(order):
            at, end, parts = BITS * k, BITS * (k + 1), []
            while at < end:
                column = at // 63
                close = min(63 * (column + 1), total)
                width = min(end, close) - at
                at += width
                parts.append((column, close - at, width, end - at))
            self.parts.append(parts)

    @property
    def names(self) -> list[str]:
        return self.columns + ["c"] * (not self.shared)

    def pack(self, words: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(n), np.uint64) for _ in self.columns]
        for w, parts in zip(words, self.parts):
            for column, right, width, left in parts:
                out[column] |= ((w >> np.uint64(left)) & np.uint64(2**width - 1)) << np.uint64(right)
        if not self.shared:
            return [*out, n.astype(np.uint64)]
        out[-1] |= n.astype(np.uint64) << np.uint64(self.last)
        return out

    def unpack(self, found: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        words = []
        for parts in self.parts:
            w = np.zeros(len(found[0]), np.uint64)
            for column, right, width, left in parts:
                w |= ((found[column] >> np.uint64(right)) & np.uint64(2**width - 1)) << np.uint64(left)
            words.append(w)
        return words, found[-1] >> np.uint64(self.last) if self.shared else found[-1]

    def words(self) -> list[Column]:
        """The words as columns."""
        piece = lambda column, right, width, left: F.shiftleft(F.shiftrightunsigned(self.columns[column], right).bitwiseAND(F.lit(2**width - 1)), left)
        return [reduce(Column.bitwiseOR, (piece(*x) for x in parts)) for parts in self.parts]


def grams(texts: DataFrame, order: int) -> DataFrame:
    """The columns of Packing(order) from (t): n-grams, counted over HELD tokens at a time and in the order of their words, in which shuffle files compress better."""
    packing = Packing(order)

    def counted(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        words = [np.concatenate(x) for x in zip(*parts)]
        _, first, n = np.unique(key_of(words), return_index=True, return_counts=True)
        found = packing.pack([w[first] for w in words], n)
        order_of = np.lexsort(found[::-1])
        return pa.RecordBatch.from_arrays([pa.array(x[order_of].view(np.int64)) for x in found], packing.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, part in slices(batches, "t"):
            parts.append(sequences(part, order)[0])
            held += len(parts[-1][0])
            if held > HELD:
                yield counted(parts)
                parts, held = [], 0
        if parts:
            yield counted(parts)

    return texts.mapInArrow(run, ", ".join(f"{x} long" for x in packing.names))


def shard_of(key: Column, shards: int) -> Column:
    """Shards are equal ranges of the unsigned hash."""
    return F.shiftright(F.shiftrightunsigned(key, 33) * F.lit(shards).cast("long"), 31).cast("int")


def _columns(order: int, highest: int) -> list[tuple[str, type]]:
    """What a shard holds for each n-gram: counts, and for one that is a context as well the sum and the weight of what it leaves to the shorter context; for words their plain count too."""
    return [("c", np.float32)] + [("t", np.float64), ("left", np.float64)] * (order < highest) + [("raw", np.float64)] * (order == 1)


def _write(rows: DataFrame, folder: str, order: int, highest: int) -> DataFrame:
    """Writes each shard of rows (shard, w1, …, wn, c, raw, t, left; of the highest order shard and its packed n-grams) to folder and gives what it adds to the next lower order: (w1, …, wn-1, c, raw, t, n1, n2, n3, n4, types).

    An n-gram adds one to the count of what stands behind its first word, and its own count to what follows its context. All rows of a
    shard have to be in one partition, which is held while it is sorted.
    """
    columns, packing = _columns(order, highest), Packing(order)
    sums = ["c", "raw", *STATS]

    def put(shard: int, key: np.ndarray, values: dict[str, np.ndarray]) -> None:
        name = f"{folder}/{order}-{shard}"
        own = f"{name}.{uuid.uuid4().hex}"
        with open(own, "wb") as file:
            for column, kind in [(key, np.uint64), *((values[c], t) for c, t in columns)]:
                file.write(np.ascontiguousarray(column, kind).tobytes())
        os.replace(own, name)

    def lower(words: list[np.ndarray], c: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        n = len(c)
        behind, before = words[1:], words[:-1]
        if order > 1:
            _, first, place = np.unique(np.concatenate([key_of(behind), key_of(before)]), return_index=True, return_inverse=True)
        else:
            first, place = np.arange(min(n, 1)), np.zeros(2 * n, np.int64)
        total = lambda x, y: np.bincount(place, np.concatenate([x, y]), len(first)).astype(np.int64)
        none = np.zeros(n)
        found = [total(c > 0, none), total(raw, none), total(none, c), *(total(none, c == k) for k in range(1, 5)), total(none, c > 0)]
        both = [np.concatenate([x, y])[first].view(np.int64) for x, y in zip(behind, before)]
        return pa.RecordBatch.from_arrays([*map(pa.array, both), *map(pa.array, found)], [*names(order - 1), *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        os.makedirs(folder, exist_ok=True)
        got = pa.Table.from_batches(parts)
        del parts
        shards = got.column("shard").to_numpy()
        for shard in np.unique(shards).tolist():
            part = got.filter(pa.array(shards == shard))
            values = {c: part.column(c).to_numpy() for c in part.column_names if c != "shard"}
            if order == highest:
                words, n = packing.unpack([values[x].view(np.uint64) for x in packing.names])
                values = {"c": n, "raw": n}
            else:
                words = [values[w].view(np.uint64) for w in names(order)]
            # what several tasks have counted meets here
            key, first, place = np.unique(key_of(words), return_index=True, return_inverse=True)
            values = {c: np.bincount(place, x, len(key)) if c in ("c", "raw") else x[first] for c, x in values.items() if c not in names(order)}
            put(shard, key, values)
            yield lower([w[first] for w in words], values["c"], values["raw"])

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in [*names(order - 1), *sums]))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that hold for the whole corpus."""

    folder: str
    order: int
    shards: int
    discounts: tuple[tuple[float, float, float], ...]
    total: float
    left: float
    tokens: int
    vocabulary: int

    def array(self, order: int, shard: int) -> dict[str, np.ndarray]:
        """The arrays of a shard, mapped; a shard that no n-gram fell to has no file."""
        path, columns = f"{self.folder}/{order}-{shard}", [("key", np.uint64), *_columns(order, self.order)]
        n = os.path.getsize(path) // sum(np.dtype(t).itemsize for _, t in columns) if os.path.exists(path) else 0
        out, at = {}, 0
        for name, kind in columns:
            out[name] = np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind)
            at += n * np.dtype(kind).itemsize
        return out

    def look_up(self, order: int, words: list[np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The stored values of n-grams, 0 for those that are not there, and the place of each n-gram among the values."""
        asked, place = np.unique(key_of(words), return_inverse=True)
        found = {name: np.zeros(len(asked)) for name, _ in _columns(order, self.order)}
        shard = ((asked >> np.uint64(33)) * np.uint64(self.shards)) >> np.uint64(31)
        edges = np.flatnonzero(np.diff(shard)) + 1
        for part in np.split(np.arange(len(asked)), edges) if len(asked) else []:
            name = (order, int(shard[part[0]]))
            arrays = per_worker(f"ngrams {self.folder} {name}", lambda: self.array(*name))
            keys = arrays["key"]
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, asked[part]), len(keys) - 1)
            there = keys[at] == asked[part]
            for c, values in found.items():
                values[part[there]] = arrays[c][at[there]]
        return found, place

    def discount(self, order: int, c: np.ndarray) -> np.ndarray:
        return np.array((0.0, *self.discounts[order - 1]))[np.minimum(c, 3).astype(np.int64)]

    def score(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, log10 probability by smoothed counts of single words, log10 probability by the model) of each text."""
        words, lengths = sequences(texts, self.order)
        p, known = np.full(len(words[-1]), 1 / (self.vocabulary + 1)), None
        for k in range(1, self.order + 1):
            if k == 1:
                found, place = self.look_up(1, words[-1:])
                raw = found["raw"][place]
                t, left = np.float64(self.total), np.float64(self.left)
            else:
                context, at = self.look_up(k - 1, words[-k:-1])
                t, left = context["t"][at], context["left"][at]
                found, place = self.look_up(k, words[-k:])
            c = found["c"][place]
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(t > 0, (c - self.discount(k, c)) / t + left * p, p)
        base = np.log10((raw + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))
        starts = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x, starts) if len(texts) else [] for x in (raw > 0, base, np.log10(p))]
        return [(int(n), int(k), float(b), float(s)) for n, k, b, s in zip(lengths, *sums)]


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from the numbers of n-grams with counts 1 to 4; half a count, 1 and 1.5 where those do not give discounts between 0 and the count."""
    if not min(n1, n2, n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return found if all(0 < d < k for k, d in enumerate(found, 1)) else (0.5, 1.0, 1.5)


def fit(texts: DataFrame, order: int = ORDER, shards: int | None = None, folder: str | None = None) -> Model:
    """A model of the texts (t), null ones as empty. An empty table gives a model that knows no word.

    shards is the number of shuffle partitions by default, so that a shard is as large as one. folder has to be a path of a file system
    that driver and workers share.
    """
    spark = texts.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or _folder(spark)
    if "://" in folder or folder.startswith("file:"):
        if not folder.startswith("file:"):
            raise ValueError(f"workers cannot map files of {folder}; name a folder of a shared file system")
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    folder = f"{folder}/strataloom-ngrams-{uuid.uuid4().hex}"
    packing = Packing(order)
    rows, steps = grams(texts, order), []
    for k in range(order, 0, -1):
        if k == order:
            words, columns = packing.words(), packing.names
        else:
            # the order above has as many n-grams with a count of 1 as its contexts have in all
            steps.append(discounts(*rows.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in STATS[1:5]]).first()))
            d1, d2, d3 = steps[-1]
            rest = d1 * F.col("n1") + d2 * F.col("n2") + d3 * (F.col("types") - F.col("n1") - F.col("n2"))
            words, columns = names(k), [*names(k), "c", "raw", "t", F.when(F.col("t") > 0, rest / F.col("t")).otherwise(0.0).alias("left")]
        # a shard's rows meet where it is written
        dealt = rows.select(shard_of(F.xxhash64(*words), shards).alias("shard"), *columns).repartitionById(shards, F.col("shard"))
        # what the shards add to words that they share; the shuffle of n-grams goes once it is written
        added = stored(_write(dealt, folder, k, order), compression="zstd")
        del dealt
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        sums = [F.sum(x).alias(x) for x in ["c", "raw", *STATS]]
        rows = stored(added.groupBy(*names(k - 1)).agg(*sums)) if k > 1 else added.agg(*sums)
    top = rows.first()
    steps.append(discounts(*(top[x] or 0 for x in STATS[1:5])))
    d1, d2, d3 = steps[-1]
    rest = d1 * (top.n1 or 0) + d2 * (top.n2 or 0) + d3 * ((top.types or 0) - (top.n1 or 0) - (top.n2 or 0))
    return Model(folder, order, shards, tuple(reversed(steps)), float(top.t or 0), rest / top.t if top.t else 0.0, int(top.raw or 0), int(top.types or 0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    A null text is an empty one: its end is its only token. Rows are independent: repeated rows and null ids stay, other columns are
    ignored, an empty table gives an empty result. A long text needs memory in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            n, known, base, own = zip(*model.score(texts))
            yield pa.RecordBatch.from_arrays([part.column("i"), *(pa.array(x, pa.int64()) for x in (n, known, [model.tokens] * len(n))), *(pa.array(x, pa.float64()) for x in (base, own))], ["i", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "i long, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("i", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is not learned from, by the checksum of its id; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select(F.col("text").alias("t")))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), *out.columns[1:])


QUERIES, SQL = {"op11_language_model": op11_language_model}, {}
