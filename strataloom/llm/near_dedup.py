"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the bag of its runs of WORDS words (lower case; the text's words as one run if it has fewer). A shingle weighs its term
frequency times its inverse document frequency. As with the usual hashing trick, document frequencies are counted in FEATURES cells
over all documents; so the table of weights has one size whatever the corpus. What a cell holds of rare shingles by chance is about the
same for all (the median), and is taken off; so only shingles that are common indeed weigh less, however large the corpus.
Each of BANDS * ROWS samples picks a (shingle, level) of a document, so that two documents agree in a sample with the probability of
their weighted Jaccard similarity. ROWS samples form a band. Documents that share a band are verified by their weighted Jaccard
similarity, SIMILARITY or more; linked documents form classes.

Equal texts (128 bits of hash) are one item from the start. Documents without a word are alike only if their texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import WORDS as MARKS
from .cluster import among, dense, placed, shared_buckets, sketched_classes, with_contents
from .common import cut, hash_words, mix, per_worker, slices, table, windows

WORDS, SIMILARITY, BANDS, ROWS, FEATURES = 5, 0.8, 8, 3, 1 << 18
#: A shingle in every document weighs 1 / IDF_RANGE of one in a single document, before the frequency.
IDF_RANGE = 1.5


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each stands in the text."""
    words = (text or "").lower().split()
    return np.unique(windows(hash_words(words), WORDS), return_counts=True)


def _bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and counts of all texts one after another, and where each text begins (with the end)."""
    words = [(x or "").lower().split() for x in texts]
    hashes = hash_words([w for x in words for w in x])
    ends = np.cumsum([len(x) for x in words])
    found = [np.unique(windows(hashes[b - len(x) : b], WORDS), return_counts=True) for x, b in zip(words, ends.tolist())]
    starts = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]).astype(np.int64)
    return np.concatenate([x for x, _ in found] or [np.zeros(0, np.uint64)]), np.concatenate([n for _, n in found] or [np.zeros(0, np.int64)]), starts


def pack(shingle: np.ndarray, count: np.ndarray) -> bytes:
    """A bag as bytes: shingles, counts of one byte each (of four if one needs them), and the bytes of a count."""
    size = 1 if count.max(initial=0) < 256 else 4
    return shingle.tobytes() + count.astype(f"<u{size}").tobytes() + bytes([size])


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = packed[-1]
    n = (len(packed) - 1) // (8 + size)
    return np.frombuffer(packed, np.uint64, n), np.frombuffer(packed, f"<u{size}", n, 8 * n)


def document_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The inverse document frequency of each of FEATURES cells, from all documents; null and empty texts count as documents. The driver gets FEATURES numbers at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES + 1, np.int64), 0
        for _, texts in slices(batches, "t"):
            shingle, _, starts = _bags(texts)
            cell = (shingle >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)
            owner = np.repeat(np.arange(len(texts)), np.diff(starts))
            # a cell counts once for a document
            total[:FEATURES] += np.bincount(np.unique(owner * FEATURES + cell) & (FEATURES - 1), minlength=FEATURES)
            total[FEATURES] += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["cell", "n"])

    counts = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1)
    df[counts.cell] = counts.n
    n = max(1.0, df[FEATURES])
    # from 1 / IDF_RANGE (in every document) to 1 (in one), in the logarithm of the frequency
    common = np.log(np.maximum(df[:FEATURES] - np.median(df[:FEATURES]), 1.0)) / np.log(max(n, 2.0))
    return (1 - np.minimum(common, 1.0) * (1 - 1 / IDF_RANGE)).astype(np.float32)


#: The weight from which on a shingle goes to the second half of a sketch's words.
HEAVY = 0.85


def marks(shingle: np.ndarray, count: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A sketch (see cluster) of MARKS words for each text, a stretch between starts. weight: of a shingle that stands once; what stands k times is k elements."""
    owner = np.repeat(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), count)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    h = mix(np.repeat(mix(shingle, 71), count) ^ level.astype(np.uint64), 72)
    word = (h >> np.uint64(6)).astype(np.int64) % (MARKS // 2) + MARKS // 2 * (np.repeat(weight, count) >= HEAVY)
    out = np.zeros((len(starts) - 1) * MARKS, np.uint64)
    np.bitwise_xor.at(out, owner * MARKS + word, np.uint64(1) << (h & np.uint64(63)))
    return out.reshape(-1, MARKS)


def grades(weights: np.ndarray) -> list[float]:
    """What an element of each word of marks weighs at least."""
    return [x for x in (float(weights.min()), HEAVY) for _ in range(MARKS // 2)]


def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 2**16 places, and their logarithms."""
    x = np.concatenate([[0], np.geomspace(1e-6, 60, 400_000)])
    cdf = 1 - np.exp(-x) * (1 + x)
    q = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), cdf, x)
    return q.astype(np.float32), np.log(q).astype(np.float32)


def samples(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """For each text (a stretch between starts, none empty) n samples: hashes of (shingle, level), as Ioffe's improved scheme picks them."""
    gamma, log_gamma = per_worker("gamma", _gamma_tables)
    log_weight = np.log(weight).astype(np.float32)
    lengths = np.diff(starts)
    out = np.empty((n, len(lengths)), np.uint64)
    for k in range(n):
        h = mix(shingle, k + 1)
        r = gamma[(h & np.uint64(0xFFFF)).astype(np.int64)]
        log_c = log_gamma[((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        beta = ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(65536)
        level = np.floor(log_weight / r + beta)
        log_a = log_c - r * (level - beta + 1)
        least = np.minimum.reduceat(log_a, starts[:-1])
        # the first place in each stretch that holds the least value
        at = np.flatnonzero(log_a == np.repeat(least, lengths))
        at = at[np.searchsorted(at, starts[:-1])]
        out[k] = mix(shingle[at] + level[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), k)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights); 0 if either is empty."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][x], b[1][y]).sum(dtype=np.float64)
    whole = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least
    return float(least / whole) if whole > 0 else 0.0


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple:
    """What cluster.link_classes asks of a contrast, for two (sorted shingles, weights): linked, w, whole, tokens, weights."""
    shingle = np.union1d(a[0], b[0])
    more = np.zeros(len(shingle))
    more[np.searchsorted(shingle, b[0])] += b[1]
    more[np.searchsorted(shingle, a[0])] -= a[1]
    token = mix(shingle, 1)
    token[more > 0] = mix(shingle[more > 0], 2)
    there = more != 0
    less, added = -more[more < 0].sum(), more[more > 0].sum()
    return similarity(a, b) >= threshold, float(less + threshold * added), float(a[1].sum(dtype=np.float64)), token[there].view(np.int64), np.abs(more[there])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """(i, h1, h2, root, class_id, class_size): the class of each row of docs; root names it, class_id is the least id of the class, class_size its rows.

    A null text counts as empty. Empty texts are equal to each other, so they form one class. Rows with a null id take part; class_id is
    the least id that is not null, null if there is none. Repeated rows are rows of one class. Other columns are ignored, whatever their
    names; an empty table gives an empty result. A very long text needs memory in proportion to its own length only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit("second")).alias("h2"), text.alias("t"))
    weights = document_weights(rows, "t")

    def weigh(shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        return count.astype(np.float32) * weights[(shingle >> np.uint64(20)).astype(np.int64) & (FEATURES - 1)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            shingle, count, starts = _bags(texts)
            full = np.flatnonzero(np.diff(starts))
            keys: list = [[]] * len(texts)
            if len(full):
                got = samples(shingle, weigh(shingle, count), np.append(starts[full], starts[-1]))
                bands = np.stack([windows_of(got[b * ROWS : (b + 1) * ROWS], b) for b in range(BANDS)], 1).view(np.int64)
                for at, row in zip(full.tolist(), bands):
                    keys[at] = row
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("i", "h1", "h2")), pa.array(keys, pa.list_(pa.int64()))], ["i", "h1", "h2", "keys"])

    def windows_of(rows_: np.ndarray, band: int) -> np.ndarray:
        out = np.full(rows_.shape[1], band, np.uint64)
        for row in rows_:
            out = mix(out ^ row)
        return out

    known = cut(rows.mapInArrow(sketch, "i long, h1 long, h2 long, keys array<bigint>"))
    items = known.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("lo"), F.min(F.struct("i", "keys")).alias("first"))
    items = cut(items.select("h1", "h2", "n", "lo", F.col("first.i").alias("i"), F.col("first.keys").alias("keys")).withColumn("id", F.monotonically_increasing_id()))
    buckets = dense(shared_buckets(items.select("id", F.explode("keys").alias("key")).distinct()))
    wanted = dense(items.join(buckets.select("id").distinct(), "id").select("h1", "h2", F.col("i").alias("first"), "id"))
    # one of the equal texts, by the least id
    found = among(rows, "h1", wanted, "h1").join(wanted, ["h1", "h2"]).where(F.col("i").eqNullSafe(F.col("first"))).select("id", "t")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            shingle, count, starts = _bags(texts)
            packed = [pack(shingle[a:b], count[a:b]) for a, b in zip(starts, starts[1:])]
            size = np.add.reduceat(weigh(shingle, count).astype(np.float64), starts[:-1])
            words = marks(shingle, count, weigh(shingle, np.ones_like(count)), starts).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(packed, pa.binary()), pa.array(size), *map(pa.array, words.T.copy())], ["id", "bag", "n", *names])

    names = [f"w{j}" for j in range(MARKS)]
    bags = placed(found.dropDuplicates(["id"]).mapInArrow(contents, "id long, bag binary, n double, " + ", ".join(f"{x} long" for x in names)))

    def unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        shingle, count = unpack(packed)
        return shingle, weigh(shingle, count)

    def sides(part: pa.RecordBatch) -> Iterator[tuple]:
        for x, y in zip(part.column("x"), part.column("y")):
            yield unpacked(x.as_buffer()), unpacked(y.as_buffer())

    def parts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
        return (batch.slice(at, n) for batch in batches for at in range(0, batch.num_rows, n))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1024):
            yield part.select(["a", "b"]).filter(pa.array([similarity(x, y) >= threshold for x, y in sides(part)], pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        return with_contents(pairs, bags, "bag").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long")

    roots = sketched_classes(buckets, verify, lambda rows: rows.join(bags.select("id", "n", *names), "id"), threshold, grades(weights))
    member = items.select("h1", "h2", "id", "n", "lo").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    whole = member.groupBy("root").agg(F.min("lo").alias("class_id"), F.sum("n").alias("class_size"))
    named = member.join(whole, "root").select("h1", "h2", "root", "class_id", "class_size")
    return known.select("i", "h1", "h2").join(named, ["h1", "h2"])


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents: its class, named by the least doc_id in it, and the rows of the class."""
    return classes(table(spark, sf_dir, "documents")).select(F.col("i").alias("doc_id"), "class_id", "class_size", F.col("i").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class: the one with the least id (null first; then by the hash of the text), all columns as they are, whatever their names; of rows with equal id and text one stays. An empty table stays empty."""
    named = classes(docs)
    # classes of null or repeated ids may share class_id, but not root
    first = named.groupBy("root").agg(F.min(F.struct("i", "h1", "h2")).alias("f")).select(F.col("f.i").alias("_i"), F.col("f.h1").alias("_h1"), F.col("f.h2").alias("_h2"))
    text = F.coalesce(docs["text"], F.lit(""))
    met = docs["doc_id"].eqNullSafe(first["_i"]) & (F.xxhash64(text) == first["_h1"]) & (F.xxhash64(text, F.lit("second")) == first["_h2"])
    packed = docs.join(first, met).select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), first["_i"], first["_h1"], first["_h2"])
    return packed.dropDuplicates(["_i", "_h1", "_h2"]).select("row.*")


QUERIES, SQL = {"op4_near_dedup": op4_near_dedup}, {}
