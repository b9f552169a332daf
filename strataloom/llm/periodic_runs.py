"""Periodic runs of words by harmonic grid probing.

A run of period p and at least 3p words holds two neighbouring multiples of p at which the word equals the one p further on. So each period
p up to a third of the text probes its grid 0, p, 2p, … only: n/1 + n/2 + n/3 + … comparisons, n log n for n words. Where grid places jp
and (j+1)p both pass, the stretch around them is compared in chunks of growing size, to the left and to the right, until words differ.

Grid places that lie with their neighbour inside a run found already are skipped if the run's period divides p: what starts there is that
run, read with a multiple of its period. No other run is lost by it: by the theorem of Fine and Wilf, a run of smallest period p shares
fewer than p words with a run of a period that divides p. Periods are tried from small to large, so a run is found by its smallest one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha_safe, slices, table

LEAST, REPEATS, CHUNK, AHEAD, BLOCK = 24, 3, 32, 12, 1_000_000


def _agreed(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements of two views agree from their start, by chunks that double."""
    n, at, size = min(len(x), len(y)), 0, CHUNK
    x, y = x[:n], y[:n]
    while at < n:
        unlike = np.flatnonzero(x[at : at + size] != y[at : at + size])
        if len(unlike):
            return at + int(unlike[0])
        at, size = at + size, size * 2
    return n


def _survivors(ids: np.ndarray, at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which grid places at of periods p pass together with the next one, and so do the first words behind them."""
    kept = np.flatnonzero(ids[at] == ids[at + p])
    for step in range(AHEAD + 1):
        # a stretch with two grid places agrees at every place from the first to the second
        period = p[kept]
        place = at[kept] + (np.minimum(step, period) if step else period)
        kept = kept[ids[place] == ids[place + period]]
        if not len(kept):
            break
    return kept


def runs(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least least elements and repeats (3 or more) smallest periods, by start and period."""
    n, found = len(ids), []
    most = n // repeats
    if n < least or not most:
        return []
    # for each period still to come the runs whose period divides it and that hold two of its grid places
    within: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def extend(places: np.ndarray, p: int) -> None:
        for start, stop in within.pop(p, ()):
            places = places[(places < start) | (places + p >= stop)]
        stop = -1
        for at in places.tolist():
            if at < stop:
                continue
            stop = at + _agreed(ids[at:], ids[at + p :])
            start = at - _agreed(ids[:at][::-1], ids[: at + p][::-1])
            length = stop - start + p
            if length >= max(least, repeats * p):
                found.append((start, length, p))
                for q in range(2 * p, length // 2 + 1, p):
                    within[q].append((start, start + length))

    # periods whose grids have BLOCK places or so in all are probed at once
    sizes = np.maximum((n - 1) // np.arange(1, most + 1) - 1, 0)
    ends = np.cumsum(sizes)
    first = 0
    while first < most:
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, "right")))
        p = np.repeat(np.arange(first + 1, stop + 1), sizes[first:stop])
        at = (np.arange(len(p)) - np.repeat(ends[first:stop] - sizes[first:stop], sizes[first:stop]) + (ends[first - 1] if first else 0)) * p
        kept = _survivors(ids, at, p)
        at, p = at[kept], p[kept]
        edges = np.flatnonzero(np.diff(p)) + 1
        for places, period in zip(np.split(at, edges), p[np.append(0, edges)].tolist() if len(p) else []):
            extend(places, period)
        first = stop
    return sorted(found, key=lambda x: (x[0], x[2]))


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than the six white space characters of ASCII."""
    return sha_safe(text).split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words lie in a run behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, p in found:
        edges[start + p] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


def planted(h: int | None, n: int) -> np.ndarray:
    """Which original word stands at each place, once the repetition that a document's checksum asks for has been planted."""
    order = np.arange(n)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[a:] = a + np.arange(n - a) % p
    return order


COLUMNS = "i long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _report(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    digest = hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in found).encode()).hexdigest()
    kept = words if not found else [words[k] for k in np.flatnonzero(~dropped(len(words), found)).tolist()]
    return len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], digest, hashlib.sha256(b" ".join(kept)).hexdigest()


def periodic_runs(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every whole text: the number of its runs, the one of greatest exponent, digests of all runs and of the text without repetitions.

    Words are what ASCII white space separates. With plant, the document's checksum may first repeat a part of its words (planted). A null
    or empty text has no words, no run, and the digests of nothing; ties between runs go to the smallest start, then period. Rows are
    independent: repeated rows stay, a row with a null id keeps it (nothing is planted there), other columns are ignored, an empty table
    gives an empty result. A long text needs memory in proportion to its length and time of n log n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        for part, texts in slices(batches, "t"):
            rows = []
            for text, h in zip(texts, part.column("h").to_pylist()):
                words = words_of(text)
                if plant and h is not None and h % 10 == 0:
                    words = [words[k] for k in planted(h, len(words)).tolist()]
                rows.append(_report(words, runs(numbered(words))))
            yield pa.RecordBatch.from_arrays([part.column("i"), *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], [x.split()[0] for x in COLUMNS.split(", ")])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("h"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, COLUMNS).withColumnRenamed("i", id_col)


def run_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, period): a row for every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            found = [runs(numbered(words_of(text))) for text in texts]
            ids = pa.compute.take(part.column("i"), pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for rows in found for x in rows], pa.int64()) for k in range(3))], ["i", "start", "length", "period"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "i long, start long, length long, period long").withColumnRenamed("i", id_col)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every whole text without the repetitions of its runs, its words joined by one space; an empty text where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "t"):
            out = []
            for text in texts:
                words = words_of(text)
                gone = dropped(len(words), runs(numbered(words)))
                out.append(b" ".join(w for w, x in zip(words, gone.tolist()) if not x).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(out, pa.string())], ["i", text_col])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, f"i long, {text_col} string").withColumnRenamed("i", id_col)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)


QUERIES, SQL = {"op13_periodic_runs": op13_periodic_runs}, {}
