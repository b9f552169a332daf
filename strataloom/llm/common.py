"""Shared by the operators of this subpackage: tables, hashing in numpy, checkpoints."""

from __future__ import annotations

import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that a slice of an Arrow batch holds at most, unless a single text is longer. It bounds a worker's memory.
SLICE_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The folder for checkpoints. A folder of this machine is taken only on a local master, as in tests; a cluster has to name a shared one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; checkpoints need a folder that the cluster shares")
        sc.setCheckpointDir(named or f"/tmp/strataloom-checkpoints-{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, **options) -> DataFrame:
    """df, written as a table in the folder of checkpoints and read again: smaller than a checkpoint, and a reader takes only the columns that it needs. options: the writer's."""
    path = f"{_folder(df.sparkSession)}/strataloom-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage with checkpoint(); its folder is the cluster's spark.checkpoint.dir."""
    _folder(df.sparkSession)
    out = df.checkpoint(eager)
    if eager:
        sweep(df.sparkSession)
    return out


def sweep(spark: SparkSession) -> None:
    """Shuffle files and checkpoints of earlier steps go when the driver collects its garbage, which a small driver heap may put off for long; so it is collected here."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(expr: Column, use: Callable[[Column], Column]) -> Column:
    """use(expr), with expr evaluated once however often use names it."""
    return F.element_at(F.transform(F.array(expr), use), 1)


def per_worker(key: str, make: Callable):
    """make() once in each Python worker process. Functions travel by value, so a module's globals do not last from task to task."""
    kept = sys.__dict__.setdefault("_strataloom_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cuts each batch to slices of size code points, so that temporary arrays stay small."""
    for batch in batches:
        texts = batch.column(column)
        lengths = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(texts), 0))
        start = total = 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > size:
                part = batch.slice(start, i - start)
                yield part, part.column(column).to_pylist()
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, part.column(column).to_pylist()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer over an array of uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_words(words: list[str]) -> np.ndarray:
    """Stable 64-bit hashes of strings."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n neighbours, in order; one hash of all where there are fewer than n, none where there are none."""
    n = min(n, len(hashes)) or 1
    size = len(hashes) - n + 1 if len(hashes) else 0
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0xD1B54A32D192ED03) + hashes[i : i + size]
    return mix(out, n)


def sha_safe(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")
