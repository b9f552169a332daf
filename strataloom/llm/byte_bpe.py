"""Byte-level BPE over overlapping chunks, and back.

A long text is cut to chunks that overlap. Each chunk is split to pre-tokens alone, in parallel. Where the boundaries of two
neighbours meet inside their overlap, both have resynchronised: from there on they agree, since a match depends only on what follows
its start. Chunks are stitched at the first such place (a place followed by at least LOOKAHEAD code points of both, as the pattern
looks ahead by one). If a pair of neighbours has none, the two chunks are merged and split again. The pieces between stitches start and
end at true boundaries; they are encoded in parallel and the ids are joined in order. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import per_worker, slices, table

VOCABULARY, CHUNK, OVERLAP, LOOKAHEAD = "byte_bpe_multi_50k.tiktoken", 16_384, 512, 2


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Ends of the pre-tokens of text[start:end], split alone."""
        return [start + m.end() for m in self.pattern.finditer(text[start:end])]

    @staticmethod
    def fit(text: str, at: int, end: int) -> bool:
        """Whether a boundary may be a stitch. White space before it could match otherwise when nothing follows it any more."""
        return at + LOOKAHEAD <= end and not text[at - 1].isspace()

    def stitches(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Places from 0 to len(text) that are boundaries of pre-tokens of the whole text, one for each chunk that can be stitched."""
        places, n, start = [0], len(text), 0
        while start + chunk + overlap < n:
            # the chunk before reaches from its own true start to the end of the overlap, the next one begins where the overlap begins
            begin, end = start + chunk, start + chunk + overlap
            left = set(self.boundaries(text, places[-1], end))
            sync = next((x for x in self.boundaries(text, begin, end) if x in left and self.fit(text, x, end)), None)
            if sync is not None:
                places.append(sync)
            start = begin
        return places + [n]

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        if len(text) <= chunk + overlap:
            return self.encoding.encode_ordinary(text)
        places, ids = self.stitches(text, chunk, overlap), []
        for a, b in zip(places, places[1:]):
            ids += self.encoding.encode_ordinary(text[a:b])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


#: Texts with more code points than this are spread over tasks.
LONG = 65_536


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _codec(path: str, pattern: str) -> Codec:
    return per_worker(f"{path} {pattern}", lambda: Codec(path, pattern))


def _ids(codec: Codec, ids: list[list[int]]) -> list[pa.Array]:
    return [pa.array(ids, pa.list_(pa.int32()))]


def _digests(codec: Codec, ids: list[list[int]]) -> list[pa.Array]:
    names = per_worker(f"names {codec.encoding.n_vocab}", lambda: list(map(str, range(codec.encoding.n_vocab))))
    rows = []
    for x in ids:
        raw = codec.decode(x)
        rows.append((len(x), hashlib.sha256(",".join(map(names.__getitem__, x)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw)))
    return [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.string(), pa.string(), pa.int64()))]


#: What can be made of the ids in the task that has encoded a text: a function, and the columns it gives.
IDS, DIGESTS = (_ids, "ids array<int>"), (_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def encode(docs: DataFrame, path: str, pattern: str, give: tuple = IDS, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids array<int>): the ids of every whole text, without special tokens. With DIGESTS: (id, n_tokens, ids_sha256, decoded_sha256, n_bytes) of the ids and of the bytes they decode to.

    A null text counts as empty and has no ids. Rows are independent: repeated rows stay and other columns are ignored; an empty table
    gives an empty result. Texts of over `long` code points are split by chunk rows in other tasks, so that one text of any length does
    not hold up its task; only the joining of its ids needs memory in proportion to its length.
    """
    make, columns = give
    names = [x.split()[0] for x in columns.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = F.length("t")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for part, texts in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([part.column("i"), *make(codec, [codec.encode(x, chunk, overlap) for x in texts])], ["i", *names])

    def pre_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for part, texts in slices(batches, "c"):
            left, right = [], []
            for text in texts:
                ends = codec.boundaries(text, 0, len(text))
                left.append([x for x in ends if codec.fit(text, x, min(overlap, len(text)))])
                right.append([x - chunk for x in ends if chunk < x])
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("h"), part.column("k"), pa.array(left, pa.list_(pa.int32())), pa.array(right, pa.list_(pa.int32()))], ["i", "h", "k", "l", "r"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for part, texts in slices(batches, "c"):
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("h"), part.column("k"), pa.array([codec.encode(x, chunk, overlap) for x in texts], pa.list_(pa.int32()))], ["i", "h", "k", "ids"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for at in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column("i").slice(at, 1), *make(codec, batch.column("ids").slice(at, 1).to_pylist())], ["i", *names])

    # equal rows of long texts are taken together: (i, h) then names one
    longs = rows.where(size > long).groupBy("i", F.sha2("t", 256).alias("h")).agg(F.first("t").alias("t"), F.count(F.lit(1)).alias("n"))
    chunks = longs.select("i", "h", "t", F.explode(F.sequence(F.lit(0), ((size - 1) / chunk).cast("int"))).alias("k"))
    chunks = chunks.select("i", "h", "k", F.substring("t", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("c")).repartition("i", "h", "k")
    marks = chunks.mapInArrow(pre_tokens, "i long, h string, k int, l array<int>, r array<int>")
    line = Window.partitionBy("i", "h").orderBy("k")
    synced = marks.select("i", "h", "k", (F.col("k") * chunk + F.array_min(F.array_intersect("l", F.lag("r").over(line)))).alias("at")).where("k > 0")
    # a chunk's boundaries are sure only if it has itself resynchronised; what follows a gap is one piece, stitched in its own task
    synced = synced.withColumn("gaps", F.count_if(F.col("at").isNull()).over(line)).where("gaps = 0")
    places = synced.groupBy("i", "h").agg(F.sort_array(F.collect_list("at")).alias("at"))
    cuts = longs.join(places, ["i", "h"], "left").withColumn("at", F.concat(F.array(F.lit(0)), F.coalesce("at", F.array().cast("array<int>")), F.array(size)))
    cuts = cuts.select("i", "h", "t", "at", F.explode(F.sequence(F.lit(0), F.size("at") - 2)).alias("k"))
    cuts = cuts.select("i", "h", "k", F.substring("t", F.get("at", "k") + 1, F.get("at", F.col("k") + 1) - F.get("at", "k")).alias("c")).repartition("i", "h", "k")
    joined = cuts.mapInArrow(pieces, "i long, h string, k int, ids array<int>").groupBy("i", "h").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    spread = longs.select("i", "h", "n").join(joined, ["i", "h"]).select("i", "ids", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("i", "ids")
    if make is not _ids:
        spread = spread.mapInArrow(finish, f"i long, {columns}")
    return rows.where(size <= long).mapInArrow(short, f"i long, {columns}").unionByName(spread).withColumnRenamed("i", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): the raw bytes of the ids, joined; they need not be UTF-8. Null ids give empty bytes; an id that is not in the vocabulary fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([codec.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["i", "bytes"])

    return encoded.select(F.col(id_col).alias("i"), F.col(ids_col).alias("ids")).mapInArrow(run, "i long, bytes binary").withColumnRenamed("i", id_col)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary_path(), default_pattern()
    return encode(table(spark, sf_dir, "documents"), path, pattern, DIGESTS)


QUERIES, SQL = {"op10_byte_bpe": op10_byte_bpe}, {}
