"""Which tokens of two tokenizers cover the same bytes of a text.

No token of either tokenizer crosses a place where a space follows a character that is no white space. Python cuts texts there and
tokenises: a row for each slice of documents holds the ids and the byte offsets of token ends of the slice's distinct words, and each
document as the numbers of its words. Everything after that is made of Spark's higher-order functions. Offsets at which tokens of both
sides end (array_intersect) cut a word's tokens into groups. Each place where a token of either side ends closes one stretch of bytes that
a single token of A and a single token of B share, so links are the distinct ends: of the sorted ends of both sides, the one at place m
that is the i-th of its own side has m - i ends of the other side before it, which names the other token. Both sides are thus linked in
one sort, whatever the length of a group. Words end a group, so a document's groups and sums are those of its words.

Counts of linked id pairs over the corpus are joined back to the links of the words. The pairs are as many as the vocabularies have
met in the corpus; where their counted number is at most BROADCAST they are broadcast, beyond it they are joined by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, per_worker, slices, stored, table
from .token_counts import MARK, PrefixCounter

A, B, BROADCAST, FEW, SLICE, JOINED = "byte_bpe_50k.json", "piece_bpe_32k.model", 2_000_000, 48, 5_000_000, 200
#: Slices that a task holds on average where words are summed up, and encoded bytes of a row group of them. Both bound a task's memory, whatever the input.
DEALT, GROUP = 5, 32 << 20
# a row is megabytes, so that a row group's size is looked at after each row; a reader holds a row group at most
STORED = {"parquet.dictionary.page.size": 8 << 20, "parquet.page.size": 8 << 20, "parquet.block.size": GROUP, "parquet.page.size.row.check.min": 1}
_SIDE, _RANK, _PART = 1 << 31, (1 << 31) - 1, (1 << 21) - 1
_BEFORE_SPACE, _AFTER_SPACE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


def words_of(text: str) -> list[str]:
    """The text with a space before it, cut where a space follows a character that is no white space."""
    if not text or _AFTER_SPACE.search(" " + text):
        return _BEFORE_SPACE.split(" " + text)
    return [" " + x for x in text.split(" ")]


class Side:
    """A tokenizer of words (each with the space before it) and the bytes of each of its ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], raw: list[bytes]):
        self.encode, self.raw, self.size = encode, raw, np.array([len(x) for x in raw], np.int32)

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, one word after another, how many each word has, and whether they join to its bytes.

        Words are tokenised JOINED at a time as one text, which is cut where words begin; a text that does not come back is tokenised word by word.
        """
        # a word that ends in white space would take in the space of the next one
        alone = np.flatnonzero([w[-1].isspace() for w in words]) + 1
        edges = np.unique(np.concatenate([np.arange(0, len(words), JOINED), alone, [len(words)]])).tolist()
        parts = list(zip(edges, edges[1:]))
        texts = ["".join(words[i:j]) for i, j in parts]
        lengths = np.array([len(w.encode()) for w in words], np.int64)
        flat, n, good = [np.zeros(0, np.int32)], np.zeros(len(words), np.int32), np.ones(len(words), bool)
        for (i, j), text, ids in zip(parts, texts, self.encode(texts)):
            found = np.array(ids, np.int32)
            ends, begin = np.cumsum(self.size[found], dtype=np.int64), np.cumsum(lengths[i:j])
            stop = np.searchsorted(ends, begin)
            if b"".join(map(self.raw.__getitem__, ids)) == text.encode() and (ends[stop] == begin).all():
                n[i:j] = np.diff(stop + 1, prepend=0)
                flat.append(found)
                continue
            each = self.encode(words[i:j])
            n[i:j], good[i:j] = [len(x) for x in each], [b"".join(map(self.raw.__getitem__, x)) == w.encode() for w, x in zip(words[i:j], each)]
            flat.append(np.fromiter(chain.from_iterable(each), np.int32))
        return np.concatenate(flat), n, good


def byte_level(path: str) -> Side:
    """Byte-level BPE from its vocabulary file. Ids rise in the order of merges, so they are ranks; the rank library encodes short words some ten times faster than the file's own, and a test compares them."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    # printable bytes of Latin-1 stand for themselves, the others, in order, for U+0100 and what follows
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(map(byte_of.__getitem__, entry)): k for entry, k in vocabulary.items() if all(c in byte_of for c in entry)}
    ranks = {x: k for x, k in ranks.items() if vocabulary.get("<|endoftext|>") != k}
    model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    raw = [b""] * (max(ranks.values()) + 1)
    for x, k in ranks.items():
        raw[k] = x
    return Side(lambda words: list(map(model.encode_ordinary, words)), raw)


def pieces(path: str) -> Side:
    """SentencePiece; the library puts a space before what it encodes, so the word's own is taken off."""
    model = PrefixCounter(path).model
    named = map(model.id_to_piece, range(model.get_piece_size()))
    raw = [bytes([int(x[3:5], 16)]) if model.is_byte(k) else x.replace(MARK, " ").encode() for k, x in enumerate(named)]
    space = [model.piece_to_id(MARK)]
    return Side(lambda words: [ids if len(w) > 1 else space for w, ids in zip(words, model.encode([w[1:] for w in words], num_threads=1))], raw)


WORD = "struct<a: array<int>, ae: array<int>, b: array<int>, be: array<int>>"


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """values, dealt to lists of n each."""
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(values))


def _ends(ids: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where each token of a word ends, in bytes; words have n tokens each."""
    sums = np.append(0, np.cumsum(size[ids], dtype=np.int64))
    return (sums[1:] - np.repeat(sums[np.cumsum(n) - n], n)).astype(np.int32)


def tokens(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(words, n, docs): a row for each slice of documents; the tokens of its distinct words, how often each word stands in the slice, and (i, w) of each document, its id and the numbers of its words.

    A document that is null or empty, or whose tokens on either side are not its bytes, has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = per_worker(f"links {a} {b}", lambda: (byte_level(a), pieces(b)))
        for part, texts in slices(batches, "t", SLICE):
            number = defaultdict(count().__next__)
            of = [np.fromiter(map(number.__getitem__, words_of(x)), np.int32) if x and MARK not in x else np.zeros(0, np.int32) for x in texts]
            words = list(number)
            fields, good = [], np.ones(len(words), bool)
            for side in sides:
                ids, n, right = side.tokens(words)
                fields += [_lists(ids, n), _lists(_ends(ids, n, side.size), n)]
                good &= right
            if not good.all():
                of = [w if good[w].all() else w[:0] for w in of]
            numbers = np.concatenate([np.zeros(0, np.int32), *of])
            n = np.bincount(numbers, minlength=len(words))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            rows = pa.StructArray.from_arrays([part.column("i"), _lists(numbers, [len(w) for w in of])], ["i", "w"])
            yield pa.RecordBatch.from_arrays([one(pa.StructArray.from_arrays(fields, ["a", "ae", "b", "be"])), one(pa.array(n, pa.int64())), one(rows)], ["words", "n", "docs"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, f"words array<{WORD}>, n array<bigint>, docs array<struct<i: bigint, w: array<int>>>")


def _coded(ends: Column, side: int = 0) -> Column:
    """end << 32 | side << 31 | place, which sorts by end, A before B."""
    return F.transform(ends, lambda e, i: F.shiftleft(e.cast("long"), 32).bitwiseOR(i.cast("long") + F.lit(side)))


def _packed(a: Column, b: Column) -> Column:
    """Two ids as one number, which sorts and joins by B id first."""
    return F.shiftleft(b.cast("long"), 32).bitwiseOR(a.cast("long"))


def link_pairs(a: Column, ae: Column, b: Column, be: Column) -> Column:
    """array<bigint>: B id << 32 | A id of every link, in the order of the text."""

    def of(word: Column) -> Column:
        # bound once a word, as a field of a row is made anew whenever it is named
        a, b, merged = (word[x] for x in ("a", "b", "merged"))

        def pair(c: Column, m: Column) -> Column:
            i = c.bitwiseAND(F.lit(_RANK)).cast("int")
            of_a = c.bitwiseAND(F.lit(_SIDE)) == 0
            # an end of B that A has as well has closed its link with A's entry, just before
            twice = F.shiftright(c, 32) == F.shiftright(F.get(merged, m - 1), 32)
            return F.when(of_a, _packed(F.get(a, i), F.get(b, m - i))).when(F.coalesce(twice, F.lit(False)), F.lit(None)).otherwise(_packed(F.get(a, m - i), F.get(b, i)))

        return F.filter(F.transform(merged, pair), lambda x: x.isNotNull())

    return let(F.struct(a.alias("a"), b.alias("b"), F.sort_array(F.concat(_coded(ae), _coded(be, _SIDE))).alias("merged")), of)


def _places(cuts: Column, ends: Column) -> Column:
    """At which place of ends each cut stands; both ascend, and ends holds all cuts."""
    looked_up = F.transform(cuts, lambda e: F.array_position(ends, e).cast("int") - 1)
    marks = F.transform(cuts, lambda e: F.shiftleft(e.cast("long"), 32).bitwiseOR(F.lit(_SIDE)))
    found = let(F.sort_array(F.concat(_coded(ends), marks)), lambda merged: F.filter(merged, lambda c, m: F.get(merged, m + 1).bitwiseAND(F.lit(_SIDE)) != 0))
    # few are looked up one by one, many are sorted in
    return F.when(F.size(ends) <= FEW, looked_up).otherwise(F.transform(found, lambda c: c.bitwiseAND(F.lit(_RANK)).cast("int")))


def group_text(a: Column, b: Column, at: Column, bt: Column) -> Column:
    """'a1,a2|b1;a3|b2,b3': ids by group, from the places of each group's last tokens."""
    before = lambda x, k: F.coalesce(F.get(x, k - 1), F.lit(-1)) + 1

    def ids(of: Column, places: Column, k: Column) -> Column:
        first, last = before(places, k), F.get(places, k)
        several = F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(of, i).cast("string")), ",")
        return F.when(first == last, F.get(of, last).cast("string")).otherwise(several)

    groups = F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda k: F.concat(ids(a, at, k), F.lit("|"), ids(b, bt, k)))
    return F.array_join(groups, ";")


def aligned_words(words: Column) -> Column:
    """array<struct<n_a, n_b, n_groups, groups, links>> of words: sizes, the text of the groups, and the linked pairs."""

    def of(w: Column, cuts: Column) -> Column:
        a, b, n = w["a"], w["b"], F.size(cuts)
        # where every token is a group's only one of its side, and where all are one group, nothing has to be looked for
        single = (n == F.size(a)) & (n == F.size(b))
        joined = lambda of: F.array_join(of.cast("array<string>"), ",")
        general = let(F.struct(_places(cuts, w["ae"]).alias("at"), _places(cuts, w["be"]).alias("bt")), lambda x: group_text(a, b, x["at"], x["bt"]))
        pairs = F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x.cast("string"), F.lit("|"), y.cast("string"))), ";")
        text = F.when(n == 1, F.concat(joined(a), F.lit("|"), joined(b))).when(single, pairs).otherwise(general)
        links = F.when(single, F.zip_with(a, b, _packed)).otherwise(link_pairs(a, w["ae"], b, w["be"]))
        return F.struct(F.size(a).alias("n_a"), F.size(b).alias("n_b"), n.alias("n_groups"), text.alias("groups"), links.alias("links"))

    cuts = lambda w: F.when(w["ae"] == w["be"], w["ae"]).otherwise(F.array_intersect(w["ae"], w["be"]))
    return F.transform(words, lambda w: let(cuts(w), lambda found: of(w, found)))


def _apart(*names: str) -> Column:
    """The fields of the column words as arrays. They are bound once a row, as a field of an array of structs is gathered whenever it is named."""
    return F.struct(*[F.col(f"words.{x}").alias(x) for x in names])


def _total(w: Column, words: Column, name: str) -> Column:
    """The sum of a number over a document's words."""
    return F.aggregate(w, F.lit(0).cast("long"), lambda s, k: s + F.get(words[name], k)).alias(name)


def _totals(w: Column, words: Column, names: tuple[str, ...]) -> Column:
    """The sums of three numbers over a document's words, added as one number of 21 bits each where none can reach them."""
    one = F.aggregate(w, F.lit(0).cast("long"), lambda s, k: s + F.get(words["packed"], k))
    apart = lambda s: F.struct(*[F.shiftright(s, 21 * n).bitwiseAND(F.lit(_PART)).alias(x) for n, x in enumerate(names)])
    return F.when(F.size(w) * words["most"] <= _PART, let(one, apart)).otherwise(F.struct(*[_total(w, words, x) for x in names]))


def alignment(tokenised: DataFrame) -> DataFrame:
    """(links, n, docs): by slice the links of each word and its number in the slice, and (i, w, n_a, n_b, n_groups, groups_sha256) of each document."""
    known = tokenised.select("n", "docs", aligned_words(F.col("words")).alias("words"))

    def doc(d: Column, words: Column) -> Column:
        w = d["w"]
        text = F.array_join(F.transform(w, lambda k: F.get(words["groups"], k)), ";")
        digest = F.when(F.size(w) > 0, F.sha2(text, 256)).otherwise("").alias("groups_sha256")
        return let(_totals(w, words, names), lambda sums: F.struct(d["i"].alias("i"), w.alias("w"), *[sums[x].alias(x) for x in names], digest))

    names = ("n_a", "n_b", "n_groups")
    packed = F.transform("words", lambda x: F.shiftleft(x["n_groups"].cast("long"), 42).bitwiseOR(F.shiftleft(x["n_b"].cast("long"), 21)).bitwiseOR(x["n_a"].cast("long")))
    most = F.coalesce(F.greatest(*[F.array_max(f"words.{x}") for x in names]), F.lit(0)).cast("long")
    docs = let(F.struct(*[F.col(f"words.{x}").alias(x) for x in (*names, "groups")], packed.alias("packed"), most.alias("most")), lambda words: F.transform("docs", lambda d: doc(d, words)))
    return known.select(F.col("words.links").alias("links"), "n", docs.alias("docs"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of the corpus hold an id pair, and whether no other pair of its B id has more."""
    words = aligned.select(F.explode(F.arrays_zip("links", "n")).alias("x")).where("x.n > 0")
    counts = words.select(F.explode("x.links").alias("pair"), F.col("x.n").alias("n")).groupBy("pair").agg(F.sum("n").alias("count"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", F.shiftright("pair", 32)).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def token_links(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text.

    A null or empty text, and one whose tokens do not join to its bytes, has zeros and ''. Equal rows count as often as they stand and are
    all returned, so are rows with a null id; ties between pairs of a B id are all best; other columns are ignored; an empty table gives an
    empty result. A long text is tokenised in its task, with memory in proportion to its length.
    """
    aligned = stored(alignment(tokens(docs, a, b, id_col, text_col)).withColumn("slice", F.monotonically_increasing_id()), compression="zstd", **STORED)
    counts = stored(pair_counts(aligned))
    # dealt by slice once, while a slice is one row: both sums below need no other shuffle
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-aligned.count() // DEALT))
    dealt = aligned.select("slice", "links").repartition(parts, "slice")
    links = dealt.select("slice", F.posexplode("links").alias("k", "links")).select("slice", "k", F.explode("links").alias("pair"))
    met = links.join(F.broadcast(counts) if counts.count() <= broadcast else counts, "pair")
    words = met.groupBy("slice", "k").agg(F.sum(F.col("best").cast("int")).alias("n_best"), F.sum("count").alias("count_sum"))
    # a slice has as many rows here as it has distinct words; all words of documents have links
    sums = words.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("k", "n_best", "count_sum"))).alias("words"))
    rows = aligned.select("slice", F.size("links").alias("m"), "docs").join(sums, "slice", "left")
    # words without tokens of their own, which no document uses, have no sums: places are kept by their numbers
    dense = F.when(F.size("words") == F.col("m"), F.col("words")).otherwise(F.array_sort(F.concat("words", F.transform(F.array_except(F.sequence(F.lit(0), F.col("m") - 1), F.col("words.k")), lambda k: F.struct(k.alias("k"), F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))))))
    rows = rows.withColumn("words", dense)

    def doc(d: Column, words: Column) -> Column:
        return F.struct(d["i"].alias(id_col), d["n_a"], d["n_b"], d["n_groups"], (d["n_a"] + d["n_b"] - d["n_groups"]).alias("n_links"), *[_total(d["w"], words, x) for x in ("n_best", "count_sum")], d["groups_sha256"])

    return rows.select(F.inline(let(_apart("n_best", "count_sum"), lambda words: F.transform("docs", lambda d: doc(d, words)))))


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_links(table(spark, sf_dir, "documents"), public_tokenizers.path(A), public_tokenizers.path(B))


QUERIES, SQL = {"op12_token_links": op12_token_links}, {}
