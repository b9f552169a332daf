"""Exact token counts by prefix dynamic programming over a SentencePiece vocabulary.

The vocabulary marks a word's start with U+2581 and has no piece in which that mark follows another character (checked when it is
loaded), so no merge crosses the start of a word: the count of a prefix is a running sum over the words before it and the count of the
part of the last word that lies in it. In a word, tokens are those of the library if every two neighbours are what the library makes of
the two alone. So the tokens of a prefix are those of a shorter prefix and one more piece, the only one that ends there and goes with the
last token of the shorter prefix:

    count(prefix) = count(prefix without its last piece) + 1

which is found from left to right in time that grows with the length of the word times that of the longest piece. Words repeat, so each
worker keeps the counts of those it has met (at most CACHED of them, none longer than LONG). All questions about budgets and cuts are
then answered from these sums, to the code point; a cut stops where no longer prefix can fit.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, slices, table

VOCABULARY, LIMIT, CACHED, LONG = "piece_bpe_32k.model", 4096, 400_000, 200
MARK = "▁"


class PrefixCounter:
    """Token counts of a text and of all its prefixes, as the library gives them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece crosses the start of a word; prefix sums by word would be wrong")
        # without the mark that the library puts before a text, for segments inside a word: messages of a model that follow are merged
        # into it, and this one says normalizer_spec { add_dummy_prefix: false }
        with open(path, "rb") as file:
            self.bare = sentencepiece.SentencePieceProcessor(model_proto=file.read() + b"\x1a\x02\x18\x00")
        self.pairs = {piece[i : i + 2] for piece in map(self.model.id_to_piece, range(self.model.get_piece_size())) for i in range(len(piece) - 1)}
        # pieces that the library can make, by their text
        normal = [k for k in range(self.model.get_piece_size()) if not (self.model.is_byte(k) or self.model.is_control(k) or self.model.is_unknown(k) or self.model.is_unused(k))]
        found = self.bare.encode([self.model.id_to_piece(k).replace(MARK, " ") for k in normal], num_threads=1)
        self.pieces = {self.model.id_to_piece(k): k for k, ids in zip(normal, found) if ids == [k]}
        self.longest = max(map(len, self.pieces))
        self.beside: dict[tuple[str, str], bool] = {}
        self.known: dict[str, int] = {}
        self.tables: dict[str, np.ndarray] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        """What to give to the library for each word with the spaces before it. One space fewer stands there, since the library puts one before a text; "" is a single space at the end."""
        if not text:
            return []
        parts, out, spaces = text.replace(MARK, " ").split(" "), [], 0
        if "" not in parts:
            return parts
        for part in parts:
            if part:
                out.append(" " * spaces + part)
                spaces = 0
            else:
                spaces += 1
        return out + [" " * (spaces - 1)] if spaces else out

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        if new := [w for w in set(words) if w not in known]:
            if len(known) + len(new) > CACHED:
                known.clear()
                new = list(set(words))
            own = dict(zip(new, map(len, self.model.encode(new, num_threads=1))))
            if "" in own:
                own[""] = 1
            known.update((w, n) for w, n in own.items() if len(w) <= LONG)
            return [known[w] if w in known else own[w] for w in words]
        return list(map(known.__getitem__, words))

    def goes(self, left: str | None, right: str) -> bool:
        """Whether the library leaves the two pieces side by side; left is None for a character that is no piece."""
        if left is None or left[-1] + right[0] not in self.pairs:
            return True
        key = (left, right)
        if key not in self.beside:
            if len(self.beside) >= CACHED:
                self.beside.clear()
            self.beside[key] = self.bare.encode((left + right).replace(MARK, " ")) == [self.pieces[left], self.pieces[right]]
        return self.beside[key]

    def table(self, word: str, budget: int | None = None) -> np.ndarray:
        """The count of each prefix of a word (as words gives it), from one code point on. With a budget, up to where no longer prefix can keep to it."""
        if word in self.tables:
            return self.tables[word]
        marked = MARK + word.replace(" ", MARK)
        counts, last, pieces, over = [0], [None], self.pieces, 0
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = marked[start:end]
                if piece in pieces and (not start or self.goes(last[start], piece)):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:
                counts.append(counts[-1] + len(self.bare.encode(marked[end - 1])))
                last.append(None)
            over = 0 if budget is None or counts[-1] <= budget else over + 1
            # a prefix has one token more than one that is at most longest shorter
            if over > self.longest:
                break
        out = np.array(counts[2:], np.int64)
        if len(word) <= LONG:
            if len(self.tables) >= CACHED // 10:
                self.tables.clear()
            if len(out) == len(word):
                self.tables[word] = out
        return out

    def prefix(self, text: str) -> "Prefix":
        words = self.words(text)
        # every word but the first has one space more than its string
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        return Prefix(self, text, words, ends, np.cumsum(self.counts(words)))


class Prefix:
    """Answers questions on one text from the counts stored at the ends of its words, and from the tables of single words."""

    def __init__(self, counter: PrefixCounter, text: str, words: list[str], ends: np.ndarray, sums: np.ndarray):
        self.counter, self.text, self.words, self.ends, self.sums = counter, text, words, ends, sums

    def count(self, at: int) -> int:
        """Tokens of text[:at]."""
        if at <= 0:
            return 0
        at = min(at, len(self.text))
        j = bisect.bisect_left(self.ends, at)
        before, start = (int(self.sums[j - 1]), int(self.ends[j - 1]) + 1) if j else (0, 0)
        # a space alone at the end is a token of its own
        return before + (int(self.counter.table(self.words[j])[at - start - 1]) if at > start else 1)

    def every(self) -> np.ndarray:
        """The counts of all prefixes, from one code point to the whole text."""
        out = []
        for j, word in enumerate(self.words):
            before = int(self.sums[j - 1]) if j else 0
            out.append(np.concatenate([[before + 1] if j else [], before + self.counter.table(word)]))
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)

    def total(self) -> int:
        return int(self.sums[-1]) if len(self.sums) else 0

    def cut(self, budget: int) -> int:
        """The length of the longest prefix that has at most budget tokens and does not end with a cut-off space; it may end inside a word."""
        j = bisect.bisect_right(self.sums, budget)
        whole = int(self.ends[j - 1]) if j else 0
        if j == len(self.words):
            return whole
        before = int(self.sums[j - 1]) if j else 0
        fits = np.flatnonzero(before + self.counter.table(self.words[j], budget - before) <= budget)
        return (whole + 1 if j else 0) + int(fits[-1]) + 1 if len(fits) else whole


def _counter(path: str) -> PrefixCounter:
    return per_worker(path, lambda: PrefixCounter(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, cut_chars) of every whole text. cut_chars: the longest prefix within limit; it may end inside a word.

    A null text counts as empty (0 bytes, 0 tokens). Rows are independent: repeated ids stay, other columns are ignored, an empty
    table gives an empty result, and a very long text needs memory in proportion to its own length only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for part, texts in slices(batches, "t"):
            rows = []
            for text in texts:
                if not text:
                    rows.append((0, 0, False, 0))
                    continue
                prefix = counter.prefix(text)
                n = prefix.total()
                rows.append((len(text.encode()), n, n > limit, prefix.cut(limit) if n > limit else len(text)))
            a, b, c, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c), pa.array(d, pa.int64())], ["i", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "i long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long").withColumnRenamed("i", id_col)


def every_prefix(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts): the token counts of all prefixes of a text, from one code point to the whole; an empty array for null or empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for part, texts in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array([counter.prefix(x or "").every().astype("int32") for x in texts], pa.list_(pa.int32()))], ["i", "counts"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "i long, counts array<int>").withColumnRenamed("i", id_col)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ends, sums): code points up to each word's end, and the token count of the prefix that ends there; empty arrays for null or empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for part, texts in slices(batches, "t"):
            prefixes = [counter.prefix(text or "") for text in texts]
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.array([p.ends.astype("int32") for p in prefixes], pa.list_(pa.int32())), pa.array([p.sums.astype("int32") for p in prefixes], pa.list_(pa.int32()))], ["i", "ends", "sums"])

    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "i long, ends array<int>, sums array<int>").withColumnRenamed("i", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES, SQL = {"op6_token_counts": op6_token_counts}, {}
