"""Quality rules with risk-controlled thresholds.

Fixed base rules come first. Further rules compare shares of a text with cutoffs, chosen for each stratum (language) on labelled
holdouts: H0 "the rule rejects at least ALPHA / rules of the stratum's good documents" is tested for each cutoff of a fixed grid, from
the loosest on, with the exact binomial tail P(Bin(n, alpha) <= false rejections). A chain of cutoffs stops at its first failure (fixed
sequence), and the chains of all strata and rules share DELTA (Bonferroni). So with probability 1 - DELTA at once in all strata, at
most ALPHA of the good documents are rejected by all rules together. Of the cutoffs that pass, the one with the best difference of
rejected bad and good shares is taken, the loosest at a tie, none if no cutoff is better than nothing.

Everything is DataFrame functions. Counting needs one pass without a shuffle; what is shuffled are counts by stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, let, table

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Allowed share of good documents that are rejected by all rules together, and the chance of exceeding it anywhere.
ALPHA, DELTA = 0.02, 0.05
#: Up to so many strata the table of cutoffs is broadcast; more are joined by shuffling, with the same result.
BROADCAST_STRATA = 100_000
#: Rule: expression, and its cutoffs from loose to strict; a document with more is rejected.
RULES = {
    "symbol_share": ("n_symbols / word_chars", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02)),
    "repeat_share": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_line_share": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "long_words": ("word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0)),
    "short_words": ("n_words / word_chars", (0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3)),
}
_POS = (1 << 22) - 1


def repeated_words(words: Column) -> Column:
    """How many of the words lie in a window of three that stands twice or more in the array.

    Windows get 42 bits of hash and 22 of place in one number; sorted, repeated hashes are neighbours. Only windows among them are
    compared as strings, so the result is exact. Arrays that are too long for 22 bits of place are compared as strings at once.
    """

    def exact(w: Column, places: Column) -> Column:
        found = F.array_sort(F.transform(places, lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("s"), p.alias("p"))))
        equal = lambda all_, x, i: F.coalesce(F.get(all_, i)["s"] == x["s"], F.lit(False))
        twice = let(found, lambda all_: F.filter(all_, lambda x, i: equal(all_, x, i - 1) | equal(all_, x, i + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

    def hashed(w: Column) -> Column:
        keys = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long"))))
        def near(all_, x, i):
            own = x.bitwiseOR(F.lit(_POS))
            return F.coalesce(F.get(all_, i - 1).bitwiseOR(F.lit(_POS)) == own, F.lit(False)) | F.coalesce(F.get(all_, i + 1).bitwiseOR(F.lit(_POS)) == own, F.lit(False))
        twice = let(F.sort_array(keys), lambda all_: F.filter(all_, lambda x, i: near(all_, x, i)))
        return F.transform(twice, lambda x: x.bitwiseAND(F.lit(_POS)).cast("int"))

    count = let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).when(F.size(w) > _POS, exact(w, F.sequence(F.lit(0), F.size(w) - 3))).otherwise(let(hashed(w), lambda p: F.when(F.size(p) == 0, F.lit(0)).otherwise(exact(w, p)))))
    return count.cast("long")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long). A null text has none of them. Columns of these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    out = docs.withColumn("_strataloom_words", words).withColumn("_strataloom_lines", lines)
    words, lines = F.col("_strataloom_words"), F.col("_strataloom_lines")
    return out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }).drop("_strataloom_words", "_strataloom_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _values() -> dict[str, Column]:
    return {name: F.coalesce(F.expr(f"try_divide({a}, cast({b} as double))"), F.lit(0.0)) for name, (expr, _) in RULES.items() for a, b in [expr.split(" / ")]}


def binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), summed in logarithms; 1 where k is at least the mean, which no test needs exactly."""
    odds = F.ln(F.lit(alpha / (1 - alpha)))

    def step(acc: Column, i: Column) -> Column:
        more = let(acc["p"] + F.ln((n - i + 1) / i) + odds, lambda p: F.struct(p.alias("p"), (acc["s"] + F.log1p(F.exp(p - acc["s"]))).alias("s")))
        return F.when(i == 0, acc).otherwise(more)

    start = n * F.log1p(F.lit(-alpha))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.struct(start.alias("p"), start.alias("s")), step, lambda acc: F.exp(acc["s"]))
    return F.when(k >= n * alpha, F.lit(1.0)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """(stratum, one column for each rule): chosen cutoffs, null where none passes. labels: (doc_id, quality 1 good or 0 bad); null labels are left out, repeated ones count each.

    Each language with labels is a stratum; a null language belongs to the stratum ''.
    """
    values = _values()
    rows = measured.where(~base_failed()).select(F.col(id_col).alias("i"), F.coalesce(F.col(stratum_col), F.lit("")).alias("s"), *[v.alias(k) for k, v in values.items()])
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("i"), (F.col("quality") == 1).alias("good"))
    known = rows.join(marks, "i")
    cells = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(j).alias("step"), (F.col(k) > c).alias("hit")) for k, (_, grid) in RULES.items() for j, c in enumerate(grid)])
    counts = known.select("s", "good", F.inline(cells)).groupBy("s", "rule", "step").agg(*[F.count_if(F.expr(x)).alias(y) for x, y in (("good", "n"), ("good and hit", "k"), ("not good", "bad_n"), ("not good and hit", "bad_k"))])
    # few rows: cutoffs times labelled strata
    counts = cut(counts)
    # one number
    chains = max(1, len(RULES) * counts.select("s").distinct().count())
    tested = counts.withColumn("passed", binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= delta / chains)
    line = Window.partitionBy("s", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valid = tested.withColumn("all_passed", F.min("passed").over(line)).where("all_passed")
    gain = F.coalesce(F.expr("try_divide(bad_k, cast(bad_n as double))"), F.lit(0.0)) - F.col("k") / F.col("n")
    best = valid.withColumn("gain", gain).where("gain > 0").groupBy("s", "rule").agg(F.max_by("step", F.struct("gain", -F.col("step"))).alias("step"))
    grid = F.create_map(*[F.lit(x) for k, (_, g) in RULES.items() for j, c in enumerate(g) for x in (f"{k} {j}", float(c))])
    best = best.withColumn("cutoff", grid[F.concat_ws(" ", "rule", "step")])
    chosen = best.groupBy("s").agg(*[F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"max_{k}") for k in RULES])
    return counts.select("s").distinct().join(chosen, "s", "left").withColumnRenamed("s", "stratum")


def verdict(measured: DataFrame, chosen: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """measured with base_failed and kept (columns of these names are replaced). In a language without labels nothing but the base rules rejects, as nothing was tested there."""
    chosen = cut(chosen)
    own = chosen.select(F.col("stratum").alias("_strataloom_stratum"), F.struct(*[f"max_{k}" for k in RULES]).alias("_strataloom_cutoffs"))
    if chosen.count() <= BROADCAST_STRATA:
        own = F.broadcast(own)
    out = measured.join(own, F.coalesce(F.col(stratum_col), F.lit("")) == F.col("_strataloom_stratum"), "left")
    failed = F.lit(False)
    for name, value in _values().items():
        failed = failed | F.coalesce(value > F.col(f"_strataloom_cutoffs.max_{name}"), F.lit(False))
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~failed)
    return out.drop("_strataloom_stratum", "_strataloom_cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs with its measures, base_failed and kept.

    A null or empty text has no words and fails the base rules. Rows with the same doc_id are judged each by its own text; every label
    of the id counts for each; a null id has no labels. Without labels nothing but the base rules rejects. Columns of docs named as a
    measure are replaced, all others stay. An empty table gives an empty result; a very long text is measured in its own row.
    """
    measured = measures(docs)
    return verdict(measured, cutoffs(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with just the columns of docs, whatever their names. Each text is measured once: rows are cut with their measures."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text", "lang")
    measured = cut(measures(packed).drop("text"))
    return verdict(measured, cutoffs(measured, labels)).where("kept").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(measures(table(spark, sf_dir, "documents")).drop("text", "source", "n_chars"))
    judged = verdict(measured, cutoffs(measured, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES, SQL = {"op8_quality_rules": op8_quality_rules}, {}
