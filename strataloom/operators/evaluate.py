"""Golden questions: predicates on answers, pass rates by mode, and their difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze


def normal(text: Column) -> Column:
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


def judge(cases: DataFrame) -> DataFrame:
    """cases (expect_any, forbid_any, expected_node_ids, selected_node_ids, answer, …) with passed and routed. Nothing expected is always met; routed is null without expected nodes."""
    said = normal(F.col("answer"))
    holds = lambda texts: F.exists(texts, lambda e: F.contains(said, normal(e)))
    expected = F.coalesce("expect_any", F.array().cast("array<string>"))
    passed = ((F.size(expected) == 0) | holds(expected)) & ~holds(F.coalesce("forbid_any", F.array().cast("array<string>")))
    routed = F.when(F.size(F.coalesce("expected_node_ids", F.array().cast("array<bigint>"))) > 0, F.coalesce(F.arrays_overlap("expected_node_ids", "selected_node_ids"), F.lit(False)))
    return cases.withColumn("passed", passed).withColumn("routed", routed)


def summary(judged: DataFrame) -> DataFrame:
    """(mode, n, n_passed, pass_rate, n_routed, n_routable, mean_latency)."""
    return judged.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), (F.count_if("passed") / F.count(F.lit(1))).alias("pass_rate"), F.count_if(F.coalesce("routed", F.lit(False))).alias("n_routed"), F.count("routed").alias("n_routable"), F.avg("latency").alias("mean_latency"))


def ablation_delta(summaries: DataFrame) -> DataFrame:
    rate = lambda mode: F.max(F.when(F.col("mode") == mode, F.col("pass_rate")))
    return summaries.agg(rate("full").alias("full_rate"), rate("flat").alias("flat_rate"), (rate("full") - rate("flat")).alias("delta"))


def report(summaries: DataFrame) -> str:
    """A Markdown table of a few modes."""
    rows = summaries.orderBy("mode").collect()
    return "\n".join(["| mode | n | passed | rate | routed |", "| --- | --- | --- | --- | --- |", *(f"| {r['mode']} | {r['n']} | {r['n_passed']} | {r['pass_rate']:.2%} | {r['n_routed']}/{r['n_routable']} |" for r in rows)])
