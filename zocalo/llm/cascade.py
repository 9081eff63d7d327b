"""Quality rules as a short-circuit cascade ordered by rejection per cost. DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zocalo.llm.frames import WORD, exact, stored

#: Rows (expected) of the sample on which cost and selectivity are estimated. It decides the order only, never a verdict.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on ``text`` and the columns of ``measures``; null counts as not failing."""

    name: str
    fails: Column


@dataclass(frozen=True)
class RuleEstimate:
    name: str
    seconds: float
    rejected: float


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text.

    Three-word windows are compared by a 64-bit hash within a document. The windows of a document are first tested for
    any repeat; only documents with one are sorted, so work is n log n in the longest text and nothing is exploded.
    Null text measures 0 throughout.
    """
    rows = exact(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    # Each explode of a one-element array keeps Spark from copying the expression into every place that uses it.
    one = lambda df, name, col: df.select("*", F.explode(F.array(col)).alias(name))
    rows = one(rows, "words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("words")
    rest = lambda k: F.slice("words", F.lit(k), F.greatest(n - 2, F.lit(0)))
    windows = F.transform(F.arrays_zip(rest(1).alias("a"), rest(2).alias("b"), rest(3).alias("c")),
                          lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    rows = one(rows.withColumn("n_words", n.cast("long")), "windows", F.when(n < 4, F.array().cast("array<bigint>")).otherwise(windows))
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = one(rows, "placed", F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    nothing = F.array(F.lit(None).cast("struct<h:bigint,at:int>"))
    m = F.size("placed")
    beside = F.arrays_zip(F.col("placed").alias("x"), F.concat(nothing, F.slice("placed", 1, F.greatest(m - 1, F.lit(0)))).alias("l"),
                          F.concat(F.slice("placed", 2, F.greatest(m - 1, F.lit(0))), nothing).alias("r"))
    twice = F.filter(beside, lambda z: (z["x"]["h"] == z["l"]["h"]) | (z["x"]["h"] == z["r"]["h"]))
    rows = one(rows, "found", F.when(m > 0, F.array_sort(F.transform(twice, lambda z: z["x"]["at"]))).otherwise(F.array().cast("array<int>")))
    gaps = F.arrays_zip(F.col("found").alias("x"), F.slice("found", 2, F.greatest(F.size("found"), F.lit(1))).alias("y"))
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, z: total + F.least(F.lit(3), F.coalesce(z["y"] - z["x"], F.lit(3))))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = one(rows, "lines", F.when(F.contains("text", F.lit("\n")), lines).otherwise(F.array().cast("array<string>")))
    return rows.select(
        "doc_id", "text", "n_words",
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """The two base rules and gentle bounds beyond them, on word length, symbols, repeated lines and letters."""
    n = F.col("n_words")
    return [
        Rule("few_words", n < 50),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 50 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > 4 * n),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 5) & (20 * F.col("n_dup_lines") > n)),
        Rule("few_letters", 2 * F.regexp_count("text", F.lit(r"\p{L}")) < F.col("word_chars")),
    ]


def estimate(measured: DataFrame, rules: list[Rule]) -> list[RuleEstimate]:
    """Seconds and rejected share of each rule on the rows of ``measured``, written once to the shared folder."""
    sample = stored(measured, "cascade-sample")
    size = max(sample.count(), 1)
    found = []
    for rule in rules:
        fails = F.coalesce(rule.fails, F.lit(False))
        begin = time.perf_counter()
        rejected = sample.filter(fails).count()
        found.append(RuleEstimate(rule.name, time.perf_counter() - begin, rejected / size))
    return found


def ordered(rules: list[Rule], estimates: list[RuleEstimate]) -> list[Rule]:
    """Rules by rejection per second, the highest first; ties and rules that reject nothing keep the given order."""
    rate = {e.name: e.rejected / max(e.seconds, 1e-9) for e in estimates}
    return sorted(rules, key=lambda r: -rate.get(r.name, 0.0))


def kept(rules: list[Rule]) -> Column:
    """True if no rule fails. A later rule is evaluated only on rows that every earlier one has let pass."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def rule_cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document with its measures, base_failed and kept; ``rules`` are tried in their estimated best order.

    The order changes the work, not the verdict, so reruns agree. Null and empty texts have no words and fail; repeated
    rows are judged each; an empty table gives an empty result; other columns are ignored.
    """
    rules = default_rules() if rules is None else rules
    sample = docs.sample(min(1.0, sample_rows / max(docs.count(), 1)), 7)
    best = ordered(rules, estimate(measures(sample), rules))
    return measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           base_failed().alias("base_failed"), (~base_failed() & kept(best)).alias("kept"))
