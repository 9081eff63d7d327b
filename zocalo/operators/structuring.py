"""Questions in free text -> structured questions, over a whole column.

Everything is native columns in stacked projections, so the same code runs on a
batch and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zocalo.functions import vocabulary as v
from zocalo.functions.sets import given, none, ordered_union
from zocalo.functions.text import clean_spaces, contains_any, fold
from zocalo.operators.filters import keep_where
from zocalo.operators.rules import RULES, Rule, rule_tables
from zocalo.plans.metrics import METRICS, OPERATIONS

STRUCTURED = ("original_question", "normalized_question", "intent", "operation", "metrics", "filters", "date_range",
              "group_by", "context", "suggested_tables", "optimizer")


def intent(t: str) -> Column:
    trend = contains_any(t, v.TEMPORAL_PHRASES) | F.col(t).rlike(rf"(^|\s)({'|'.join(v.TEMPORAL_WORDS)})(\s|$)")
    return (F.when(trend, "temporal_trend")
            .when(contains_any(t, v.RANKING_WORDS), "ranking")
            .when(contains_any(t, v.COMPARISON_WORDS), "comparison")
            .when(contains_any(t, v.COUNT_INTENT_WORDS), "count")
            .when(contains_any(t, v.AGGREGATION_WORDS), "aggregation")
            .otherwise("detail"))


def operation(t: str, intent_: Column) -> Column:
    ranking = intent_ == "ranking"
    near_average = contains_any(t, [v.AVERAGE_REFERENCE]) & contains_any(t, v.NEAR_WORDS)
    return (F.when(intent_ == "count", "count")
            .when(near_average, "rank_nearest_average")
            .when((intent_ == "comparison") | contains_any(t, v.COMPARISON_WORDS), "compare")
            .when(ranking & contains_any(t, v.DESCENDING_PHRASES), "rank_desc")
            .when(ranking & contains_any(t, v.ASCENDING_PHRASES), "rank_asc")
            .when(ranking & contains_any(t, v.HIGHEST_WORDS), "rank_desc")
            .when(ranking & contains_any(t, v.LOWEST_WORDS), "rank_asc")
            .when(contains_any(t, v.MEDIAN_WORDS), "median")
            .when(contains_any(t, v.AVERAGE_WORDS), "average")
            .when(contains_any(t, v.COUNT_WORDS), "count")
            .when(contains_any(t, v.SUM_WORDS), "sum")
            .otherwise("detail"))


def metrics(t: str) -> Column:
    return ordered_union(none(), *[given(contains_any(t, words), names) for words, names in v.METRIC_WORDS])


def group_by(t: str) -> Column:
    return F.concat(none(), *[given(contains_any(t, words), [name]) for words, name in v.GROUP_WORDS])


def date_range(t: str) -> Column:
    """First day of the smallest year to last day of the largest; null without a year."""
    years = F.regexp_extract_all(F.col(t), F.lit(r"(?U)\b(20[0-9]{2})\b"), F.lit(1))
    return F.when(F.size(years) > 0, F.struct(F.concat(F.array_min(years), F.lit("-01-01")).alias("start_date"),
                                              F.concat(F.array_max(years), F.lit("-12-31")).alias("end_date")))


def _filter(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit("=").alias("operator"), value.alias("value"))


def filters(question: Column, t: str) -> Column:
    """State filters in code order, then the word filters in their fixed order."""
    codes = "|".join(v.STATE_CODES)
    alone = "|".join(c for c in v.STATE_CODES if c not in v.AMBIGUOUS_STATE_CODES)
    named = F.transform(F.regexp_extract_all(question, F.lit(rf"(?iU)\b(?:{v.STATE_PREFIX})\s+({codes})\b"), F.lit(1)),
                        lambda c: F.upper(c))
    bare = F.regexp_extract_all(question, F.lit(rf"(?U)\b({alone})\b"), F.lit(1))
    in_order = F.array_intersect(F.array(*[F.lit(c) for c in v.STATE_CODES]), F.concat(named, bare))
    states = F.transform(in_order, lambda c: _filter("state", c))
    words = [F.when(contains_any(t, w), _filter(field, F.lit(value))) for w, (field, value) in v.FILTER_WORDS]
    support = contains_any(t, v.SUPPORT_WORDS)
    state_of_case = (F.when(support & contains_any(t, v.UNRESOLVED_WORDS), _filter("resolved", F.lit("false")))
                     .when(support & contains_any(t, v.RESOLVED_WORDS), _filter("resolved", F.lit("true"))))
    return F.concat(states, F.filter(F.array(*words, state_of_case), lambda f: f.isNotNull()))


def _has_any(items: Column, names: list[str]) -> Column:
    return F.arrays_overlap(items, F.array(*[F.lit(n) for n in names]))


def _mentions(t: str, metrics_: Column, names: list[str], words: list[str]) -> Column:
    named = _has_any(metrics_, names)
    return named | contains_any(t, words) if words else named


def context(t: str, metrics_: Column) -> Column:
    return ordered_union(none(), *[given(_mentions(t, metrics_, names, words), labels)
                                   for names, words, labels, _ in v.CONTEXT_RULES])


def tables(t: str, metrics_: Column, groups: Column) -> Column:
    by_metric = [given(_mentions(t, metrics_, names, words), found) for names, words, _, found in v.CONTEXT_RULES]
    product = F.array_contains(groups, "category") & ~_has_any(metrics_, v.SUPPORT_METRICS)
    return ordered_union(none(), *by_metric, given(product, v.CATEGORY_TABLES),
                         given(F.array_contains(groups, "state"), v.STATE_TABLES))


def filter_tables(filters_: Column) -> Column:
    """Tables needed to apply the filters, in filter order."""
    lookup = F.create_map(*[F.lit(x) for pair in v.FILTER_TABLES.items() for x in pair])
    return F.array_distinct(F.filter(F.transform(filters_, lambda f: F.element_at(lookup, f["field"])), lambda n: n.isNotNull()))


def normalized(t: str, intent_: Column, metrics_: Column, groups: Column, context_: Column) -> Column:
    text = F.col(t)
    for old, new in v.PHRASES.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    has = F.array_contains
    return (F.when((intent_ == "ranking") & has(metrics_, "on_time_rate"), v.CARRIER_RANKING_FORM)
            .when(has(metrics_, "revenue") & has(groups, "month"), v.MONTHLY_REVENUE_FORM)
            .when(has(context_, "inventario") & has(metrics_, "reorder_point"), v.LOW_STOCK_FORM)
            .otherwise(clean_spaces(text)))


def structure(df: DataFrame, text: str, rules: list[Rule] = RULES) -> DataFrame:
    """Add the structured fields; blank questions are left out (see ``rejected``)."""
    c = F.col
    return (keep_where(df.withColumn("original_question", clean_spaces(c(text))), c("original_question") != "")
            .withColumn("_t", fold(c("original_question")))
            .withColumns({"intent": intent("_t"), "metrics": metrics("_t"), "group_by": group_by("_t"),
                          "filters": filters(c("original_question"), "_t"), "date_range": date_range("_t")})
            .withColumns({"operation": operation("_t", c("intent")), "context": context("_t", c("metrics"))})
            .withColumns({
                "suggested_tables": ordered_union(tables("_t", c("metrics"), c("group_by")), filter_tables(c("filters")),
                                                  rule_tables(c("_t"), rules)),
                "normalized_question": normalized("_t", c("intent"), c("metrics"), c("group_by"), c("context")),
                "optimizer": F.lit("rule_based")})
            .drop("_t"))


def rejected(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.coalesce(clean_spaces(F.col(text)), F.lit("")) == "")


def merge_guess(df: DataFrame, guesses: DataFrame, key: str) -> DataFrame:
    """Combine structured questions with an external guess per question.

    A guess counts only inside the closed lists; a rule-found trend keeps its
    intent, and filters always come from the rules.  Tables are a union.
    """
    c = F.col
    g = guesses.select(key, *[c(n).alias(f"_g_{n}") for n in guesses.columns if n != key])
    listed = lambda x: F.filter(F.transform(F.coalesce(x, none()), lambda i: F.trim(i)), lambda i: i != "")
    either = lambda a, b: F.when(F.size(a) > 0, F.array_distinct(a)).otherwise(b)
    joined = (df.join(g, key, "left").withColumn("_t", fold(c("original_question")))
              .withColumn("_asked", c("_g_intent").isin(v.INTENTS))
              .withColumn("intent", F.when(c("intent") == "temporal_trend", c("intent"))
                          .when(c("_asked"), c("_g_intent")).otherwise(c("intent"))))
    guessed_metrics = F.filter(listed(c("_g_metrics")), lambda i: i.isin(list(METRICS)))
    span = c("_g_date_range")
    first, last = F.trim(span["start_date"]), F.trim(span["end_date"])
    joined = joined.withColumns({
        "operation": F.when(F.trim("_g_operation").isin(list(OPERATIONS)), F.trim("_g_operation"))
        .otherwise(operation("_t", c("intent"))),
        "metrics": either(guessed_metrics, c("metrics")),
        "group_by": either(listed(c("_g_group_by")), c("group_by")),
        "date_range": F.when((F.length(first) > 0) & (F.length(last) > 0),
                             F.struct(first.alias("start_date"), last.alias("end_date"))).otherwise(c("date_range")),
        "normalized_question": F.coalesce(F.nullif(F.trim("_g_normalized_question"), F.lit("")), c("normalized_question")),
    })
    return (joined.withColumn("_own", context("_t", c("metrics")))
            .withColumns({
                "context": either(c("_own"), F.array_distinct(listed(c("_g_context")))),
                "suggested_tables": ordered_union(tables("_t", c("metrics"), c("group_by")),
                                                  listed(c("_g_suggested_tables")), rule_tables(c("_t")),
                                                  filter_tables(c("filters"))),
                "optimizer": F.when(c("_g_intent").isNotNull(), "merged").otherwise(c("optimizer"))})
            .drop("_own", "_t", "_asked", *[n for n in g.columns if n != key]))
