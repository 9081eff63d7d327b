"""From a structured question to the DataFrame that answers it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

from zocalo.operators.structuring import structure
from zocalo.plans.marketplace import Marketplace
from zocalo.plans.metrics import COUNTS, GROUPINGS, METRICS, OPERATIONS, MetricSpec, metric_query

#: Operations that take one metric; of a question that names several, the first one is ranked, compared or halved.
SINGLE = ("rank_desc", "rank_asc", "rank_nearest_average", "compare", "median", "detail")


def spec_of(found: Row) -> MetricSpec:
    """The metric query that a structured question asks for.

    Only what the closed lists hold is taken over; a question that names no metric, or a filter that is no equality, is refused. Several metrics of
    a sum, average or count are answered together; an operation that a metric cannot have (the sum of a count, the average of one
    without a grouping, a comparison without values) gives way to the metric's own aggregate.
    """
    metrics = tuple(name for name in found["metrics"] or () if name in METRICS)
    if not metrics:
        raise ValueError(f"no known metric in: {found['original_question']}")
    groups = tuple(name for name in found["group_by"] or () if name in GROUPINGS)
    operation = found["operation"] if found["operation"] in OPERATIONS else None
    if found["intent"] == "temporal_trend" and operation == "detail":
        operation = None
    if operation in SINGLE:
        metrics = metrics[:1]
    counted = any(METRICS[name].aggregate in COUNTS for name in metrics)
    if operation == "compare" or counted and (operation == "average" and (len(metrics) > 1 or not groups) or operation == "median" and not groups):
        operation = None
    for f in found["filters"] or ():
        if f["operator"] != "=":
            raise ValueError(f"unknown operator: {f['operator']}")
    span = found["date_range"]
    return MetricSpec(metrics if len(metrics) > 1 else metrics[0], operation, groups, tuple((f["field"], f["value"]) for f in found["filters"] or ()),
                      (span["start_date"], span["end_date"]) if span else None)


def answer(market: Marketplace, question: str) -> DataFrame:
    """The answer to a question in free text, as a table.

    The question is structured by the same columns that structure whole tables of them; a blank one is refused.
    """
    found = structure(market.spark.createDataFrame([(question,)], "question string"), "question").first()
    if found is None:
        raise ValueError("an empty question")
    return metric_query(market, spec_of(found))
