"""Evaluation of answers and results against reference cases."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import groupby
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zocalo.functions.numbers import ANSWER_NUMBER, MONTH, UUID, number_from_text, readings, uuid_form
from zocalo.functions.sets import name_set, split_names
from zocalo.functions.sqltext import read_only
from zocalo.functions.text import casefold, compare_form
from zocalo.operators.graphs import connected, kept

# Classes of a reference validation, thresholds of the sweep.
CLASSES = ["correct", "golden_set_outdated", "reference_sql_error"]
LARGE_CASE = 2000  # rows up to which a case is matched as one group; not a fixed value
THRESHOLDS = [0.00, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.10, 0.12, 0.15, 0.20, 0.30, 0.50, 1.00, 2.00]


def status_matches(actual: Column, expected: Column) -> Column:
    return actual.eqNullSafe(expected)


def sources_match(reported: Column, expected: Column) -> Column:
    """Comma list against list, as sets, trimmed and case-folded."""
    return name_set(split_names(reported), casefold) == name_set(expected, casefold)


# --- result facts -----------------------------------------------------------------------------

def _with_forms(rows: DataFrame, *others: str) -> DataFrame:
    """Long rows (case_id, row_no, pos, value) with the forms values are compared in, and ``others`` as they are."""
    v = F.col("value")
    return rows.select("case_id", *others, "row_no", F.col("pos").cast("int").alias("pos"), v.alias("raw"), number_from_text(v).cast("double").alias("number"),
                       uuid_form(v).alias("uuid"), F.trim(v).alias("trimmed"), compare_form(v).alias("form"),
                       F.coalesce(F.trim(v).rlike(MONTH), F.lit(False)).alias("month"))


class _Value(NamedTuple):
    row_no: int
    pos: int
    raw: str | None
    number: float
    uuid: str | None
    trimmed: str | None
    form: str | None
    month: bool


def _same(actual: _Value, expected: _Value, tolerance: float) -> bool:
    if expected.raw is None or actual.raw is None:
        return expected.raw is None and actual.raw is None
    if not (math.isnan(actual.number) or math.isnan(expected.number)):
        return round(abs(actual.number - expected.number), 9) <= tolerance
    if actual.uuid is not None and expected.uuid is not None:
        return actual.uuid == expected.uuid
    if expected.month:
        return actual.trimmed.startswith(expected.trimmed)
    return actual.form == expected.form


def _take_first(candidates: list, accepts) -> bool:
    """Remove the first candidate that is accepted; greedy on purpose."""
    for place, candidate in enumerate(candidates):
        if accepts(candidate):
            del candidates[place]
            return True
    return False


def _rows_of(values: list[_Value]) -> list[list[_Value]]:
    return [list(row) for _, row in groupby(values, key=lambda v: v.row_no)]


def _sorted_values(pdf: pd.DataFrame) -> list[_Value]:
    return sorted(map(_Value._make, zip(*(pdf[name].to_list() for name in _Value._fields))), key=lambda v: v[:2])


def _places(value: _Value, width: float) -> list[tuple]:
    """Where an actual value is filed: any expected value that it may equal looks in one of these places."""
    if value.raw is None:
        return [("null",)]
    places = [("form", value.form), ("month", (value.trimmed or "")[:7])]
    if not math.isnan(value.number):
        places.append(("number", math.floor(value.number / width) if math.isfinite(value.number) else value.number))
    if value.uuid is not None:
        places.append(("uuid", value.uuid))
    return places


def _looks(value: _Value, width: float) -> list[tuple]:
    if value.raw is None:
        return [("null",)]
    places = [("month", (value.trimmed or "")[:7])] if value.month else [("form", value.form)]
    if not math.isnan(value.number):
        near = math.floor(value.number / width) if math.isfinite(value.number) else None
        places += [("number", value.number)] if near is None else [("number", near + d) for d in (-1, 0, 1)]
    if value.uuid is not None:
        places.append(("uuid", value.uuid))
    return places


def _greedy_match(tolerance: float, rows: list[list[_Value]], expected: list[list[_Value]]) -> bool:
    """First fit in row order, as defined; each expected row looks only at actual rows that may hold its rarest value."""
    width = tolerance + 1e-8  # wider than any difference that still counts as equal
    filed: dict[tuple, list[int]] = defaultdict(list)
    for n, row in enumerate(rows):
        for place in {p for value in row for p in _places(value, width)}:
            filed[place].append(n)
    taken = [False] * len(rows)
    first: dict[tuple, int] = {}  # rows of a place before this one are all taken

    def candidates(place: tuple) -> list[int]:
        own, start = filed[place], first.get(place, 0)
        while start < len(own) and taken[own[start]]:
            start += 1
        first[place] = start
        return own[start:]

    def holds(row: list[_Value], wanted: list[_Value]) -> bool:
        values = list(row)
        return all(_take_first(values, lambda a, e=e: _same(a, e, tolerance)) for e in wanted)

    def found(wanted: list[_Value]) -> bool:
        options = [[p for p in _looks(e, width) if p in filed] for e in wanted]
        rarest = min(options, key=lambda places: sum(len(filed[p]) for p in places), default=None)
        able = range(len(rows)) if rarest is None else sorted({n for p in rarest for n in candidates(p)})
        for n in able:
            if not taken[n] and holds(rows[n], wanted):
                taken[n] = True
                return True
        return False

    return all(found(w) for w in expected)


def _match_part(key: tuple, actual: pd.DataFrame, expected: pd.DataFrame) -> pd.DataFrame:
    """One component of a large case."""
    matched = _greedy_match(key[1], _rows_of(_sorted_values(actual)), _rows_of(_sorted_values(expected)))
    return pd.DataFrame({"case_id": [key[0]], "matched": [matched]})


#: Kinds of rows in the scan of small cases, in their order.
ASKED, ACTUAL, EXPECTED = 0, 1, 2


def _scan_cases(batches):
    """Matches case after case as sorted rows come by: what is asked, the actual and the expected values. Cases not asked about pass unread."""
    case, tolerance, values = None, None, {}
    done: list[tuple] = []

    def finish() -> None:
        if tolerance is not None:
            done.append((case, _greedy_match(tolerance, _rows_of(values[ACTUAL]), _rows_of(values[EXPECTED]))))

    kind = None
    for batch in batches:
        kind = batch.schema.field("case_id").type
        ids, sides, tolerances = (batch.column(c).to_pylist() for c in ("case_id", "_side", "_tolerance"))
        fields = [batch.column(c).to_pylist() for c in _Value._fields]
        for n, (own, side) in enumerate(zip(ids, sides)):
            if side == ASKED:
                finish()
                case, tolerance, values = own, tolerances[n], {ACTUAL: [], EXPECTED: []}
            elif tolerance is not None and own == case:
                number = fields[3][n]
                values[side].append(_Value(fields[0][n], fields[1][n], fields[2][n], math.nan if number is None else number, *(f[n] for f in fields[4:])))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([m for _, m in done], pa.bool_())], ["case_id", "matched"])
            done.clear()
    finish()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([m for _, m in done], pa.bool_())], ["case_id", "matched"])


def _place_columns(looking: bool) -> Column:
    """``_places`` of an actual value, or ``_looks`` of an expected one, as a list of texts. Very large numbers share a place."""
    c = F.col
    step = F.floor(F.when(F.abs(c("number") / c("_width")) < 1e15, c("number") / c("_width")))
    has = c("number").isNotNull() & ~F.isnan("number")
    number = lambda d: F.concat(F.lit("number "), F.coalesce((step + d).cast("string"), F.lit("large")))
    month = F.concat(F.lit("month "), F.substring(F.coalesce("trimmed", F.lit("")), 1, 7))
    form = F.concat(F.lit("form "), F.coalesce("form", F.lit("")))
    numbers = F.when(has, F.array_distinct(F.array(*[number(d) for d in ((-1, 0, 1) if looking else (0,))]))).otherwise(F.array())
    uuid = F.when(c("uuid").isNotNull(), F.array(F.concat(F.lit("uuid "), "uuid"))).otherwise(F.array())
    texts = F.when(c("month"), F.array(month)).otherwise(F.array(form)) if looking else F.array(form, month)
    return F.when(c("raw").isNull(), F.array(F.lit("null"))).otherwise(F.concat(texts, numbers, uuid))


def _components(actual: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long rows with the component of the candidate graph that their row lies in, as ``_part``.

    An expected row is linked to the places of its rarest value, and those to the actual rows filed there, which are all that can hold
    that value.  Rows of different components can never match, so each component is matched by itself.
    """
    node = lambda kind, what: F.xxhash64("case_id", F.lit(kind), what)
    filed = actual.select("case_id", "row_no", F.explode(_place_columns(False)).alias("place")).distinct()
    sizes = filed.groupBy("case_id", "place").agg(F.count(F.lit(1)).alias("_size"))
    looks = expected.select("case_id", "row_no", "pos", F.explode(_place_columns(True)).alias("place")).join(sizes, ["case_id", "place"], "left")
    options = looks.groupBy("case_id", "row_no", "pos").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_all"), F.collect_list("place").alias("_where"))
    rarest = options.groupBy("case_id", "row_no").agg(F.min_by("_where", F.struct("_all", "pos")).alias("_where"))
    wanted = rarest.select("case_id", "row_no", F.explode("_where").alias("place"))
    links = wanted.select(node("expected", "row_no").alias("a"), node("place", "place").alias("b")).union(
        filed.join(wanted.select("case_id", "place").distinct(), ["case_id", "place"]).select(node("actual", "row_no").alias("a"), node("place", "place").alias("b")))
    parts = connected(links).select(F.col("node").alias("_node"), F.col("root").alias("_part"))
    named = lambda df, kind: df.withColumn("_node", node(kind, "row_no")).join(parts, "_node").drop("_node")
    return named(actual, "actual"), named(expected, "expected")


def result_facts(cases: DataFrame, actual: DataFrame, expected: DataFrame, large: int = LARGE_CASE) -> DataFrame:
    """Whether each expected row finds its own actual row that holds all its values.

    ``cases`` has (case_id, tolerance), the row tables (case_id, row_no, pos, value).
    Names, order and extra columns do not matter; matching is greedy first fit on
    both levels.  Row counts are compared first, so a case is only looked at if it has as many rows as expected.
    Cases of up to ``large`` rows are matched one after the other in a sorted scan; a larger one falls into the components of its candidate
    graph, each a group of its own, in which the order and so the result of the greedy matching is the same.
    """
    distinct = lambda df, own: df.select("case_id", "row_no").distinct().groupBy("case_id").agg(F.count("row_no").alias(own))
    sizes = distinct(actual, "_a").withColumn("_e", F.lit(0)).unionByName(distinct(expected, "_e").withColumn("_a", F.lit(0)))
    sizes = sizes.groupBy("case_id").agg(F.sum("_a").alias("_a"), F.sum("_e").alias("_e"))
    counted = kept(cases.select("case_id", "tolerance").join(sizes, "case_id", "left").fillna(0, ["_a", "_e"]), "cases")
    fitting = counted.filter((F.col("_a") == F.col("_e")) & (F.col("_a") > 0))
    kinds = {c: actual.schema[c].dataType.simpleString() for c in ("row_no", "value")}

    def side(df: DataFrame, number: int) -> DataFrame:
        return df.select("case_id", F.lit(number).alias("_side"), F.lit(None).cast("double").alias("_tolerance"), "row_no", F.col("pos").cast("int").alias("pos"), "value")

    small = fitting.filter(F.col("_a") <= large)
    asked = small.select("case_id", F.lit(ASKED).alias("_side"), F.col("tolerance").cast("double").alias("_tolerance"), F.lit(None).cast(kinds["row_no"]).alias("row_no"),
                         F.lit(None).cast("int").alias("pos"), F.lit(None).cast(kinds["value"]).alias("value"))
    lined = asked.unionByName(side(actual, ACTUAL)).unionByName(side(expected, EXPECTED)).filter(F.col("case_id").isNotNull())
    placed = lined.repartition("case_id").sortWithinPartitions("case_id", "_side", "row_no", "pos")
    kind = cases.schema["case_id"].dataType.simpleString()
    matched = _with_forms(placed, "_side", "_tolerance").mapInArrow(_scan_cases, f"case_id {kind}, matched boolean")
    if fitting.filter(F.col("_a") > large).limit(1).count():
        many = fitting.filter(F.col("_a") > large).select("case_id", "tolerance", (F.col("tolerance") + 1e-8).alias("_width"))
        fresh = lambda df: df.toDF(*df.columns)  # fresh column ids: both sides may share a source
        a, e = _components(*[fresh(_with_forms(df).join(many, "case_id")) for df in (actual, expected)])
        by = ["case_id", "tolerance", "_part"]
        parts = fresh(a).groupBy(*by).cogroup(fresh(e).groupBy(*by)).applyInPandas(_match_part, f"case_id {kind}, matched boolean")
        matched = matched.unionByName(parts.groupBy("case_id").agg(F.bool_and("matched").alias("matched")))
    return (counted.join(matched, "case_id", "left")
            .select("case_id", F.coalesce("matched", (F.col("_a") == 0) & (F.col("_e") == 0)).alias("matched")))


def result_multiset_equal(cases: DataFrame, actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Tolerance-0 reading without Python: equal multisets of canonical rows."""
    def canonical(df: DataFrame, sign: int) -> DataFrame:
        form = _with_forms(df)
        value = F.coalesce(F.col("number").cast("string"), F.col("uuid"), F.col("form"), F.lit("\u0001null"))
        row = F.array_join(F.array_sort(F.collect_list("_v")), "\u0002").alias("_row")  # values of one row
        return (form.withColumn("_v", value).groupBy("case_id", "row_no").agg(row)
                .groupBy("case_id", "_row").agg((F.count(F.lit(1)) * sign).alias("_n")))
    off = (canonical(actual, 1).unionByName(canonical(expected, -1)).groupBy("case_id", "_row").agg(F.sum("_n").alias("_n"))
           .filter(F.col("_n") != 0).select("case_id").distinct().withColumn("_off", F.lit(True)))
    return cases.select("case_id").join(off, "case_id", "left").select("case_id", F.col("_off").isNull().alias("matched"))


# --- answer facts -----------------------------------------------------------------------------

def answer_facts(cases: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether the answer text states every expected value; nothing expected is true, no text false.

    The readings of the numbers in a text are found once per answer, and each
    expected value then looks into its own answer's list.
    """
    answer = F.coalesce(F.col("answer"), F.lit(""))
    numbers = F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(f"({ANSWER_NUMBER})"), F.lit(1)), readings))
    ids = F.transform(F.regexp_extract_all(answer, F.lit(rf"(\b(?:{UUID})\b)"), F.lit(1)),
                      lambda u: F.lower(F.replace(u, F.lit("-"), F.lit(""))))
    texts = cases.select("case_id", F.col("tolerance").cast("decimal(38,10)").alias("_tol"), (F.trim(answer) != "").alias("_said"),
                         numbers.alias("_numbers"), ids.alias("_ids"), compare_form(answer).alias("_text"))
    v = F.col("value")
    facts = expected.select("case_id", v.alias("_raw"), number_from_text(v).alias("_n"), uuid_form(v).alias("_u"), compare_form(v).alias("_f"))
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("_f"), F.lit(r"\E(?!\w)"))
    stated = (F.when(F.col("_n").isNotNull(), F.exists("_numbers", lambda c: F.abs(c - F.col("_n")) <= F.col("_tol")))
              .when(F.col("_u").isNotNull(), F.array_contains("_ids", F.col("_u")))
              .when(F.length("_f") <= 3, F.regexp_like("_text", quoted))
              .otherwise(F.contains("_text", F.col("_f"))))
    missing = (facts.join(texts, "case_id").withColumn("_ok", stated).groupBy("case_id").agg(F.bool_and("_ok").alias("_all")))
    return (texts.select("case_id", "_said").join(missing, "case_id", "left")
            .select("case_id", (F.col("_said") & F.coalesce("_all", F.lit(True))).alias("stated")))


def reference_class(sql: Column, error: Column, matched: Column, expected_rows: Column, actual_rows: Column,
                    first_difference: Column) -> tuple[Column, Column]:
    """(class, reason) of a reference query that was run again."""
    label = (F.when(~read_only(sql) | error.isNotNull(), CLASSES[2]).when(matched, CLASSES[0]).otherwise(CLASSES[1]))
    reason = (F.when(~read_only(sql), "not read-only").when(error.isNotNull(), error).when(matched, "match")
              .when(expected_rows != actual_rows, F.concat(F.lit("row count: expected="), expected_rows.cast("string"),
                                                           F.lit(", actual="), actual_rows.cast("string")))
              .when(first_difference.isNotNull(), F.concat(F.lit("row differs: "), first_difference.cast("string")))
              .otherwise("tolerance"))
    return label, reason


# --- threshold calibration --------------------------------------------------------------------

def threshold_sweep(cases: DataFrame, candidates: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Retrieval quality at every threshold in one pass.

    What a case contributes only ever switches on as the threshold grows, so each
    contribution is counted at the first threshold that includes it and the counts
    are summed up.  Nothing is multiplied by the number of thresholds.
    """
    steps = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    step_of = lambda d: F.when(d.isNotNull(), F.size(F.filter(steps, lambda t: t < d)))
    order = Window.partitionBy("case_id").orderBy("distance", "key")
    c = F.col
    right = c("key").eqNullSafe(c("expected")) & c("expected").isNotNull()
    ranked = (candidates.join(cases.select("case_id", "expected"), "case_id").withColumn("_r", F.row_number().over(order))
              .withColumn("_right", right))
    pick = lambda cond: F.min(F.when(cond, c("distance")))
    per_case = ranked.groupBy("case_id", "expected").agg(
        pick((c("_r") == 1) & c("_right")).alias("hits_at_1"), pick((c("_r") <= 3) & c("_right")).alias("hits_at_3"),
        pick(c("expected").isNull()).alias("false_positives"), pick(~c("_right")).alias("cases_with_wrong_candidates"))
    events = [per_case.select(F.lit(name).alias("kind"), step_of(c(name)).alias("step"))
              for name in ("hits_at_1", "hits_at_3", "false_positives", "cases_with_wrong_candidates")]
    events.append(ranked.select(F.when(c("_right"), "correct_candidates").otherwise("wrong_candidates").alias("kind"),
                                step_of(c("distance")).alias("step")))
    all_events = events[0]
    for more in events[1:]:
        all_events = all_events.unionByName(more)
    kinds = ["hits_at_1", "hits_at_3", "false_positives", "correct_candidates", "wrong_candidates", "cases_with_wrong_candidates"]
    per_step = (all_events.filter(c("step").isNotNull() & (c("step") < len(thresholds))).groupBy("step")
                .agg(*[F.count_if(c("kind") == k).alias(k) for k in kinds]))
    listed = cases.sparkSession.range(1).select(F.posexplode(steps).alias("step", "threshold"))
    upto = Window.partitionBy(F.lit(1)).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per threshold
    running = (listed.join(per_step, "step", "left").fillna(0, kinds)
               .select("threshold", *[F.sum(k).over(upto).alias(k) for k in kinds]))
    sizes = cases.agg(F.count("expected").alias("positive_cases"), F.count_if(c("expected").isNull()).alias("negative_cases"))
    ratio = lambda a, b, empty: F.when(b > 0, a / b).otherwise(F.lit(empty))
    total = c("correct_candidates") + c("wrong_candidates")
    return (running.join(F.broadcast(sizes))  # one row
            .withColumns({"recall_at_1": ratio(c("hits_at_1"), c("positive_cases"), 0.0),
                          "recall_at_3": ratio(c("hits_at_3"), c("positive_cases"), 0.0),
                          "candidate_precision": ratio(c("correct_candidates"), total, 1.0),
                          "false_positive_rate": ratio(c("false_positives"), c("negative_cases"), 0.0)}))


def margin(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Largest distance of a right candidate, smallest of a wrong one, their gap and midpoint."""
    right = F.coalesce(F.col("key") == F.col("expected"), F.lit(False))
    both = candidates.join(cases.select("case_id", "expected"), "case_id")
    hi, lo = F.col("maximum_positive_distance"), F.col("minimum_wrong_distance")
    return (both.agg(F.max(F.when(right, F.col("distance"))).alias("maximum_positive_distance"),
                     F.min(F.when(~right, F.col("distance"))).alias("minimum_wrong_distance"))
            .withColumns({"semantic_margin": lo - hi, "midpoint_threshold": (lo + hi) / 2}))


def recommend(sweep: DataFrame, margins: DataFrame) -> DataFrame:
    """The midpoint when the margin is positive, else the smallest of the best thresholds."""
    score = F.struct("recall_at_1", "candidate_precision", "recall_at_3", (-F.col("false_positive_rate")).alias("fp"))
    best = sweep.agg(F.max(F.struct(score.alias("s"), (-F.col("threshold")).alias("t"))).alias("_b")).select((-F.col("_b.t")).alias("_best"))
    clear = F.col("semantic_margin") > 0
    return (best.join(F.broadcast(margins))  # one row each
            .select(F.when(clear, F.bround("midpoint_threshold", 3)).otherwise(F.col("_best")).alias("threshold")))


# --- sets of cases ----------------------------------------------------------------------------

def sync_status(local: DataFrame, stored: DataFrame, key: str, fields: list[str], prune: bool = False) -> DataFrame:
    """created / updated / unchanged / remote_only (deleted when pruning) per case."""
    digest = F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    a = local.select(key, digest.alias("_a"))
    b = stored.select(key, digest.alias("_b"))
    label = (F.when(F.col("_b").isNull(), "created").when(F.col("_a").isNull(), "deleted" if prune else "remote_only")
             .when(F.col("_a") == F.col("_b"), "unchanged").otherwise("updated"))
    return a.join(b, key, "full").select(key, label.alias("status"))


def content_hash(df: DataFrame, position: str, content: Column, width: int = 1024, levels: int = 7) -> DataFrame:
    """One digest over all rows in position order.

    A tree of digests: ``width`` neighbours are hashed together level by level; seven levels hold every bigint position.
    The first two levels are folded where rows are dealt by their second-level group, all others, a millionth of the
    rows, after one more shuffle, so the table is shuffled once and no hash holds more than ``width`` others.
    """
    rows = df.select(F.col(position).alias("p"), F.sha2(content, 256).alias("h"))
    for first, last in ((1, min(2, levels)), (3, levels)):
        span = range(first, last + 1)
        if not len(span):
            break
        above = [f"_g{n}" for n in span]
        rows = rows.select("p", "h", *[F.expr(f"(p - pmod(p, {width ** (n - first + 1)}L)) div {width ** (n - first + 1)}L").alias(f"_g{n}") for n in span]).repartition(above[-1])
        at = "p"
        for n, own in enumerate(above):
            # rows of a group lie together already, so these aggregates move nothing
            ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("p"), "h")))
            rows = rows.groupBy(*above[n:]).agg(ordered.alias("o")).select(*above[n:], F.sha2(F.array_join(F.col("o.h"), ""), 256).alias("h"))
            at = own
        rows = rows.select(F.col(above[-1]).alias("p"), "h")
    return rows.select(F.col("h").alias("content_sha256"))


def run_delta(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Change of a value between two runs."""
    a = first.select(*keys, F.col(value).alias("before"))
    b = second.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys, "full").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))
