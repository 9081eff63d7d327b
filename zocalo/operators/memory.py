"""Query memory: records, fingerprint, merge, search and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zocalo.functions.hashing import canonical_json, memory_id, sha256
from zocalo.functions.sets import disjoint, subset
from zocalo.functions.text import clean_spaces, fingerprint_form, sql_form, token
from zocalo.operators.filters import keep_where
from zocalo.operators.ranking import best_per_key, top_n_per_key
from zocalo.operators.retrieval import nearest
from zocalo.plans.metrics import METRICS

# Defaults of the memory.
EMBEDDING_VERSION = "query-memory-v2-operation-structure"
DISTANCE_THRESHOLD = 0.08
INSPECTION_THRESHOLD = 0.70
OVERFETCH = 5

AUTHORITATIVE = ("sql", "sources", "status", "execution_status", "model")
DESCRIPTIVE = ("original_question", "normalized_question", "intent", "operation", "metrics", "filters", "date_range",
               "group_by", "context", "embedding_version")


def token_list(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array()), lambda v: token(v)), lambda v: v != "")))


def canonical_filters(x: Column) -> Column:
    """Normalised filters without empty fields or values, sorted by (field, operator, value)."""
    form = F.transform(x, lambda f: F.struct(
        token(f["field"]).alias("field"),
        clean_spaces(F.coalesce(F.nullif(f["operator"], F.lit("")), F.lit("="))).alias("operator"),
        fingerprint_form(f["value"]).alias("value")))
    return F.array_sort(F.filter(form, lambda f: (f["field"] != "") & (f["value"] != "")))


def canonical_range(x: Column) -> Column:
    """Both ends cleaned, or null unless both are given."""
    first, last = clean_spaces(x["start_date"]), clean_spaces(x["end_date"])
    return F.when((F.length(first) > 0) & (F.length(last) > 0), F.struct(first.alias("start_date"), last.alias("end_date")))


def sorted_range(x: Column) -> Column:
    return F.when(x.isNotNull(), F.struct(x["end_date"].alias("end_date"), x["start_date"].alias("start_date")))


def fingerprint() -> Column:
    """Hash of the canonical structure; context and the original wording do not enter."""
    c = F.col
    return sha256(canonical_json(
        date_range=sorted_range(c("date_range")), filters=c("filters"), group_by=c("group_by"), intent=c("intent"),
        metrics=c("metrics"), normalized_question=fingerprint_form(c("normalized_question")), operation=c("operation")))


def build_records(df: DataFrame, now: str) -> DataFrame:
    """Structured questions with their query text -> memory records; ``now`` is the event time column.

    Rows without an original or normalised question are left out.
    """
    c = F.col
    default = lambda name, value: F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(value))
    iso = F.concat(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    named = lambda name: F.coalesce(F.nullif(token(c(name)), F.lit("")), F.lit("detail"))
    cleaned = df.withColumns({"original_question": clean_spaces(c("original_question")),
                              "normalized_question": clean_spaces(c("normalized_question"))})
    return (keep_where(cleaned, (c("original_question") != "") & (c("normalized_question") != ""))
            .withColumns({
                "intent": named("intent"), "operation": named("operation"), "metrics": token_list(c("metrics")),
                "filters": canonical_filters(c("filters")), "date_range": canonical_range(c("date_range")),
                "group_by": token_list(c("group_by")), "context": token_list(c("context")),
                "sql": F.trim("sql"), "sources": F.trim("sources"), "status": default("status", "unknown"),
                "execution_status": default("execution_status", "unknown"), "model": F.trim("model"),
                "usage_count": F.lit(1).cast("bigint"), "retrieval_count": F.lit(0).cast("bigint"),
                "created_at": iso, "updated_at": iso, "last_used_at": F.lit(""), "embedding_version": F.lit(EMBEDDING_VERSION)})
            .withColumn("fingerprint", fingerprint())
            .withColumn("memory_id", memory_id(c("fingerprint"))))


def merge(batch: DataFrame, seq: list[str], store: DataFrame | None = None) -> DataFrame:
    """Fold a batch of records into the store, one row per fingerprint.

    Closed form of the sequential rule "an unvalidated event never replaces the
    query of a validated one": the last validated event wins, else the last event.
    ``seq`` gives the total order of events and is kept with the row, so merging is
    associative: late batches, any partitioning and any grouping give the same
    store.  Copies of a hot fingerprint collapse before the shuffle.
    """
    rows = sequenced(batch, seq)
    if store is not None:
        rows = rows.unionByName(store, allowMissingColumns=True)
    return folded(rows)


def sequenced(batch: DataFrame, seq: list[str]) -> DataFrame:
    """Records with the place of their event."""
    order = F.struct(*seq)
    return batch.withColumns({"authority_seq": order, "latest_seq": order, "first_seq": order})


def folded(rows: DataFrame, *by: str) -> DataFrame:
    """Any mix of sequenced records and merged rows as one row per fingerprint (and ``by``)."""
    merged = rows.groupBy("fingerprint", *by).agg(
        F.max_by(F.struct(*AUTHORITATIVE, "authority_seq"), F.struct("validated", "authority_seq")).alias("_a"),
        F.max_by(F.struct(*DESCRIPTIVE, "updated_at", "latest_seq"), F.col("latest_seq")).alias("_d"),
        F.min_by(F.struct("created_at", "first_seq"), F.col("first_seq")).alias("_f"),
        F.bool_or("validated").alias("validated"), F.sum("usage_count").alias("usage_count"),
        F.sum("retrieval_count").alias("retrieval_count"), F.max("last_used_at").alias("last_used_at"))
    return merged.select("fingerprint", *by, memory_id(F.col("fingerprint")).alias("memory_id"), "_d.*", "_a.*", "_f.*", "validated",
                         "usage_count", "retrieval_count", "last_used_at")


def usable(version: str = EMBEDDING_VERSION) -> Column:
    """Memories a question may learn from."""
    return ((F.col("embedding_version") == version) & F.col("validated") & (F.col("execution_status") == "success"))


def search(queries: DataFrame, memories: DataFrame, n: int, threshold: float = DISTANCE_THRESHOLD, mode: str = "prefilter",
           overfetch: int = OVERFETCH, metric: str = "l2sq", others: bool = False) -> DataFrame:
    """The ``n`` nearest distinct memories per query that pass the quality checks.

    ``prefilter`` compares only usable memories of the same intent and operation whose
    metrics include the question's, so it is complete and works in blocks.
    ``postfilter`` takes the nearest ``overfetch * n`` first and then filters, as the older
    reading did; it may miss memories.  With ``others`` a query never finds its own id.
    """
    asked = queries.select("query_id", F.col("intent").alias("_intent"), F.col("operation").alias("_operation"),
                           F.col("metrics").alias("_metrics"))
    good = memories.filter(usable() & (F.col("fingerprint") != "")).select("memory_id", "fingerprint", "intent", "operation", "metrics")
    if mode == "prefilter":
        pool = memories.filter(usable() & (F.col("fingerprint") != ""))
        found = nearest(queries, pool, n, "query_id", "memory_id", by=["intent", "operation"], metric=metric, mask="metrics",
                        group="fingerprint", within=threshold, others=others)
    elif mode == "postfilter":
        found = nearest(queries, memories, overfetch * n, "query_id", "memory_id", metric=metric, within=threshold, others=others)
    else:
        raise ValueError(f"unknown mode: {mode}")
    checked = (found.filter(F.col("distance") <= threshold).drop("position").join(good, "memory_id").join(asked, "query_id")
               .filter((F.col("intent") == F.col("_intent")) & (F.col("operation") == F.col("_operation"))
                       & subset(F.col("_metrics"), F.col("metrics"))))
    best = best_per_key(checked, ["query_id", "fingerprint"], ["distance", "memory_id"], ["memory_id", "distance"])
    return top_n_per_key(best, ["query_id"], [F.col("distance"), F.col("memory_id")], n)


def structural_key() -> Column:
    """Hash of everything that must be equal for two questions to be compatible."""
    c = F.col
    return sha256(canonical_json(
        date_range=sorted_range(c("date_range")), filters=c("filters"), group_by=c("group_by"), intent=c("intent"),
        metrics=c("metrics"), operation=c("operation")))


def _same_structure(queries: DataFrame, memories: DataFrame, k: int, threshold: float, metric: str, others: bool, group: str | None = None) -> DataFrame:
    """The ``k`` nearest usable memories (of different ``group``) per query with the same structure and an overlapping context.

    Blocked and exact: the structural key is an equality, and the context rule
    (overlap, or either side empty) is one too once both sides are listed under
    their labels.  Only distances inside a block are computed.
    """
    # Memories: under each label and under "all"; those without context under "any" and "all".
    docs = (memories.filter(usable()).withColumn("_key", structural_key())
            .withColumn("_label", F.explode(F.when(F.size("context") > 0, F.concat("context", F.array(F.lit("\u0001all"))))
                                            .otherwise(F.array(F.lit("\u0001any"), F.lit("\u0001all"))))))
    # Queries: each label plus "any"; those without context look at "all".
    asked = (queries.withColumn("_key", structural_key())
             .withColumn("_label", F.explode(F.when(F.size("context") > 0, F.concat("context", F.array(F.lit("\u0001any"))))
                                             .otherwise(F.array(F.lit("\u0001all"))))))
    return nearest(asked, docs, k, "query_id", "memory_id", by=["_key", "_label"], metric=metric, within=threshold, group=group, others=others)


def search_structural(queries: DataFrame, memories: DataFrame, n: int, threshold: float = DISTANCE_THRESHOLD,
                      metric: str = "l2sq", others: bool = False) -> DataFrame:
    """The ``n`` nearest memories with the same structure and an overlapping context."""
    return _same_structure(queries, memories, n, threshold, metric, others)


def search_compatible(queries: DataFrame, memories: DataFrame, n: int, threshold: float = DISTANCE_THRESHOLD,
                      metric: str = "l2sq", mode: str = "prefilter", others: bool = False) -> DataFrame:
    """The ``n`` nearest memories of different fingerprint that agree field by field, with an overlapping context.

    ``prefilter`` compares only such memories, so it finds them all.  ``postfilter`` is the older reading: a wide
    ``search`` whose hits are then compared; it may miss memories.
    """
    if mode == "prefilter":
        good = memories.filter(F.col("fingerprint") != "")
        return _same_structure(queries, good, n, threshold, metric, others, "fingerprint")
    if mode != "postfilter":
        raise ValueError(f"unknown mode: {mode}")
    fields = ("metrics", "filters", "date_range", "group_by", "context")
    wide = search(queries, memories, OVERFETCH * n, threshold, mode="postfilter", metric=metric, others=others).withColumnRenamed("position", "_place")
    theirs = memories.select("memory_id", *[F.col(f).alias(f"_m_{f}") for f in fields])
    mine = queries.select("query_id", *fields)
    same = F.lit(True)
    for f in ("metrics", "filters", "date_range", "group_by"):
        same = same & F.col(f).eqNullSafe(F.col(f"_m_{f}"))
    hits = wide.join(theirs, "memory_id").join(mine, "query_id").filter(same & ~disjoint(F.col("context"), F.col("_m_context")))
    return top_n_per_key(hits.select("query_id", "memory_id", "distance", "_place"), ["query_id"], [F.col("_place")], n).drop("_place")


def inspect(queries: DataFrame, memories: DataFrame, n: int, threshold: float = INSPECTION_THRESHOLD,
            validated: bool | None = None, metric: str = "l2sq", others: bool = False) -> DataFrame:
    """Free search for inspection: nearest candidates within the threshold, usage not recorded."""
    pool = memories if validated is None else memories.filter(F.col("validated") == validated)
    found = nearest(queries, pool, n, "query_id", "memory_id", metric=metric, within=threshold, others=others)
    return top_n_per_key(found.withColumnRenamed("position", "_place"), ["query_id"], [F.col("_place")], n).drop("_place")


def mark_used(store: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Count each memory once per call that retrieved it; unknown ids are ignored."""
    used = (hits.select("call_id", F.trim("memory_id").alias("memory_id")).filter(F.col("memory_id") != "").distinct()
            .groupBy("memory_id").agg(F.count(F.lit(1)).alias("_used")))
    return (store.join(used, "memory_id", "left")
            .withColumn("retrieval_count", F.col("retrieval_count") + F.coalesce("_used", F.lit(0)))
            .withColumn("last_used_at", F.when(F.col("_used").isNotNull(), now).otherwise(F.col("last_used_at"))).drop("_used"))


def match_sql(results: DataFrame, runs: DataFrame) -> DataFrame:
    """First retrieved memory (by position) whose query equals the one that was run."""
    asked = runs.withColumn("_form", sql_form(F.col("sql"))).filter(F.col("_form") != "").select("query_id", "_form")
    known = results.withColumn("_form", sql_form(F.col("sql")))
    hits = known.join(asked, ["query_id", "_form"])
    return best_per_key(hits, ["query_id"], ["position"], ["memory_id", "position"])


def stats(store: DataFrame) -> DataFrame:
    valid = F.count_if(F.col("validated"))
    return store.agg(F.count(F.lit(1)).alias("total"), valid.alias("validated"),
                     (F.count(F.lit(1)) - valid).alias("provisional"),
                     F.coalesce(F.sum("retrieval_count"), F.lit(0)).alias("total_retrievals"))


def examples(results: DataFrame, keep: int = 2) -> DataFrame:
    """The first ``keep`` results as text; numbering counts the ones left out for an empty field."""
    question = F.trim(F.coalesce(F.nullif("normalized_question", F.lit("")), "original_question"))
    sources = F.coalesce(F.nullif(F.trim("sources"), F.lit("")), F.lit("not specified"))
    text = F.concat_ws("\n", F.concat(F.lit("Example "), F.col("position").cast("string"), F.lit(":")), F.concat(F.lit("Question: "), question),
                       F.concat(F.lit("Validated SQL: "), F.trim("sql")), F.concat(F.lit("Sources: "), sources))
    return (results.filter((F.col("position") <= keep) & (question != "") & (F.trim("sql") != ""))
            .select("query_id", "position", text.alias("example")))


def document_text() -> Column:
    """The text of a record that is embedded; query text and technical fields stay out."""
    c = F.col
    items = lambda name, empty: F.when(F.size(name) > 0, F.array_join(name, ", ")).otherwise(empty)
    lines = [("Pregunta normalizada: ", c("normalized_question")), ("Intención: ", c("intent")), ("Operación: ", c("operation")),
             ("Métricas: ", items("metrics", "ninguna")),
             ("Filtros: ", F.when(F.size("filters") > 0, F.to_json("filters")).otherwise("ninguno")),
             ("Rango de fechas: ", F.coalesce(F.to_json(sorted_range(c("date_range"))), F.lit("ninguno"))),
             ("Agrupaciones: ", items("group_by", "ninguna")), ("Contexto: ", items("context", "ninguno"))]
    return F.concat_ws("\n", *[F.concat(F.lit(label), value) for label, value in lines])
