"""Query memory, vector retrieval and hybrid lookup (X07-X09, X22, M, J08-J11, J18, W01-W02, T04-T05, U04-U05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zocalo.functions import hashing, sets
from zocalo.operators import memory, ranking, retrieval
from zocalo.operators.filters import keep_where
from zocalo.plans.marketplace import pick
from zocalo.queries import sqltext as s
from zocalo.queries.registry import query
from zocalo.queries.text_queries import FILTER_TEXT, filter_text, joined, structured
from zocalo.queries.views import sql_pick, view

# --- hashes -----------------------------------------------------------------------------------


@query("X07_hash_canonical_json", """
SELECT order_id, payload, sha256(payload) AS digest FROM (
  SELECT order_id, CAST(to_json({'customer': customer_id, 'items': [order_status, payment_type],
         'note': CASE WHEN order_id % 3 = 0 THEN 'Línea "' || payment_type || '"' END}) AS VARCHAR) AS payload FROM m_orders)""")
def _(m):
    note = F.when(F.col("order_id") % 3 == 0, F.concat(F.lit('Línea "'), F.col("payment_type"), F.lit('"')))
    payload = hashing.canonical_json(note=note, items=F.array("order_status", "payment_type"), customer=F.col("customer_id"))
    return m.orders().select("order_id", payload.alias("payload")).withColumn("digest", hashing.sha256(F.col("payload")))


@query("X08_hash_memory_id", "SELECT vec_id, 'query-memory-v2-' || substr(sha256('q' || vec_id), 1, 32) AS memory_id FROM embeddings")
def _(m):
    digest = hashing.sha256(F.concat(F.lit("q"), F.col("vec_id").cast("string")))
    return m.raw("embeddings").select("vec_id", hashing.memory_id(digest).alias("memory_id"))


@query("X09_hash_case_id", f"""
SELECT order_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
       substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS case_id
FROM (SELECT order_id, sha1(unhex('{hashing.CASE_NAMESPACE.replace('-', '')}') || encode('golden:case_' || order_id)) AS h FROM m_orders)""")
def _(m):
    case = F.concat(F.lit("case_"), F.col("order_id").cast("string"))
    return m.orders().select("order_id", hashing.case_id(F.lit("golden"), case).alias("case_id"))


# --- records and merge ------------------------------------------------------------------------

view("m_events", f"""
SELECT *, CAST(substr(question_id, 2) AS BIGINT) AS seq FROM m_structured WHERE asked_at IS NOT NULL""")
view("m_records", """
SELECT question_id, seq, asked_at, original_question, normalized_question, intent, operation, list_sort(list_distinct(metrics)) AS metrics,
       list_sort(list_transform(filters, lambda f: {'field': f.field, 'operator': f.operator, 'value': lower(f.value)})) AS filters,
       CASE WHEN start_date IS NOT NULL THEN {'end_date': end_date, 'start_date': start_date} END AS date_range,
       list_sort(list_distinct(group_by)) AS group_by, list_sort(list_distinct(context)) AS context,
       'SELECT ' || (seq % 50) || ';' AS sql, 'orders, t' || (seq % 3) AS sources, CASE WHEN seq % 4 = 0 THEN 'unknown' ELSE 'success' END AS status,
       seq % 3 = 0 AS validated, CASE WHEN seq % 3 = 0 THEN 'success' ELSE 'not_executed' END AS execution_status, 'm' || (seq % 2) AS model,
       strftime(asked_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp
FROM m_events""")
view("m_hashed", f"""
SELECT *, sha256(CAST(to_json({{'date_range': date_range, 'filters': filters, 'group_by': group_by, 'intent': intent, 'metrics': metrics,
       'normalized_question': {s.fingerprint_form('normalized_question')}, 'operation': operation}}) AS VARCHAR)) AS fingerprint FROM m_records""")


def records(m):
    """One memory event per order question."""
    asked = structured(m).filter(F.col("asked_at").isNotNull()).withColumn("seq", F.substring("question_id", 2, 30).cast("bigint"))
    seq = F.col("seq")
    text = lambda head, value, tail="": F.concat(F.lit(head), value.cast("string"), F.lit(tail))
    return memory.build_records(asked.withColumns({
        "sql": text(" SELECT ", seq % 50, ";"), "sources": text("orders, t", seq % 3, " "),
        "status": F.when(seq % 4 == 0, " ").otherwise("success"), "validated": seq % 3 == 0,
        "execution_status": F.when(seq % 3 == 0, "success").otherwise("not_executed"), "model": text("m", seq % 2)}), "asked_at")


@query("M01_mem_build_record", f"""
SELECT question_id, original_question, normalized_question, intent, operation, array_to_string(metrics, ',') AS metrics, {FILTER_TEXT} AS filters,
       date_range.start_date AS start_date, date_range.end_date AS end_date, array_to_string(group_by, ',') AS group_by,
       array_to_string(context, ',') AS context, sql, trim(sources) AS sources, status, validated, execution_status, model, stamp AS created_at
FROM m_records""")
def _(m):
    return records(m).select("question_id", "original_question", "normalized_question", "intent", "operation", joined("metrics").alias("metrics"),
                             filter_text().alias("filters"), "date_range.start_date", "date_range.end_date",
                             joined("group_by").alias("group_by"), joined("context").alias("context"), "sql", "sources", "status",
                             "validated", "execution_status", "model", "created_at")


@query("M02_mem_fingerprint", "SELECT question_id, fingerprint FROM m_hashed")
def _(m):
    return records(m).select("question_id", "fingerprint")


MERGED_SQL = """
SELECT fingerprint, 'query-memory-v2-' || substr(fingerprint, 1, 32) AS memory_id, count(*) AS usage_count, bool_or(validated) AS validated,
       arg_max(sql, seq + CASE WHEN validated THEN 1000000000000 ELSE 0 END) AS sql,
       arg_max(sources, seq + CASE WHEN validated THEN 1000000000000 ELSE 0 END) AS sources,
       arg_max(status, seq + CASE WHEN validated THEN 1000000000000 ELSE 0 END) AS status,
       arg_max(execution_status, seq + CASE WHEN validated THEN 1000000000000 ELSE 0 END) AS execution_status,
       arg_max(model, seq + CASE WHEN validated THEN 1000000000000 ELSE 0 END) AS model,
       arg_max(original_question, seq) AS original_question, arg_max(array_to_string(context, ','), seq) AS context,
       arg_min(stamp, seq) AS created_at, arg_max(stamp, seq) AS updated_at FROM m_hashed GROUP BY fingerprint"""


def merged_flat(df):
    return df.select("fingerprint", "memory_id", "usage_count", "validated", "sql", "sources", "status", "execution_status", "model",
                     "original_question", joined("context").alias("context"), "created_at", "updated_at")


@query("M03_mem_upsert_merge", MERGED_SQL)
def _(m):
    # The store holds the first events and the batch brings the others; both are folded in one pass over the records.
    parts = memory.folded(memory.sequenced(records(m), ["seq"]).withColumn("early", F.col("seq") < 5000), "early")
    return merged_flat(memory.folded(parts.drop("early")))


@query("X22_txt_memory_document", f"""
SELECT question_id, concat_ws(chr(10), 'Pregunta normalizada: ' || normalized_question, 'Intención: ' || intent, 'Operación: ' || operation,
  'Métricas: ' || CASE WHEN len(metrics) > 0 THEN array_to_string(metrics, ', ') ELSE 'ninguna' END,
  'Filtros: ' || CASE WHEN len(filters) > 0 THEN CAST(to_json(filters) AS VARCHAR) ELSE 'ninguno' END,
  'Rango de fechas: ' || CASE WHEN date_range IS NOT NULL THEN CAST(to_json(date_range) AS VARCHAR) ELSE 'ninguno' END,
  'Agrupaciones: ' || CASE WHEN len(group_by) > 0 THEN array_to_string(group_by, ', ') ELSE 'ninguna' END,
  'Contexto: ' || CASE WHEN len(context) > 0 THEN array_to_string(context, ', ') ELSE 'ninguno' END) AS document FROM m_records""")
def _(m):
    return records(m).select("question_id", memory.document_text().alias("document"))


@query("T05_srt_canonical_filters", f"SELECT question_id, {FILTER_TEXT} AS filters FROM m_records WHERE len(filters) > 1")
def _(m):
    return keep_where(records(m), F.size("filters") > 1).select("question_id", filter_text().alias("filters"))


@query("M09_mem_stats", """
SELECT count(*) AS total, count(*) FILTER (WHERE v) AS validated, count(*) FILTER (WHERE NOT v) AS provisional,
       CAST(sum(n % 5) AS BIGINT) AS total_retrievals FROM (SELECT fingerprint, bool_or(validated) AS v, count(*) AS n FROM m_hashed GROUP BY fingerprint)""")
def _(m):
    store = memory.merge(records(m), ["seq"])
    return memory.stats(store.withColumn("retrieval_count", F.col("usage_count") % 5))


# --- vectors ----------------------------------------------------------------------------------

CONTEXTS = ["CAST([] AS VARCHAR[])", "['ventas']", "['ventas', 'logistica']", "['logistica']"]
INTENTS, OPERATIONS = ["ranking", "count"], ["sum", "average"]
view("m_vectors", f"""
SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding, 'f' || (vec_id // 3) AS fingerprint, vec_id % 7 <> 0 AS validated,
       CASE WHEN vec_id % 11 = 0 THEN 'error' ELSE 'success' END AS execution_status, {sql_pick(INTENTS, 'label')} AS intent,
       {sql_pick(OPERATIONS, 'label // 2')} AS operation,
       CASE label % 3 WHEN 0 THEN ['revenue'] WHEN 1 THEN ['price', 'revenue'] ELSE ['stock_qty'] END AS metrics,
       CASE WHEN label % 2 = 0 THEN ['month'] ELSE CAST([] AS VARCHAR[]) END AS group_by,
       CASE vec_id % 4 WHEN 0 THEN {CONTEXTS[0]} WHEN 1 THEN {CONTEXTS[1]} WHEN 2 THEN {CONTEXTS[2]} ELSE {CONTEXTS[3]} END AS context,
       CASE WHEN vec_id % 29 = 0 THEN 'old' ELSE '{memory.EMBEDDING_VERSION}' END AS embedding_version,
       CASE WHEN vec_id % 5 = 0 THEN '' ELSE 'SELECT ' || (vec_id % 40) || ' ;' END AS sql
FROM embeddings""")
view("m_mem", "SELECT *, vec_id AS memory_id FROM m_vectors")
view("m_asked", "SELECT *, vec_id AS query_id FROM m_vectors WHERE vec_id % 50 = 0")
view("m_near", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id) AS position FROM (
  SELECT query_id, memory_id, round(power(list_distance(q.embedding, d.embedding), 2), 6) AS distance FROM m_asked q CROSS JOIN m_mem d WHERE q.query_id <> d.memory_id)""")
# every tenth vector asks
view("m_askers", "SELECT *, vec_id AS query_id FROM m_vectors WHERE vec_id % 10 = 0")
view("m_found", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id) AS position FROM (
  SELECT query_id, memory_id, round(power(list_distance(q.embedding, d.embedding), 2), 6) AS distance FROM m_askers q CROSS JOIN m_mem d WHERE q.query_id <> d.memory_id)""")
view("m_usable", f"""
SELECT * FROM m_mem WHERE embedding_version = '{memory.EMBEDDING_VERSION}' AND validated AND execution_status = 'success'""")


def vectors(m):
    v, label = F.col("vec_id"), F.col("label")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return m.raw("embeddings").withColumns({
        "fingerprint": F.concat(F.lit("f"), F.expr("vec_id div 3").cast("string")), "validated": v % 7 != 0,
        "execution_status": F.when(v % 11 == 0, "error").otherwise("success"), "intent": pick(INTENTS, label),
        "operation": pick(OPERATIONS, F.expr("label div 2")),
        "metrics": F.when(label % 3 == 0, arr("revenue")).when(label % 3 == 1, arr("price", "revenue")).otherwise(arr("stock_qty")),
        "filters": F.expr("cast(array() as array<struct<field: string, operator: string, value: string>>)"),
        "date_range": F.expr("cast(null as struct<start_date: string, end_date: string>)"),
        "group_by": F.when(label % 2 == 0, arr("month")).otherwise(sets.none()),
        "context": F.when(v % 4 == 0, sets.none()).when(v % 4 == 1, arr("ventas")).when(v % 4 == 2, arr("ventas", "logistica")).otherwise(arr("logistica")),
        "embedding_version": F.when(v % 29 == 0, "old").otherwise(memory.EMBEDDING_VERSION),
        "sql": F.when(v % 5 == 0, "").otherwise(F.concat(F.lit("SELECT "), (v % 40).cast("string"), F.lit(" ;")))})


def memories(m):
    return vectors(m).withColumn("memory_id", F.col("vec_id"))


#: Every tenth vector asks all others; in M04c, M05, M05b, E10 and ST4 every fiftieth does.
TENTH, FIFTIETH = 10, 50


def asked(m, step=TENTH):
    return vectors(m).filter(F.col("vec_id") % step == 0).withColumn("query_id", F.col("vec_id"))


def near(m, k, step=TENTH):
    return retrieval.nearest(asked(m, step), memories(m), k, "query_id", "memory_id", others=True)


@query("J09_join_knn_threshold", "SELECT query_id, memory_id, position, distance, distance <= 1.4 AS passed_threshold FROM m_found WHERE position <= 10")
def _(m):
    return near(m, 10).withColumn("passed_threshold", F.col("distance") <= 1.4).withColumn("position", F.col("position").cast("bigint"))


@query("W01_win_best_per_key", """
SELECT query_id, fingerprint, memory_id, distance FROM (
  SELECT n.*, fingerprint, row_number() OVER (PARTITION BY query_id, fingerprint ORDER BY distance, n.memory_id) AS r
  FROM m_found n JOIN m_mem USING (memory_id) WHERE position <= 25) WHERE r = 1""")
def _(m):
    keyed = near(m, 25).join(memories(m).select("memory_id", "fingerprint"), "memory_id")
    return ranking.best_per_key(keyed, ["query_id", "fingerprint"], ["distance", "memory_id"], ["memory_id", "distance"])


@query("W02_win_top_n_per_query", """
SELECT o_custkey AS customer_id, o_orderkey AS order_id, n AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_totalprice AS DECIMAL(12,2)) DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def _(m):
    top = ranking.top_n_per_key(m.orders(), ["customer_id"], [F.col("order_total").desc(), F.col("order_id")], 3)
    return top.select("customer_id", "order_id", F.col("position").cast("bigint"))


SEARCH_SQL = """
WITH found AS ({candidates}),
good AS (
  SELECT f.query_id, f.memory_id, f.distance, u.fingerprint FROM found f JOIN m_usable u USING (memory_id) JOIN {asked} a USING (query_id)
  WHERE f.distance <= 1.7 AND a.intent = u.intent AND a.operation = u.operation AND list_has_all(u.metrics, a.metrics)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, fingerprint ORDER BY distance, memory_id) AS r FROM good),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id) AS position FROM best WHERE r = 1)
SELECT query_id, fingerprint, memory_id, distance, position FROM top WHERE position <= 3"""


def searched(m, mode, step=TENTH):
    return memory.search(asked(m, step), memories(m), 3, threshold=1.7, mode=mode, others=True).withColumn("position", F.col("position").cast("bigint"))


@query("M04_mem_search", SEARCH_SQL.format(candidates="SELECT * FROM m_found", asked="m_askers"))
def _(m):
    return searched(m, "prefilter")


@query("M04b_mem_search_prefilter", SEARCH_SQL.format(candidates="SELECT * FROM m_found", asked="m_askers"))
def _(m):
    return searched(m, "prefilter").orderBy("query_id", "position")


@query("M04c_mem_search_postfilter", SEARCH_SQL.format(candidates="SELECT * FROM m_near WHERE position <= 15", asked="m_asked"))
def _(m):
    return searched(m, "postfilter", FIFTIETH)


STRUCTURAL_SQL = """
SELECT query_id, memory_id, distance, position FROM (
  SELECT n.query_id, n.memory_id, n.distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, n.memory_id) AS position
  FROM m_found n JOIN m_usable u USING (memory_id) JOIN m_askers a USING (query_id)
  WHERE a.intent = u.intent AND a.operation = u.operation AND a.metrics = u.metrics AND a.group_by = u.group_by
    AND (len(a.context) = 0 OR len(u.context) = 0 OR list_has_any(a.context, u.context)){extra}) WHERE position <= 3 AND distance <= 1.8"""


@query("J18_join_structural_similarity", STRUCTURAL_SQL.format(extra=""))
def _(m):
    found = memory.search_structural(asked(m), memories(m), 3, threshold=1.8, others=True)
    return found.withColumn("position", F.col("position").cast("bigint"))


@query("M05_mem_search_structural", """
WITH good AS (
  SELECT n.query_id, n.memory_id, n.distance, row_number() OVER (PARTITION BY n.query_id, u.fingerprint ORDER BY distance, n.memory_id) AS r
  FROM m_near n JOIN m_usable u USING (memory_id) JOIN m_asked a USING (query_id)
  WHERE distance <= 1.8 AND a.intent = u.intent AND a.operation = u.operation AND a.metrics = u.metrics AND a.group_by = u.group_by
    AND (len(a.context) = 0 OR len(u.context) = 0 OR list_has_any(a.context, u.context)))
SELECT query_id, memory_id, distance, position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id) AS position FROM good WHERE r = 1) WHERE position <= 3""")
def _(m):
    found = memory.search_compatible(asked(m, FIFTIETH), memories(m), 3, threshold=1.8, others=True)
    return found.select("query_id", "memory_id", "distance", F.col("position").cast("bigint"))


@query("M05b_mem_search_structural_postfilter", """
WITH raw AS (SELECT * FROM m_near WHERE position <= 75),
good AS (
  SELECT r.query_id, r.memory_id, r.distance, u.fingerprint, a.metrics = u.metrics AND a.group_by = u.group_by
         AND (len(a.context) = 0 OR len(u.context) = 0 OR list_has_any(a.context, u.context)) AS same
  FROM raw r JOIN m_usable u USING (memory_id) JOIN m_asked a USING (query_id)
  WHERE r.distance <= 1.8 AND a.intent = u.intent AND a.operation = u.operation AND list_has_all(u.metrics, a.metrics)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, fingerprint ORDER BY distance, memory_id) AS r FROM good),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, memory_id) AS position FROM best WHERE r = 1)
SELECT query_id, memory_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY position) AS position FROM top
WHERE position <= 15 AND same QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 3""")
def _(m):
    found = memory.search_compatible(asked(m, FIFTIETH), memories(m), 3, threshold=1.8, mode="postfilter", others=True)
    return found.select("query_id", "memory_id", "distance", F.col("position").cast("bigint"))


@query("M06_mem_inspect_search", """
SELECT query_id, memory_id, distance, n AS position FROM (
  SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM m_found n JOIN m_mem USING (memory_id)
  WHERE position <= 15 AND distance <= 1.6 AND validated) WHERE n <= 5""")
def _(m):
    found = memory.inspect(asked(m), memories(m), 5, threshold=1.6, validated=True, others=True)
    return found.select("query_id", "memory_id", "distance", F.col("position").cast("bigint"))


@query("M07_mem_mark_used", """
SELECT m.memory_id, m.memory_id % 4 + coalesce(n, 0) AS retrieval_count, CASE WHEN n IS NOT NULL THEN '2024-01-01' ELSE '' END AS last_used_at
FROM m_mem m LEFT JOIN (SELECT memory_id, count(DISTINCT query_id) AS n FROM m_found WHERE position <= 4 GROUP BY 1) u ON m.memory_id = u.memory_id""")
def _(m):
    hits = near(m, 4).select(F.col("query_id").alias("call_id"), F.col("memory_id").cast("string"))
    hits = hits.unionByName(hits).unionByName(hits.withColumn("memory_id", F.concat(F.lit("x"), "memory_id")))
    store = memories(m).select(F.col("memory_id").cast("string"), (F.col("vec_id") % 4).alias("retrieval_count"), F.lit("").alias("last_used_at"))
    return memory.mark_used(store, hits, F.lit("2024-01-01")).withColumn("memory_id", F.col("memory_id").cast("bigint"))


@query("M08_mem_match_sql", """
SELECT query_id, arg_min(memory_id, position) AS memory_id, min(position) AS position FROM m_found n JOIN m_mem USING (memory_id)
WHERE position <= 60 AND sql = 'SELECT ' || (query_id // 10 % 40) || ' ;' GROUP BY query_id""")
def _(m):
    results = near(m, 60).join(memories(m).select("memory_id", "sql"), "memory_id")
    runs = asked(m).select("query_id", F.concat(F.lit(" select\n"), F.expr("query_id div 10 % 40").cast("string"), F.lit(" ;; ")).alias("sql"))
    return memory.match_sql(results, runs).withColumn("position", F.col("position").cast("bigint"))


@query("M10_mem_examples", """
SELECT query_id, position, 'Example ' || position || ':' || chr(10) || 'Question: ' || fingerprint || chr(10) || 'Validated SQL: ' || sql || chr(10) ||
       'Sources: ' || CASE WHEN memory_id % 2 = 0 THEN 'orders' ELSE 'not specified' END AS example
FROM m_found JOIN m_mem USING (memory_id) WHERE position <= 2 AND sql <> ''""")
def _(m):
    described = memories(m).select("memory_id", F.lit("").alias("normalized_question"), F.col("fingerprint").alias("original_question"), "sql",
                                   F.when(F.col("memory_id") % 2 == 0, "orders").otherwise("").alias("sources"))
    results = near(m, 3).join(described, "memory_id")
    return memory.examples(results).withColumn("position", F.col("position").cast("bigint"))


# --- catalogue retrieval ----------------------------------------------------------------------

view("m_catalogue", "SELECT memory_id, 'table_' || memory_id AS name, CASE WHEN memory_id % 13 <> 0 THEN 'CREATE TABLE' END AS ddl FROM m_mem")
view("m_named", """
SELECT query_id, name, min(p) - 1 AS position FROM (
  SELECT query_id, trim(unnest(names)) AS name, generate_subscripts(names, 1) AS p FROM (
    SELECT vec_id AS query_id, ['table_' || (vec_id + 1), ' table_' || (vec_id + 2) || ' ', 'table_' || (vec_id + 1), '', 'missing', 'table_' || (vec_id + 13)] AS names FROM m_vectors))
JOIN m_catalogue USING (name) WHERE ddl IS NOT NULL GROUP BY query_id, name""")
view("m_exact", "SELECT n.* FROM m_named n JOIN m_askers USING (query_id)")
view("m_semantic", """
SELECT query_id, 'table_' || memory_id AS name, position, distance, distance <= 1.4 AS passed FROM m_found WHERE position <= 10""")


def catalogue(m):
    return memories(m).select(F.concat(F.lit("table_"), F.col("memory_id").cast("string")).alias("table"), "memory_id",
                              F.when(F.col("memory_id") % 13 != 0, "CREATE TABLE").alias("ddl"))


def named(m, asking):
    q = lambda n: F.concat(F.lit("table_"), (F.col("query_id") + n).cast("string"))
    names = F.array(q(1), F.concat(F.lit(" "), q(2), F.lit(" ")), q(1), F.lit(""), F.lit("missing"), q(13))
    return retrieval.exact_names(asking.withColumn("names", names), catalogue(m), "query_id", "names")


def retrieved(m):
    found = near(m, 10).withColumn("table", F.concat(F.lit("table_"), F.col("memory_id").cast("string")))
    return named(m, asked(m)), retrieval.semantic_names(found, "query_id", "table", 1.4)


@query("J08_join_exact_name_lookup", """
SELECT query_id, name AS "table", CAST(position AS INTEGER) AS position, CAST(0 AS DOUBLE) AS distance, 'exact' AS source, true AS passed_threshold FROM m_named""")
def _(m):
    return named(m, vectors(m).withColumn("query_id", F.col("vec_id")))  # a join by name: every row asks


@query("J10_join_hybrid_retrieval", """
SELECT query_id, name AS "table", 'exact' AS source, CAST(0 AS DOUBLE) AS distance FROM m_exact
UNION ALL SELECT s.query_id, s.name, 'semantic', s.distance FROM m_semantic s JOIN m_catalogue c ON s.name = c.name AND c.ddl IS NOT NULL
WHERE passed AND NOT EXISTS (SELECT 1 FROM m_exact e WHERE e.query_id = s.query_id AND e.name = s.name)""")
def _(m):
    exact, semantic = retrieved(m)
    return retrieval.hybrid(exact, semantic, catalogue(m), "query_id").select("query_id", "table", "source", "distance")


DECISION_SQL = """
SELECT query_id, name AS "table", CAST(e.position AS INTEGER) AS exact_position, s.distance AS semantic_distance,
       CASE WHEN e.position IS NOT NULL AND (s.distance IS NULL OR passed) THEN 'selected' WHEN e.position IS NOT NULL THEN 'selected_by_exact'
            WHEN passed THEN 'selected_by_semantic' ELSE 'discarded' END AS decision
FROM m_exact e FULL OUTER JOIN m_semantic s USING (query_id, name)"""


@query("J11_join_candidate_decision", DECISION_SQL)
def _(m):
    return retrieval.decisions(*retrieved(m), "query_id")


@query("T04_srt_retrieval_order", f"""
SELECT query_id, "table", row_number() OVER (PARTITION BY query_id ORDER BY exact_position IS NULL, exact_position, semantic_distance NULLS LAST, "table") AS place
FROM ({DECISION_SQL})""")
def _(m):
    rows = retrieval.decisions(*retrieved(m), "query_id")
    ordered = ranking.top_n_per_key(rows, ["query_id"], retrieval.retrieval_order(), 1 << 30, "place")
    return ordered.select("query_id", "table", F.col("place").cast("bigint"))


@query("U04_set_subset", """
SELECT question_id, list_has_all(suggested_tables, ['olist_orders_dataset']) AS orders_only, list_has_all(['ventas', 'logistica'], context) AS in_sales FROM m_structured""")
def _(m):
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return structured(m).select("question_id", sets.subset(lit("olist_orders_dataset"), F.col("suggested_tables")).alias("orders_only"),
                                sets.subset(F.col("context"), lit("ventas", "logistica")).alias("in_sales"))


@query("U05_set_disjoint", """
SELECT question_id, len(context) > 0 AND NOT list_has_any(context, ['ventas', 'soporte']) AS apart FROM m_structured""")
def _(m):
    return structured(m).select("question_id", sets.disjoint(F.col("context"), F.array(F.lit("ventas"), F.lit("soporte"))).alias("apart"))
