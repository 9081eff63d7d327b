"""Sources, sinks and streams (S, ST); files go to a fresh run folder below the shared one."""

from __future__ import annotations

from pyspark.sql import functions as F

from zocalo.functions.redaction import redact
from zocalo.operators import memory
from zocalo.queries.evaluation_queries import redact_sql
from zocalo.queries.memory_queries import FIFTIETH, MERGED_SQL, merged_flat, near, records
from zocalo.queries.questions import question_rows
from zocalo.queries.registry import query
from zocalo.queries.text_queries import STRUCTURED_SQL, structured_flat
from zocalo.queries.views import view
from zocalo.session import run_dir
from zocalo.sources import readers, sinks
from zocalo import streaming

ORDER_SCHEMA = "order_id bigint, customer_id bigint, order_status string, purchased string, note string"


def order_rows(m):
    o = F.col("order_id")
    purchased = F.when(o % 9 == 0, "not a date").otherwise(F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss"))
    return m.orders().select("order_id", "customer_id", "order_status", purchased.alias("purchased"), F.concat(F.lit('línea "'), o.cast("string"), F.lit('", ok,\n"" fin')).alias("note"))


@query("S01_src_csv_tables", "SELECT order_id, order_status, 'línea \"' || order_id || '\", ok,' || chr(10) || '\"\" fin' AS note FROM m_orders")
def _(m):
    folder = run_dir(m.spark, "csv")
    sinks.write_csv_tables({"orders": order_rows(m)}, folder)
    return readers.csv_table(m.spark, f"{folder}/orders", ORDER_SCHEMA, ["order_id", "order_status", "note"])


@query("S02_src_lenient_timestamps", "SELECT order_id, CASE WHEN order_id % 9 <> 0 THEN order_purchase_timestamp END AS purchased_at FROM m_orders")
def _(m):
    return order_rows(m).select("order_id", readers.lenient_timestamp(F.col("purchased")).alias("purchased_at"))


@query("S03_src_key_alignment", "SELECT CAST(order_id AS VARCHAR) AS order_id, customer_state FROM m_orders JOIN m_customers USING (customer_id)")
def _(m):
    orders = readers.aligned_keys(m.orders().withColumn("customer_id", F.col("customer_id").cast("int")), "order_id", "customer_id")
    return orders.join(readers.aligned_keys(m.customers(), "customer_id"), "customer_id").select("order_id", "customer_state")


view("m_lines_in", """
SELECT order_id, CASE WHEN order_id % 10 = 0 THEN 'malformed' WHEN order_id % 10 = 1 THEN 'no_case_id' WHEN order_id % 10 = 2 THEN 'duplicate' END AS problem,
       order_id % 10 <> 3 AS enabled FROM m_orders WHERE order_id % 10 <> 4""")


def case_lines(m):
    """A case file with blank, broken, unnamed, repeated and disabled lines."""
    o = F.col("order_id")
    case = F.when(o % 10 != 1, F.concat(F.lit("case_"), (o - F.when(o % 10 == 2, o % 20).otherwise(0)).cast("string")))
    body = F.to_json(F.struct(case.alias("case_id"), F.when(o % 10 == 3, F.lit(False)).alias("enabled"), F.struct(F.lit("¿Cuántas?").alias("question")).alias("inputs")))
    line = F.when(o % 10 == 0, "{broken").when(o % 10 == 4, "   ").otherwise(body)
    doubled = F.when(o % 10 == 2, F.array(line, line)).otherwise(F.array(line))
    return m.orders().select(F.explode(doubled).alias("value"))


@query("S04_src_jsonl_cases", """
SELECT coalesce(problem, CASE WHEN enabled THEN 'enabled' ELSE 'disabled' END) AS outcome, sum(CASE WHEN problem = 'duplicate' THEN 2 ELSE 1 END)::BIGINT AS lines
FROM m_lines_in GROUP BY 1""")
def _(m):
    folder = run_dir(m.spark, "cases")
    case_lines(m).write.text(folder)
    outcome = F.coalesce("problem", F.when(F.coalesce("enabled", F.lit(True)), "enabled").otherwise("disabled"))
    return readers.parsed_cases(m.spark, folder).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("lines"))


@query("S04b_src_enabled_cases", "SELECT 'case_' || order_id AS case_id, '¿Cuántas?' AS question FROM m_lines_in WHERE problem IS NULL AND enabled")
def _(m):
    folder = run_dir(m.spark, "cases")
    case_lines(m).write.text(folder)
    return readers.enabled_cases(m.spark, folder, strict=False).select("case_id", F.col("inputs.question").alias("question"))


def document_files(rows, folder):
    """One JSON document of (g, value) rows per file, as catalogues and banks come."""
    rows.repartition("g").write.partitionBy("g").text(folder)
    return f"{folder}/g=*"


@query("S05_src_catalogue_json", """
SELECT 'tabla_' || p_partkey AS id, p_name AS nombre, CASE WHEN p_partkey % 2 = 0 THEN 'única' END AS policy FROM part""")
def _(m):
    k = F.col("p_partkey")
    entry = F.struct(F.concat(F.lit("tabla_"), k.cast("string")).alias("id"), F.col("p_name").alias("nombre"), F.lit("Descripción").alias("descripcion"),
                     F.lit("CREATE TABLE").alias("ddl"), F.when(k % 2 == 0, F.array(F.lit("única"))).alias("politicas"))
    arrays = m.raw("part").groupBy(F.floor(k / 1000).alias("g")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    path = document_files(arrays, run_dir(m.spark, "catalogue"))
    return readers.table_catalogue(m.spark, path).select("id", "nombre", F.nullif(F.array_join("politicas", ","), F.lit("")).alias("policy"))


@query("S06_src_nested_bank", """
SELECT 'memory' AS kind, CAST(order_id AS VARCHAR) AS id, 'revenue,' || order_status AS metrics, 'success' AS status FROM m_orders
UNION ALL SELECT 'case', CAST(order_id AS VARCHAR), NULL, order_status FROM m_orders WHERE order_id % 2 = 0""")
def _(m):
    o = F.col("order_id")
    memory_ = F.struct(o.cast("string").alias("key"), F.lit("¿Qué?").alias("original_question"), F.array(F.lit("revenue"), F.col("order_status")).alias("metrics"))
    case = F.when(o % 2 == 0, F.struct(o.cast("string").alias("id"), F.col("order_status").alias("category"), F.lit("¿Qué?").alias("question")))
    bank = F.struct(F.lit("2").alias("version"), F.collect_list(memory_).alias("memories"), F.collect_list(case).alias("cases"))
    banks = m.orders().groupBy(F.floor(o / 1000).alias("g")).agg(F.to_json(bank).alias("value"))
    memories, cases = readers.memory_bank(m.spark, document_files(banks, run_dir(m.spark, "banks")))
    first = memories.select(F.lit("memory").alias("kind"), F.col("key").alias("id"), F.array_join("metrics", ",").alias("metrics"), "status")
    return first.unionByName(cases.filter(F.size("group_by") == 0).select(
        F.lit("case").alias("kind"), "id", F.lit(None).cast("string").alias("metrics"), F.col("category").alias("status")))


@query("S07_sink_csv_tables", """
SELECT carrier_id, carrier_name, carrier_type, coverage_regions, on_time_rate,
       CASE carrier_id % 3 WHEN 0 THEN 'a "b", c' || chr(10) || carrier_name WHEN 1 THEN coverage_regions END AS remark FROM m_carriers""")
def _(m):
    k = F.col("carrier_id")
    remark = F.when(k % 3 == 0, F.concat(F.lit('a "b", c\n'), "carrier_name")).when(k % 3 == 1, F.col("coverage_regions"))
    folder = run_dir(m.spark, "tables")
    carriers = m.carriers().withColumn("remark", remark)
    sinks.write_csv_tables({"carriers": carriers, "promotions": m.promotions()}, folder)
    return readers.csv_table(m.spark, f"{folder}/carriers", "carrier_id bigint, carrier_name string, carrier_type string, coverage_regions string, "
                             "on_time_rate double, remark string")


@query("S08_sink_json_report", "SELECT order_id, 'Línea ñ ' || order_status AS note, CASE WHEN order_id % 2 = 0 THEN 'x' END AS maybe FROM m_orders")
def _(m):
    folder = run_dir(m.spark, "report")
    report = m.orders().select("order_id", F.concat(F.lit("Línea ñ "), "order_status").alias("note"), F.when(F.col("order_id") % 2 == 0, "x").alias("maybe"))
    sinks.write_json_report(report, f"{folder}/report")
    return m.spark.read.schema("order_id bigint, note string, maybe string").json(f"{folder}/report")


@query("S09_sink_jsonl_refresh", """
SELECT order_id AS position, 'c' || order_id AS case_id, CASE WHEN order_id % 4 = 0 THEN 'new ' ELSE 'old ' END || order_status AS line FROM m_orders""")
def _(m):
    o = F.col("order_id")
    lines = m.orders().select(o.alias("position"), F.concat(F.lit("c"), o.cast("string")).alias("case_id"), F.concat(F.lit("old "), "order_status").alias("line"))
    new = m.orders().filter(o % 4 == 0).select(F.concat(F.lit("c"), o.cast("string")).alias("case_id"), F.concat(F.lit("new "), "order_status").alias("line"))
    return sinks.refreshed_lines(lines, new)


@query("S10_sink_memory_snapshot", "SELECT order_id, order_status, CAST(order_total AS DOUBLE) AS order_total FROM m_orders")
def _(m):
    store = sinks.MemoryStore(m.spark, run_dir(m.spark, "store"))
    store.write(m.orders().limit(0), 0)
    store.write(m.orders())
    return store.read().select("order_id", "order_status", F.col("order_total").cast("double"))


@query("S10b_sink_bucket_store", MERGED_SQL)
def _(m):
    events = memory.sequenced(records(m), ["seq"])
    store = sinks.BucketStore(m.spark, run_dir(m.spark, "buckets"), "fingerprint", buckets=16)
    for part in (F.col("seq") < 5000, F.col("seq") >= 5000):
        store.merge(events.filter(part), memory.folded)
    return merged_flat(store.read())


# --- streams ----------------------------------------------------------------------------------

@query("ST1_st_redact", f"SELECT doc_id, {redact_sql('text')} AS text FROM documents")
def _(m):
    docs = streaming.file_stream(m.spark, m.path, "documents.parquet").select("doc_id", "text")
    return streaming.run_to_end(streaming.redacted(docs, "text"), run_dir(m.spark, "redact"))


def stored(m, name, df):
    """Rows written to a folder that a stream then reads."""
    folder = run_dir(m.spark, name)
    df.write.parquet(folder)
    return streaming.file_stream(m.spark, folder, "*.parquet")


@query("ST2_st_structure_questions", STRUCTURED_SQL)
def _(m):
    stream = stored(m, "questions", question_rows(m))
    return structured_flat(streaming.run_to_end(streaming.structured(stream, "question"), run_dir(m.spark, "structured")))


@query("ST3_st_memory_upsert", MERGED_SQL)
def _(m):
    folder = run_dir(m.spark, "events")
    records(m).repartition(3).write.parquet(folder)
    stream = streaming.file_stream(m.spark, folder, "*.parquet", files_per_batch=1)
    work = run_dir(m.spark, "merge")
    log = sinks.BatchLog(m.spark, f"{work}/log")
    streaming.merge_into_log(stream, log, work, ["seq"])
    return merged_flat(streaming.merged_log(log))


@query("ST4_st_usage_counters", "SELECT memory_id, count(DISTINCT query_id) AS retrieval_count FROM m_near WHERE position <= 4 GROUP BY memory_id")
def _(m):
    hits = near(m, 4, FIFTIETH).select(F.col("query_id").alias("call_id"), "memory_id", F.expr("timestamp_seconds(1704067200 + query_id)").alias("at"))
    stream = stored(m, "hits", hits.unionByName(hits))
    work = run_dir(m.spark, "usage")
    log = sinks.BatchLog(m.spark, f"{work}/log")
    streaming.log_usage(stream, log, work)
    return streaming.usage_counts(log)
