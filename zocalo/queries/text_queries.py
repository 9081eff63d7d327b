"""Text forms, question structuring and rule tagging (X01-X06, Q, J12-J14, U01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zocalo.functions import sets, text
from zocalo.operators import rules, structuring
from zocalo.operators.filters import keep_where
from zocalo.queries import sqltext as s
from zocalo.queries.questions import question_rows
from zocalo.queries.registry import query
from zocalo.queries.views import view

view("m_texts", """
SELECT 'd' || doc_id AS text_id, text FROM documents
UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
UNION ALL SELECT question_id, question FROM m_questions""")


def texts(m):
    docs = m.spread("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    turns = m.spread("conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("text_id"), "text")
    asked = question_rows(m).select(F.col("question_id").alias("text_id"), F.col("question").alias("text"))
    return docs.unionByName(turns).unionByName(asked)


def form(name, native, sql):
    @query(name, f"SELECT text_id, {sql('text')} AS form FROM m_texts")
    def _(m):
        return texts(m).select("text_id", native(F.col("text")).alias("form"))


form("X01_txt_clean_spaces", text.clean_spaces, s.clean)
form("X02_txt_fold_accents", text.fold, s.fold)
form("X03_txt_fingerprint_form", text.fingerprint_form, s.fingerprint_form)
form("X04_txt_token", text.token, s.token)
form("X05_txt_compare_form", text.compare_form, s.compare_form)
form("X06_txt_sql_form", lambda x: text.sql_form(F.concat(x, F.lit(" ;; "))), lambda x: s.sql_form(f"({x} || ' ;; ')"))
form("X24_txt_tag_form", text.tag_form, lambda x: f"trim(regexp_replace({s.casefold(f'trim({x})')}, '[^a-z0-9_.:/-]+', '-', 'g'), '-')")


def joined(column, sep=","):
    return F.array_join(column, sep)


def structured(m):
    return structuring.structure(question_rows(m), "question")


FILTER_TEXT = "array_to_string(list_transform(filters, lambda f: f.field || f.operator || f.value), ',')"


def filter_text(column="filters"):
    return joined(F.transform(column, lambda f: F.concat(f["field"], f["operator"], f["value"])))


@query("Q01_qs_intent", "SELECT question_id, intent FROM m_parts")
def _(m):
    folded = text.fold(text.clean_spaces(F.col("question")))
    return (question_rows(m).withColumn("t", folded).filter(F.col("t") != "")
            .select("question_id", structuring.intent("t").alias("intent")))


@query("Q02_qs_operation", "SELECT question_id, operation FROM m_lists")
def _(m):
    return structured(m).select("question_id", "operation")


@query("Q03_qs_metrics", "SELECT question_id, array_to_string(metrics, ',') AS metrics FROM m_parts")
def _(m):
    return structured(m).select("question_id", joined("metrics").alias("metrics"))


@query("Q04_qs_group_by", "SELECT question_id, array_to_string(group_by, ',') AS group_by FROM m_parts")
def _(m):
    return structured(m).select("question_id", joined("group_by").alias("group_by"))


@query("Q05_qs_date_range", "SELECT question_id, start_date, end_date FROM m_structured")
def _(m):
    return structured(m).select("question_id", "date_range.start_date", "date_range.end_date")


@query("Q06_qs_filters", f"SELECT question_id, {FILTER_TEXT} AS filters FROM m_parts")
def _(m):
    return structured(m).select("question_id", filter_text().alias("filters"))


@query("Q07_qs_context_tables", """
SELECT question_id, array_to_string(context, ',') AS context, array_to_string(suggested_tables, ',') AS tables FROM m_structured""")
def _(m):
    return structured(m).select("question_id", joined("context").alias("context"), joined("suggested_tables").alias("tables"))


@query("Q08_qs_normalised_text", "SELECT question_id, normalized_question FROM m_structured")
def _(m):
    return structured(m).select("question_id", "normalized_question")


view("m_guesses", """
SELECT question_id, CASE WHEN length(question_id) % 3 = 0 THEN 'aggregation' WHEN length(question_id) % 3 = 1 THEN 'free form' ELSE 'ranking' END AS g_intent,
       CASE WHEN length(question) % 2 = 0 THEN ' average ' ELSE 'other' END AS g_operation,
       CASE WHEN length(question) % 3 = 0 THEN ['revenue', 'nothing', 'price'] ELSE ['nothing'] END AS g_metrics,
       CASE WHEN length(question) % 5 = 0 THEN ['category', ' ', 'state'] ELSE CAST([] AS VARCHAR[]) END AS g_group_by,
       CASE WHEN length(question) % 7 < 3 THEN '2019-01-01' ELSE '' END AS g_start, '2019-06-30' AS g_end,
       CASE WHEN length(question) % 4 = 0 THEN ' Pregunta reescrita ' ELSE '' END AS g_text,
       ['mercado', 'ventas'] AS g_context, ['seller_promotions', 'carriers'] AS g_tables
FROM m_questions WHERE length(question) % 6 <> 0""")


def guesses(m):
    n, k = F.length("question"), F.length("question_id")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return question_rows(m).filter(n % 6 != 0).select(
        "question_id",
        F.when(k % 3 == 0, "aggregation").when(k % 3 == 1, "free form").otherwise("ranking").alias("intent"),
        F.when(n % 2 == 0, " average ").otherwise("other").alias("operation"),
        F.when(n % 3 == 0, arr("revenue", "nothing", "price")).otherwise(arr("nothing")).alias("metrics"),
        F.when(n % 5 == 0, arr("category", " ", "state")).otherwise(sets.none()).alias("group_by"),
        F.struct(F.when(n % 7 < 3, "2019-01-01").otherwise("").alias("start_date"), F.lit("2019-06-30").alias("end_date")).alias("date_range"),
        F.when(n % 4 == 0, " Pregunta reescrita ").otherwise("").alias("normalized_question"),
        arr("mercado", "ventas").alias("context"), arr("seller_promotions", "carriers").alias("suggested_tables"))


@query("Q09_qs_merge_sources", f"""
WITH step1 AS (
  SELECT s.* REPLACE (CASE WHEN s.intent = 'temporal_trend' THEN s.intent WHEN g_intent IN ('aggregation', 'ranking') THEN g_intent ELSE s.intent END AS intent,
                      CASE WHEN g_metrics IS NOT NULL AND len(g_metrics) > 1 THEN ['revenue', 'price'] ELSE s.metrics END AS metrics,
                      CASE WHEN len(g_group_by) > 0 THEN ['category', 'state'] ELSE s.group_by END AS group_by,
                      CASE WHEN g_start <> '' THEN g_start ELSE s.start_date END AS start_date,
                      CASE WHEN g_start <> '' THEN g_end ELSE s.end_date END AS end_date,
                      CASE WHEN trim(g_text) <> '' THEN trim(g_text) ELSE s.normalized_question END AS normalized_question),
         g.g_operation, g.g_context, g.g_tables
  FROM m_structured s LEFT JOIN m_guesses g USING (question_id)),
step2 AS (
  SELECT *, {s.context('t', 'metrics')} AS own,
         {s.chain([s.tables('t', 'metrics', 'group_by'), f"coalesce(g_tables, {s.empty()})", s.rule_tables('t'), s.filter_tables('filters')])} AS found
  FROM step1)
SELECT question_id, intent, CASE WHEN g_operation = ' average ' THEN 'average' ELSE {s.operation('t', 'intent')} END AS operation,
       array_to_string(metrics, ',') AS metrics, array_to_string(group_by, ',') AS group_by, start_date, end_date, normalized_question,
       array_to_string(CASE WHEN len(own) > 0 THEN {s.ordered_distinct('own')} ELSE coalesce(g_context, {s.empty()}) END, ',') AS context,
       array_to_string({s.ordered_distinct('found')}, ',') AS tables
FROM step2""")
def _(m):
    merged = structuring.merge_guess(structured(m), guesses(m), "question_id")
    return merged.select("question_id", "intent", "operation", joined("metrics").alias("metrics"), joined("group_by").alias("group_by"),
                         "date_range.start_date", "date_range.end_date", "normalized_question",
                         joined("context").alias("context"), joined("suggested_tables").alias("tables"))


STRUCTURED_SQL = f"""
SELECT question_id, original_question, normalized_question, intent, operation, array_to_string(metrics, ',') AS metrics,
       {FILTER_TEXT} AS filters, start_date, end_date, array_to_string(group_by, ',') AS group_by,
       array_to_string(context, ',') AS context, array_to_string(suggested_tables, ',') AS tables FROM m_structured"""


def structured_flat(df):
    return df.select("question_id", "original_question", "normalized_question", "intent", "operation", joined("metrics").alias("metrics"),
                     filter_text().alias("filters"), "date_range.start_date", "date_range.end_date", joined("group_by").alias("group_by"),
                     joined("context").alias("context"), joined("suggested_tables").alias("tables"))


@query("Q10_qs_structured", STRUCTURED_SQL)
def _(m):
    return structured_flat(structured(m))


@query("J12_join_rule_text", " UNION ALL ".join(
    f"SELECT text_id, '{r.id}' AS rule_id FROM (SELECT text_id, {s.fold(s.clean('text'))} AS t FROM m_texts) WHERE {s.rule_fired('t', r)}"
    for r in rules.RULES))
def _(m):
    return rules.tag_texts(texts(m), "text_id", "text", rules.term_table(m.spark))


@query("J13_join_rule_tables", f"""
SELECT text_id, array_to_string({s.ordered_distinct('found')}, ',') AS tables FROM (
  SELECT text_id, {s.rule_tables('t')} AS found FROM (SELECT text_id, {s.fold(s.clean('text'))} AS t FROM m_texts)) WHERE len(found) > 0""")
def _(m):
    folded = texts(m).select("text_id", rules.matching_form(F.col("text")).alias("t"))
    return keep_where(folded.select("text_id", joined(rules.rule_tables(F.col("t"))).alias("tables")), F.col("tables") != "")


@query("J14_join_filter_tables", f"""
SELECT question_id, array_to_string({s.ordered_distinct('found')}, ',') AS tables
FROM (SELECT question_id, {s.filter_tables('filters')} AS found FROM m_parts)""")
def _(m):
    return structured(m).select("question_id", joined(structuring.filter_tables(F.col("filters"))).alias("tables"))


@query("U01_set_ordered_union", f"""
SELECT question_id, array_to_string({s.ordered_distinct('listed')}, ',') AS items
FROM (SELECT question_id, flatten([suggested_tables, context, metrics, suggested_tables]) AS listed FROM m_structured)""")
def _(m):
    union = sets.ordered_union(F.col("suggested_tables"), F.col("context"), F.col("metrics"), F.col("suggested_tables"))
    return structured(m).select("question_id", joined(union).alias("items"))
