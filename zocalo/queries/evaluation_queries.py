"""Evaluation, number reading and result checks (X10-X16, X25, E, D01-D02, D09-D12, A24, A26-A27, J15, J19-J20, U02, U06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zocalo.functions import numbers, redaction, sets, sqltext
from zocalo.operators import aggregates, evaluation, quality
from zocalo.plans.marketplace import pick
from zocalo.queries import sqltext as s
from zocalo.queries.memory_queries import FIFTIETH, TENTH, near
from zocalo.queries.registry import query
from zocalo.queries.views import sql_list, sql_pick, view

# --- printed values ---------------------------------------------------------------------------

view("m_printed", """
SELECT order_id, order_total, md5(CAST(order_id AS VARCHAR)) AS h,
       CASE order_id % 8 WHEN 0 THEN CAST(order_total AS VARCHAR) WHEN 1 THEN '+' || CAST(order_total AS VARCHAR) WHEN 2 THEN ' ' || order_id || ' '
            WHEN 3 THEN format('{:,.2f}', CAST(order_total AS DOUBLE)) WHEN 4 THEN translate(format('{:,.2f}', CAST(order_total AS DOUBLE)), ',.', '.,')
            WHEN 5 THEN '-' || format('{:,}', order_id * 1000) WHEN 6 THEN 'true' ELSE '0,' || lpad(CAST(order_id % 1000 AS VARCHAR), 3, '0') END AS printed
FROM m_orders""")


def printed(m):
    o, total = F.col("order_id"), F.col("order_total")
    text = lambda c: c.cast("string")
    grouped = F.format_number(total, 2)
    value = (F.when(o % 8 == 0, text(total)).when(o % 8 == 1, F.concat(F.lit("+"), text(total)))
             .when(o % 8 == 2, F.concat(F.lit(" "), text(o), F.lit(" "))).when(o % 8 == 3, grouped)
             .when(o % 8 == 4, F.translate(grouped, ",.", ".,")).when(o % 8 == 5, F.concat(F.lit("-"), F.format_number(o * 1000, 0)))
             .when(o % 8 == 6, "true").otherwise(F.concat(F.lit("0,"), F.lpad(text(o % 1000), 3, "0"))))
    return m.orders().select("order_id", "order_total", F.md5(text(o)).alias("h"), value.alias("printed"))


DASHED = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


def dashed(h):
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


view("m_words", r"""
SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)""")
view("m_values", "SELECT word AS value FROM m_words UNION SELECT printed FROM m_printed")


def words(m):
    """The different words of all documents and conversations."""
    texts = m.spread("documents").select("text").unionByName(m.spread("conversations").select("text"))
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word")).distinct()


def values(m):
    """Those words and the amounts of the orders as they are printed in many ways."""
    return words(m).select(F.col("word").alias("value")).union(printed(m).select("printed")).distinct()


@query("X11_num_uuid_form", f"""
SELECT word, form, CASE WHEN regexp_full_match(trim(t), '{numbers.UUID}') THEN lower(replace(trim(t), '-', '')) END AS id FROM (
  SELECT word, unnest([0, 1, 2, 3]) AS form, unnest([word, ' ' || h, upper({DASHED.format(h='h')}), substr(h, 1, length(word)) || word]) AS t FROM (SELECT word, md5(word) AS h FROM m_words))""")
def _(m):
    h = F.md5("word")
    forms = F.array(F.col("word"), F.concat(F.lit(" "), h), F.upper(dashed(h)), F.concat(F.substr(h, F.lit(1), F.length("word")), "word"))
    return words(m).select("word", F.posexplode(forms).alias("form", "t")).select("word", "form", numbers.uuid_form(F.col("t")).alias("id"))


NUMBER_SQL = "CASE WHEN regexp_matches(trim({x}), '^[+-]?[0-9]+([.][0-9]+)?$') THEN TRY_CAST(trim({x}) AS DECIMAL(38,10)) END"


@query("X12_num_from_text", f"SELECT value, CAST({NUMBER_SQL.format(x='value')} AS DOUBLE) AS number FROM m_values")
def _(m):
    return values(m).select("value", numbers.number_from_text(F.col("value")).cast("double").alias("number"))


# A token's readings: with both marks the last one is the decimal mark; with one it may be that or, if all groups behind it have three digits, a separator.
view("m_tokens", """
SELECT value, t, contains(t, ',') AS comma, contains(t, '.') AS dot, regexp_extract(t, '([.,])[^.,]*$', 1) AS last, regexp_extract(t, '^[+-]?') AS sign,
       string_split_regex(regexp_replace(t, '^[+-]', ''), '[.,]') AS parts
FROM (SELECT value, trim(trim(value), '.,') AS t FROM m_values WHERE regexp_matches(value, '[0-9]'))""")


@query("X13_num_token_candidates", """
SELECT value, array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(
  CASE WHEN comma AND dot THEN [CASE WHEN last = '.' THEN replace(t, ',', '') ELSE replace(replace(t, '.', ''), ',', '.') END]
       WHEN comma OR dot THEN [CASE WHEN len(parts) = 2 THEN sign || array_to_string(parts, '.') END,
                               CASE WHEN len(list_filter(parts[2:], lambda g: length(g) <> 3)) = 0 THEN sign || array_to_string(parts, '') END]
       ELSE [t] END, lambda x: CASE WHEN regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN TRY_CAST(x AS DECIMAL(38,10)) END),
  lambda n: n IS NOT NULL))), lambda n: printf('%.3f', CAST(n AS DOUBLE))), ' ') AS readings FROM m_tokens""")
def _(m):
    rows = values(m).filter(F.col("value").rlike("[0-9]"))
    text = F.array_join(F.transform(F.sort_array(numbers.readings(F.col("value"))), lambda n: F.format_string("%.3f", n.cast("double"))), " ")
    return rows.select("value", text.alias("readings"))


@query("X14_num_answer_parse", """
SELECT value, TRY_CAST(CASE WHEN comma AND dot THEN CASE WHEN last = ',' THEN replace(replace(v, '.', ''), ',', '.') ELSE replace(v, ',', '') END
  WHEN comma THEN CASE WHEN starts_with(v, '0,') OR length(regexp_extract(v, ',([^,]*)$', 1)) <= 2 THEN replace(v, ',', '.') ELSE replace(v, ',', '') END ELSE v END AS DOUBLE) AS number
FROM (SELECT value, trim(value) AS v, contains(value, ',') AS comma, contains(value, '.') AS dot, regexp_extract(value, '([.,])[^.,]*$', 1) AS last
      FROM m_values WHERE regexp_full_match(trim(value), '[-+]?[0-9][0-9.,]*'))""")
def _(m):
    return values(m).filter(F.trim("value").rlike("^[-+]?[0-9][0-9.,]*$")).select("value", numbers.answer_number(F.col("value")).alias("number"))


KEYS = ["on_time_rate", "price", "discount_pct", "Tasa de entrega", "generated", "porcentaje-año", "ratio2", "RATE"]


@query("X15_key_is_percent", f"""
SELECT key, list_has_any(string_split_regex(lower(key), '[^a-záéíóúñ]+'), {sql_list(numbers.PERCENT_WORDS)}) AS is_rate
FROM (SELECT DISTINCT word || {sql_pick(['_', ' ', '', '2'], 'length(word)')} || {sql_pick(KEYS, 'length(word) // 2')} AS key FROM m_words)""")
def _(m):
    n = F.length("word")
    keyed = words(m).select(F.concat("word", pick(["_", " ", "", "2"], n), pick(KEYS, F.expr("length(word) div 2"))).alias("key")).distinct()
    return keyed.withColumn("is_rate", numbers.percent_key(F.col("key")))


view("m_pairs", f"""
SELECT 'o' || order_id AS pair_id, unnest([0, 1, 2, 3, 4]) AS n,
       unnest([printed, h, strftime(day, '%Y-%m-%d'), upper(state) || '_ ' , CASE WHEN order_id % 2 = 0 THEN printed END]) AS actual,
       unnest([CAST(order_total AS VARCHAR), upper({DASHED.format(h='h')}), strftime(other, '%Y-%m'), lower(state), CAST(customer_id AS VARCHAR)]) AS expected
FROM (SELECT p.order_id, p.printed, p.h, o.order_total, o.customer_id, o.order_purchase_timestamp AS day, o.order_estimated_delivery_date - INTERVAL 60 DAY + to_days(CAST(o.order_id % 40 AS INTEGER)) AS other,
             o.payment_type AS state FROM m_printed p JOIN m_orders o USING (order_id))
UNION ALL SELECT 'w' || conv_id || '-' || turn, i, w[i + 1], w[i + 2] FROM (
  SELECT conv_id, turn, w, unnest(range(len(w) - 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM conversations))""")


def pairs(m):
    """Printed values beside what they may stand for: of every order, and of all words that follow each other in a conversation."""
    o = F.col("order_id")
    rows = printed(m).drop("order_total").join(m.orders(), "order_id")
    other = F.expr("order_purchase_timestamp + make_interval(0, 0, 0, CAST(order_id % 40 AS INT))")
    actual = F.array("printed", "h", F.date_format("order_purchase_timestamp", "yyyy-MM-dd"), F.concat(F.upper("payment_type"), F.lit("_ ")), F.when(o % 2 == 0, F.col("printed")))
    expected = F.array(F.col("order_total").cast("string"), F.upper(dashed("h")), F.date_format(other, "yyyy-MM"), F.lower("payment_type"), F.col("customer_id").cast("string"))
    of_orders = rows.select(F.concat(F.lit("o"), o.cast("string")).alias("pair_id"), F.posexplode(F.arrays_zip(actual.alias("actual"), expected.alias("expected"))).alias("n", "p"))
    turn = m.spread("conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    follow = F.arrays_zip(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("actual"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("expected"))
    of_words = turn.select(F.concat_ws("-", F.concat(F.lit("w"), F.col("conv_id").cast("string")), F.col("turn").cast("string")).alias("pair_id"), F.posexplode(follow).alias("n", "p"))
    return of_orders.unionByName(of_words).select("pair_id", F.col("n").cast("bigint").alias("n"), "p.actual", "p.expected")


def uuid_sql(x):
    return f"CASE WHEN regexp_full_match(trim({x}), '{numbers.UUID}') THEN lower(replace(trim({x}), '-', '')) END"


@query("X16_val_equivalent", f"""
SELECT pair_id, CAST(n AS BIGINT) AS n, CASE WHEN a IS NOT NULL AND e IS NOT NULL THEN abs(a - e) <= 0.01 WHEN actual IS NULL OR expected IS NULL THEN actual IS NOT DISTINCT FROM expected
  WHEN ua IS NOT NULL AND ue IS NOT NULL THEN ua = ue WHEN regexp_full_match(trim(expected), '[0-9]{{4}}-[0-9]{{2}}') THEN starts_with(trim(actual), trim(expected))
  ELSE {s.compare_form('actual')} = {s.compare_form('expected')} END AS same
FROM (SELECT *, {NUMBER_SQL.format(x='actual')} AS a, {NUMBER_SQL.format(x='expected')} AS e, {uuid_sql('actual')} AS ua, {uuid_sql('expected')} AS ue FROM m_pairs)""")
def _(m):
    return pairs(m).select("pair_id", "n", numbers.equivalent(F.col("actual"), F.col("expected"), F.lit(0.01)).alias("same"))


QUERY_LOG = ["SELECT * FROM orders;", "WITH t AS (SELECT 1) SELECT * FROM t", "DROP TABLE orders;", "", "WITH r AS (DELETE FROM orders RETURNING *) SELECT 1",
             "-- note\nSELECT 1 /* update\nlater */", "SELECT 1; SELECT 2", "SELECT 'update' AS word", "  ;; ", "select created_at from events"]


STATEMENTS = ["{t}", "SELECT {t}", "/* {t} */ WITH x AS (SELECT 1) SELECT 2;", "-- {t}\nselect 1", "select 'x' ; {t}", "{t} update"]
view("m_log", f"""
SELECT 'o' || order_id AS log_id, {sql_pick(QUERY_LOG, 'order_id')} AS sql FROM m_orders
UNION ALL SELECT 'c' || conv_id || '-' || turn || '-' || unnest(range({len(STATEMENTS)})), unnest([{', '.join("replace(" + s.q(x) + ", '{t}', t)" for x in STATEMENTS)}])
FROM (SELECT conv_id, turn, regexp_replace(text, '[^\\x0A\\x20-\\x7E]', ' ', 'g') AS t FROM conversations)""")
# what is left of a statement without comments, and whether it only reads
view("m_read", r"""
SELECT log_id, sql, regexp_matches(plain, '(?i)^\s*(?:SELECT|WITH)\b') AND NOT regexp_matches(plain,
  '(?i)\b(?:ALTER|CALL|COPY|CREATE|DELETE|DO|DROP|EXECUTE|GRANT|INSERT|MERGE|REVOKE|TRUNCATE|UPDATE|VACUUM)\b') AS read_only
FROM (SELECT log_id, sql, trim(regexp_replace(coalesce(sql, ''), '(?s)--[^\r\n]*|/\*.*?\*/', ' ', 'g')) AS plain FROM m_log)""")


def logged(m):
    """Statements to check: those of the orders, and what people say in conversations, put into statements in several ways."""
    o = F.col("order_id")
    own = m.orders().select(F.concat(F.lit("o"), o.cast("string")).alias("log_id"), pick(QUERY_LOG, o).alias("sql"))
    plain = F.regexp_replace("text", r"[^\x0A\x20-\x7E]", " ")
    said = m.spread("conversations").select("conv_id", "turn", plain.alias("t"))
    made = F.array(*[F.replace(F.lit(x), F.lit("{t}"), F.col("t")) for x in STATEMENTS])
    named = said.select("conv_id", "turn", F.posexplode(made).alias("i", "sql"))
    return own.unionByName(named.select(F.concat(F.lit("c"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("i").cast("string"))).alias("log_id"), "sql"))


@query("X25_sql_read_only_flag", "SELECT log_id, read_only FROM m_read")
def _(m):
    return logged(m).select("log_id", sqltext.read_only(F.col("sql")).alias("read_only"))


@query("E03_ev_read_only", "SELECT length(sql) AS size, read_only, count(*) AS logged FROM m_read GROUP BY size, read_only")
def _(m):
    flagged = logged(m).select(F.length("sql").cast("bigint").alias("size"), sqltext.read_only(F.col("sql")).alias("read_only"))
    return flagged.groupBy("size", "read_only").agg(F.count(F.lit(1)).alias("logged"))


# words that a statement cites, those it defines itself (its first two) and those that are known (the words of the language)
view("m_cited", r"""
SELECT log_id, sql, list_sort(list_distinct(list_filter(w, lambda x: NOT list_contains(w[:2], x) AND NOT list_contains(['SELECT', 'select', 'WITH', 'FROM', '1', '2', '*'], x)))) AS unknown
FROM (SELECT log_id, sql, regexp_extract_all(sql, '\w+') AS w FROM m_log)""")


def cited(m):
    said = F.regexp_extract_all("sql", F.lit(r"\w+"), F.lit(0))
    known = F.array(*[F.lit(x) for x in ("SELECT", "select", "WITH", "FROM", "1", "2", "*")])
    return logged(m).select("log_id", "sql", sets.unknown_names(said, F.slice(said, 1, 2), known).alias("unknown"))


@query("U06_set_unknown_tables", "SELECT log_id, array_to_string(unknown, ',') AS unknown FROM m_cited")
def _(m):
    return cited(m).select("log_id", F.array_join("unknown", ",").alias("unknown"))


@query("D10_dq_query_log", """
SELECT stage, count(*) AS logged FROM (
  SELECT CASE WHEN trim(coalesce(t, '')) = '' THEN 'syntax' WHEN contains(t, ';') OR NOT read_only THEN 'statement' WHEN len(unknown) > 0 THEN 'tables' ELSE 'ok' END AS stage
  FROM (SELECT unknown, rtrim(trim(c.sql), ';') AS t, read_only FROM m_cited c JOIN m_read USING (log_id))) GROUP BY stage""")
def _(m):
    staged = cited(m).select(sqltext.stage(F.col("sql"), F.col("unknown")).alias("stage"))
    return staged.groupBy("stage").agg(F.count(F.lit(1)).alias("logged"))


# --- cases ------------------------------------------------------------------------------------

view("m_cases", r"""
SELECT d.doc_id AS case_id, CASE WHEN toxic = 1 THEN 'blocked' WHEN quality = 1 THEN 'success' WHEN quality = 0 THEN 'failed' END AS status,
       CASE WHEN n_chars % 2 = 0 THEN 'success' WHEN lang = 'en' THEN 'blocked' END AS expected_status,
       replace(trim(text), ' ', ',') AS sources, list_filter(regexp_extract_all(translate(text, 'aeiou', 'AEIOU'), '[^\x20\x09-\x0D,]+'), lambda x: length(x) <> 1) AS expected_sources
FROM documents d LEFT JOIN labels l USING (doc_id)""")


def labelled(m):
    """Cases from the documents and their labels; a document without a label has no status."""
    docs = m.spread("documents").select(F.col("doc_id").alias("case_id"), "text", "lang", "source", "n_chars")
    return docs.join(m.raw("labels").select(F.col("doc_id").alias("case_id"), "quality", "toxic"), "case_id", "left")


@query("E01_ev_status", "SELECT case_id, status IS NOT DISTINCT FROM expected_status AS matched FROM m_cases")
def _(m):
    status = F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failed")
    expected = F.when(F.col("n_chars") % 2 == 0, "success").when(F.col("lang") == "en", "blocked")
    return labelled(m).select("case_id", evaluation.status_matches(status, expected).alias("matched"))


# both sides as sets: trimmed, in one case, without repeats and without empty names
SAME_SOURCES_SQL = """
SELECT case_id, list_sort(list_distinct(list_filter(list_transform(string_split(sources, ','), lambda x: {0}), lambda x: x <> '')))
  = list_sort(list_distinct(list_filter(list_transform(expected_sources, lambda x: {0}), lambda x: x <> ''))) AS {1} FROM m_cases"""


def reported_sources(m):
    named = F.regexp_extract_all(F.translate("text", "aeiou", "AEIOU"), F.lit(r"[^\x20\x09-\x0D,]+"), F.lit(0))
    return labelled(m).select("case_id", F.replace(F.trim("text"), F.lit(" "), F.lit(",")).alias("sources"), F.filter(named, lambda x: F.length(x) != 1).alias("wanted"))


@query("U02_set_equality", SAME_SOURCES_SQL.format("lower(trim(x))", "same"))
def _(m):
    return reported_sources(m).select("case_id", sets.same_set(sets.split_names(F.col("sources")), F.col("wanted"), lambda v: F.lower(v)).alias("same"))


@query("E02_ev_sources", SAME_SOURCES_SQL.format(s.casefold("trim(x)"), "matched"))
def _(m):
    return reported_sources(m).select("case_id", evaluation.sources_match(F.col("sources"), F.col("wanted")).alias("matched"))


def fact_cases(m, tolerance):
    """Cases = customers, expected rows = their orders, actual rows = the same with some changes."""
    o, total = F.col("order_id"), F.col("order_total")
    orders = m.orders().select(F.col("customer_id").alias("case_id"), "order_id", "order_total", "order_status",
                               F.date_format("order_purchase_timestamp", "yyyy-MM-dd").alias("day"))
    long = lambda df, values: df.select("case_id", F.col("order_id").alias("row_no"), F.posexplode(F.array(*values)).alias("pos", "value"))
    moved = (total + F.when(o % 50 == 0, 5).when(o % 3 == 0, 0.004).otherwise(0).cast("decimal(6,3)")).cast("string")
    exact = total.cast("string")
    h = F.md5(o.cast("string"))
    expected = long(orders, [exact, F.col("order_status"), h, F.substring("day", 1, 7)])
    actual = long(orders, [F.upper(dashed(h)), F.lit("extra"), F.col("day"), F.initcap("order_status"), moved if tolerance else exact])
    cases = orders.select("case_id").distinct().withColumn("tolerance", F.lit(float(tolerance)))
    return cases, actual, expected


@query("E04_ev_result_facts", """
SELECT customer_id AS case_id, count(*) FILTER (WHERE order_id % 50 = 0) = 0 AS matched FROM m_orders GROUP BY customer_id""")
def _(m):
    return evaluation.result_facts(*fact_cases(m, 0.01))


@query("E04b_ev_result_multiset", """
SELECT customer_id AS case_id, count(*) FILTER (WHERE order_id % 40 = 0) = 0 AS matched FROM m_orders GROUP BY customer_id""")
def _(m):
    cases, _, expected = fact_cases(m, 0)
    changed = F.when((F.col("row_no") % 40 == 0) & (F.col("pos") == 1), "other").otherwise(F.upper("value"))
    actual = expected.withColumn("value", changed).withColumn("pos", 10 - F.col("pos")).withColumn("row_no", -F.col("row_no"))
    return evaluation.result_multiset_equal(cases, actual, expected)


@query("J19_join_result_match", """
SELECT customer_id AS case_id, count(*) AS rows, count(*) FILTER (WHERE order_id % 50 = 0) = 0 AS matched FROM m_orders GROUP BY customer_id""")
def _(m):
    cases, actual, expected = fact_cases(m, 0.01)
    rows = expected.groupBy("case_id").agg(F.count_distinct("row_no").alias("rows"))
    return evaluation.result_facts(cases, actual, expected).join(rows, "case_id")


@query("E05_ev_answer_facts", """
SELECT order_id AS case_id, order_id % 17 <> 0 AND (order_id % 10 = 9 OR (order_id % 11 <> 0 AND order_id % 13 <> 0 AND order_id % 19 <> 0)) AS stated FROM m_orders""")
def _(m):
    o, total = F.col("order_id"), F.col("order_total")
    h = F.md5(o.cast("string"))
    shown = total + F.when(o % 11 == 0, 1).otherwise(0)
    grouped = F.format_number(shown, 2)
    figure = F.when(o % 3 == 0, grouped).when(o % 3 == 1, F.translate(grouped, ",.", ".,")).otherwise(shown.cast("string"))
    status = F.when(o % 13 == 0, "en curso").otherwise(F.upper("order_status"))
    answer = F.when(o % 17 == 0, "  ").otherwise(F.concat(
        F.lit("El pedido de "), F.when(o % 19 == 0, "SPX").otherwise("SP"), F.lit(" suma "), figure, F.lit(" y está "), status, F.lit(" ("), dashed(h), F.lit(").")))
    cases = m.orders().select(o.alias("case_id"), F.lit(0.01).alias("tolerance"), answer.alias("answer"))
    facts = F.array(total.cast("string"), F.col("order_status"), F.lit("sp"), F.upper(h))
    expected = m.orders().filter(o % 10 != 9).select(o.alias("case_id"), F.explode(facts).alias("value"))
    return evaluation.answer_facts(cases, expected)


# two runs of a logged statement: how many rows came back, and where they first differ
view("m_runs_again", """
SELECT log_id AS case_id, read_only, CASE WHEN len(w) > 40 THEN 'timeout' END AS error, len(w) % 3 <> 0 AS matched, len(w) AS expected_rows, len(list_distinct(w)) AS actual_rows,
       CASE WHEN len(w) % 2 = 0 THEN length(w[1]) END AS first_difference
FROM (SELECT log_id, read_only, regexp_extract_all(sql, '[a-z]+') AS w FROM m_read)""")
REFERENCE_SQL = """
SELECT case_id, CASE WHEN NOT read_only OR error IS NOT NULL THEN 'reference_sql_error' WHEN matched THEN 'correct' ELSE 'golden_set_outdated' END AS class,
  CASE WHEN NOT read_only THEN 'not read-only' WHEN error IS NOT NULL THEN error WHEN matched THEN 'match'
       WHEN expected_rows <> actual_rows THEN 'row count: expected=' || expected_rows || ', actual=' || actual_rows
       WHEN first_difference IS NOT NULL THEN 'row differs: ' || first_difference ELSE 'tolerance' END AS reason
FROM m_runs_again"""


def classified(m):
    rows = logged(m).withColumn("w", F.regexp_extract_all("sql", F.lit("[a-z]+"), F.lit(0)))
    n = F.size("w")
    label, reason = evaluation.reference_class(
        F.col("sql"), F.when(n > 40, "timeout"), n % 3 != 0, n, F.size(F.array_distinct("w")), F.when(n % 2 == 0, F.length(F.get("w", F.lit(0)))))
    return rows.select(F.col("log_id").alias("case_id"), label.alias("class"), reason.alias("reason"))


@query("E06_ev_reference_class", REFERENCE_SQL)
def _(m):
    return classified(m)


@query("A24_agg_case_counts", f"""
SELECT c.class, count(r.case_id) AS cases FROM (SELECT unnest({sql_list(evaluation.CLASSES)}) AS class) c
LEFT JOIN (SELECT * FROM ({REFERENCE_SQL}) WHERE class <> 'correct') r ON c.class = r.class GROUP BY c.class""")
def _(m):
    return aggregates.class_counts(classified(m).filter(F.col("class") != "correct"), "class", evaluation.CLASSES)


# --- calibration ------------------------------------------------------------------------------

view("m_eval_cases", "SELECT query_id AS case_id, CASE WHEN query_id % 40 <> 0 THEN label END AS expected FROM m_asked")
view("m_eval_candidates", """
SELECT query_id AS case_id, m.label AS key, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, m.label) AS r
FROM m_near n JOIN m_mem m USING (memory_id) WHERE n.position <= 8""")
# the same for all questions
view("m_sweep_cases", "SELECT query_id AS case_id, CASE WHEN query_id % 40 <> 0 THEN label END AS expected FROM m_askers")
view("m_sweep_candidates", """
SELECT query_id AS case_id, m.label AS key, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, m.label) AS r
FROM m_found n JOIN m_mem m USING (memory_id) WHERE n.position <= 8""")


def calibration(m, step=TENTH):
    from zocalo.queries.memory_queries import asked, memories
    cases = asked(m, step).select(F.col("query_id").alias("case_id"), F.when(F.col("query_id") % 40 != 0, F.col("label")).alias("expected"))
    candidates = near(m, 8, step).join(memories(m).select("memory_id", "label"), "memory_id").select(
        F.col("query_id").alias("case_id"), F.col("label").alias("key"), "distance")
    return cases, candidates


STEPS = [1.0, 1.2, 1.3, 1.35, 1.4, 1.45, 1.5, 1.6, 2.0]
SWEEP_SQL = f"""
SELECT threshold, positive_cases, negative_cases, hits_at_1, hits_at_3, false_positives, correct_candidates, wrong_candidates, cases_with_wrong_candidates,
       CASE WHEN positive_cases > 0 THEN hits_at_1 / positive_cases ELSE 0.0 END AS recall_at_1, CASE WHEN positive_cases > 0 THEN hits_at_3 / positive_cases ELSE 0.0 END AS recall_at_3,
       CASE WHEN correct_candidates + wrong_candidates > 0 THEN correct_candidates / (correct_candidates + wrong_candidates) ELSE 1.0 END AS candidate_precision,
       CASE WHEN negative_cases > 0 THEN false_positives / negative_cases ELSE 0.0 END AS false_positive_rate
FROM (
  SELECT threshold, (SELECT count(expected) FROM m_eval_cases) AS positive_cases, (SELECT count(*) - count(expected) FROM m_eval_cases) AS negative_cases,
         count(DISTINCT case_id) FILTER (WHERE expected IS NOT NULL AND r = 1 AND key = expected) AS hits_at_1,
         count(DISTINCT case_id) FILTER (WHERE expected IS NOT NULL AND r <= 3 AND key = expected) AS hits_at_3,
         count(DISTINCT case_id) FILTER (WHERE expected IS NULL AND r IS NOT NULL) AS false_positives,
         count(*) FILTER (WHERE key = expected) AS correct_candidates,
         count(*) FILTER (WHERE r IS NOT NULL AND (expected IS NULL OR key <> expected)) AS wrong_candidates,
         count(DISTINCT case_id) FILTER (WHERE r IS NOT NULL AND (expected IS NULL OR key <> expected)) AS cases_with_wrong_candidates
  FROM (SELECT CAST(unnest({STEPS}) AS DOUBLE) AS threshold) t LEFT JOIN (SELECT * FROM m_eval_candidates JOIN m_eval_cases USING (case_id)) c ON c.distance <= t.threshold
  GROUP BY threshold)"""


@query("E08_ev_threshold_sweep", SWEEP_SQL.replace("m_eval_", "m_sweep_"))
def _(m):
    return evaluation.threshold_sweep(*calibration(m), STEPS)


MARGIN_SQL = """
SELECT hi AS maximum_positive_distance, lo AS minimum_wrong_distance, lo - hi AS semantic_margin, (lo + hi) / 2 AS midpoint_threshold FROM (
  SELECT max(distance) FILTER (WHERE key = expected) AS hi, min(distance) FILTER (WHERE expected IS NULL OR key <> expected) AS lo
  FROM m_eval_candidates JOIN m_eval_cases USING (case_id))"""


@query("E09_ev_margin", MARGIN_SQL.replace("m_eval_", "m_sweep_"))
def _(m):
    return evaluation.margin(*calibration(m))


@query("E10_ev_recommend_threshold", f"""
WITH sweep AS ({SWEEP_SQL}), gap AS ({MARGIN_SQL}),
best AS (SELECT threshold FROM sweep ORDER BY recall_at_1 DESC, candidate_precision DESC, recall_at_3 DESC, false_positive_rate, threshold LIMIT 1)
SELECT CASE WHEN semantic_margin > 0 THEN round_even(midpoint_threshold, 3) ELSE (SELECT threshold FROM best) END AS threshold FROM gap""")
def _(m):
    pair = calibration(m, FIFTIETH)
    return evaluation.recommend(evaluation.threshold_sweep(*pair, STEPS), evaluation.margin(*pair))


# --- runs and case sets -----------------------------------------------------------------------

view("m_runs", """
SELECT doc_id, lang, evaluator, passed, CAST(('0x' || substr(md5(evaluator || doc_id), 1, 2)) AS INTEGER) % 3 > 0 AS passed_again FROM (
  SELECT doc_id, lang, 'quality' AS evaluator, quality = 1 AS passed FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, lang, 'toxic', toxic = 1 FROM labels JOIN documents USING (doc_id))""")


def runs(m):
    labelled = m.raw("labels").join(m.raw("documents").select("doc_id", "lang"), "doc_id")
    both = labelled.select("doc_id", "lang", F.inline(F.array(
        F.struct(F.lit("quality").alias("evaluator"), (F.col("quality") == 1).alias("passed")),
        F.struct(F.lit("toxic").alias("evaluator"), (F.col("toxic") == 1).alias("passed")))))
    again = F.conv(F.substring(F.md5(F.concat("evaluator", F.col("doc_id").cast("string"))), 1, 2), 16, 10).cast("int") % 3 > 0
    return both.withColumn("passed_again", again)


RATES_SQL = """
SELECT evaluator, coalesce(lang, 'all') AS lang, count(*) FILTER (WHERE {p}) AS passed, count(*) AS total, round(count(*) FILTER (WHERE {p}) / count(*), 6) AS rate
FROM m_runs GROUP BY GROUPING SETS ((evaluator, lang), (evaluator))"""


@query("A26_agg_pass_rate", RATES_SQL.format(p="passed"))
def _(m):
    return aggregates.pass_rates(runs(m), "evaluator", "lang", F.col("passed"))


def delta(m):
    first = aggregates.pass_rates(runs(m), "evaluator", "lang", F.col("passed"))
    second = aggregates.pass_rates(runs(m), "evaluator", "lang", F.col("passed_again"))
    return evaluation.run_delta(first, second, ["evaluator", "lang"], "rate")


@query("J20_join_run_delta", f"""
SELECT evaluator, lang, a.rate AS before, b.rate AS after, round(b.rate - a.rate, 6) AS delta
FROM ({RATES_SQL.format(p='passed')}) a FULL JOIN ({RATES_SQL.format(p='passed_again')}) b USING (evaluator, lang)""")
def _(m):
    return delta(m)


@query("E11_ev_pass_rates", f"""
SELECT evaluator, count(*) FILTER (WHERE d > 0) AS better, count(*) FILTER (WHERE d < 0) AS worse FROM (
  SELECT evaluator, b.rate - a.rate AS d FROM ({RATES_SQL.format(p='passed')}) a JOIN ({RATES_SQL.format(p='passed_again')}) b USING (evaluator, lang)) GROUP BY evaluator""")
def _(m):
    return delta(m).groupBy("evaluator").agg(F.count_if(F.col("delta") > 0).alias("better"), F.count_if(F.col("delta") < 0).alias("worse"))


SYNC_SQL = """
SELECT coalesce(l.order_id, r.order_id) AS order_id, CASE WHEN r.order_id IS NULL THEN 'created' WHEN l.order_id IS NULL THEN 'remote_only'
  WHEN l.order_total = r.order_total AND l.order_status = r.order_status THEN 'unchanged' ELSE 'updated' END AS status
FROM m_orders l FULL JOIN (
  SELECT order_id, order_status, CASE WHEN order_id % 11 = 0 THEN CAST(order_total + 1 AS DECIMAL(12,2)) ELSE order_total END AS order_total FROM m_orders WHERE order_id % 7 <> 0
  UNION ALL SELECT order_id + 1000000000, order_status, order_total FROM m_orders WHERE order_id % 13 = 0) r ON l.order_id = r.order_id"""


def synced(m):
    o = F.col("order_id")
    local = m.orders().select("order_id", "order_status", "order_total")
    stored = local.filter(o % 7 != 0).withColumn("order_total", F.when(o % 11 == 0, F.col("order_total") + 1).otherwise(F.col("order_total")).cast("decimal(12,2)"))
    only = local.filter(o % 13 == 0).withColumn("order_id", o + 1_000_000_000)
    return evaluation.sync_status(local, stored.unionByName(only), "order_id", ["order_status", "order_total"])


@query("J15_join_sync_diff", SYNC_SQL)
def _(m):
    return synced(m)


@query("E07_ev_sync", f"SELECT status, count(*) AS cases FROM ({SYNC_SQL}) GROUP BY status")
def _(m):
    return synced(m).groupBy("status").agg(F.count(F.lit(1)).alias("cases"))


def tree_sql(rows: str, levels: int) -> str:
    for _ in range(levels):
        rows = f"SELECT p // 1024 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM ({rows}) GROUP BY p // 1024"
    return rows


@query("X10_hash_dataset", f"""
SELECT h AS content_sha256 FROM ({tree_sql("SELECT order_id AS p, sha256(order_status || ':' || CAST(order_total AS VARCHAR)) AS h FROM m_orders", 7)})""")
def _(m):
    return evaluation.content_hash(m.orders(), "order_id", F.concat_ws(":", "order_status", F.col("order_total").cast("string")))


@query("D09_dq_case_contract", r"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(coalesce(source, '')) = '' OR lang = 'fr' THEN 'case_id' END, CASE WHEN trim(coalesce(first, '')) = '' THEN 'question' END,
  CASE WHEN NOT labelled THEN 'reference_outputs' END, CASE WHEN rows IS NULL OR rows <> lines THEN 'row_count' END,
  CASE WHEN version IS DISTINCT FROM '2.1.0' THEN 'dataset_version' END], lambda e: e IS NOT NULL), ',') AS errors
FROM (SELECT doc_id, source, lang, substr(text, 1, 1) AS first, quality IS NOT NULL AS labelled, CASE WHEN toxic = 0 THEN len(string_split(text, chr(10))) END AS rows,
             len(string_split(trim(text, chr(10)), chr(10))) AS lines, CASE WHEN lang IS NOT NULL THEN CASE WHEN n_chars > 300 THEN '2.1.0' ELSE '1.0' END END AS version
      FROM documents LEFT JOIN labels USING (doc_id))""")
def _(m):
    lines = lambda t: F.size(F.split(t, "\n", -1))
    cases = labelled(m).select(
        F.col("case_id").alias("doc_id"), F.when(~F.coalesce(F.col("lang") == "fr", F.lit(False)), F.col("source")).alias("case_id"), F.substring("text", 1, 1).alias("question"),
        F.col("quality").isNotNull().alias("has_reference"), F.when(F.col("toxic") == 0, lines(F.col("text"))).alias("row_count"), lines(F.btrim("text", F.lit("\n"))).alias("rows_given"),
        F.when(F.col("lang").isNotNull(), F.when(F.col("n_chars") > 300, "2.1.0").otherwise("1.0")).alias("version"), F.lit("2.1.0").alias("expected_version"))
    return cases.select("doc_id", F.array_join(quality.case_errors(), ",").alias("errors"))


# --- result sets ------------------------------------------------------------------------------

view("m_lines", """
SELECT l_orderkey AS result_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS discount, l_linenumber AS line FROM lineitem""")
view("m_cells", """
SELECT result_id, row_no, CAST(unnest([0, 1, 2]) AS INTEGER) AS pos, unnest(['avg_price', 'discount_rate', 'line']) AS col,
       unnest([CAST(price AS DOUBLE), CASE WHEN result_id % 9 <> 0 THEN CAST(discount AS DOUBLE) END, CAST(line AS DOUBLE)]) AS num FROM m_lines""")


def cells(m):
    lines = m.raw("lineitem").select(F.col("l_orderkey").alias("result_id"), F.monotonically_increasing_id().alias("row_no"),
                                     F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_linenumber").alias("line"))
    pair = lambda name, value: F.struct(F.lit(name).alias("col"), value.cast("double").alias("num"))
    rate = F.when(F.col("result_id") % 9 != 0, F.col("discount"))
    return (lines.select("result_id", "row_no", F.posexplode(F.array(pair("avg_price", F.col("price")), pair("discount_rate", rate), pair("line", F.col("line")))))
            .select("result_id", "row_no", "pos", "col.col", "col.num"))


@query("D01_dq_result_health", """
SELECT o.order_id AS result_id, coalesce(n, 0) AS row_count, coalesce(n, 0) = 0 AS empty, coalesce(n, 0) = 4 AS maybe_cut,
       CASE WHEN coalesce(n, 0) > 0 AND o.order_id % 9 = 0 THEN 1 ELSE 0 END::BIGINT AS null_metrics
FROM m_orders o LEFT JOIN (SELECT result_id, count(*) AS n FROM m_lines GROUP BY 1) l ON l.result_id = o.order_id""")
def _(m):
    results = m.orders().select(F.col("order_id").alias("result_id"))
    wanted = results.select("result_id", F.explode(F.array(F.lit("PRICE"), F.lit("rate"), F.lit("other"))).alias("metric"))
    return quality.result_health(cells(m), wanted, results, cap=4)


view("m_answers", """
SELECT result_id, CAST(max(price) AS DOUBLE) AS top, max(price) AS shown, count(*) AS n, CAST(max(discount) * 100 AS INTEGER) AS pct FROM m_lines GROUP BY result_id""")


@query("D02_dq_groundedness", """
WITH said AS (
  SELECT result_id, CAST(CASE WHEN result_id % 5 = 0 THEN shown * 2 ELSE shown END AS VARCHAR) AS raw, false AS percent FROM m_answers
  UNION SELECT result_id, CAST(pct AS VARCHAR), true FROM m_answers UNION SELECT result_id, CAST(n AS VARCHAR), false FROM m_answers
  UNION SELECT result_id, '87,65', true FROM m_answers WHERE result_id % 4 = 0),
parsed AS (SELECT *, CAST(replace(raw, ',', '.') AS DOUBLE) AS x FROM said),
shown AS (SELECT result_id, false AS percent, num AS v FROM m_cells WHERE num IS NOT NULL
          UNION ALL SELECT result_id, true, num * 100 FROM m_cells WHERE num IS NOT NULL AND col = 'discount_rate' AND abs(num) <= 1)
SELECT result_id, raw || CASE WHEN percent THEN ' %' ELSE '' END AS number FROM parsed p
WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.result_id = p.result_id AND s.percent = p.percent AND abs(p.x - s.v) <= 0.01 * greatest(abs(s.v), 1))""")
def _(m):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    facts = m.raw("lineitem").groupBy(F.col("l_orderkey").alias("result_id")).agg(
        F.max(price).alias("shown"), F.count(F.lit(1)).alias("n"), (F.max(F.col("l_discount").cast("decimal(4,2)")) * 100).cast("int").alias("pct"))
    r = F.col("result_id")
    figure = F.when(r % 5 == 0, F.col("shown") * 2).otherwise(F.col("shown")).cast("decimal(13,2)").cast("string")
    extra = F.when(r % 4 == 0, " (87,65%)").otherwise("")
    answer = F.concat(F.lit("Total máximo "), figure, F.lit(" con "), F.col("pct").cast("string"), F.lit(" % en "), F.col("n").cast("string"), F.lit(" líneas"), extra)
    return quality.unsupported_numbers(facts.select("result_id", answer.alias("answer")), cells(m))


@query("A27_agg_row_summary", """
SELECT result_id, count(*) AS row_count, 'avg_price,discount_rate,line' AS columns FROM m_lines GROUP BY result_id""")
def _(m):
    return quality.row_summary(cells(m)).withColumn("columns", F.array_join("columns", ","))


# --- redaction --------------------------------------------------------------------------------

def redact_sql(x: str) -> str:
    for _, pattern, becomes in redaction.PATTERNS:
        option = "gi" if pattern.startswith("(?i)") else "g"
        x = f"regexp_replace({x}, {s.q(pattern.removeprefix('(?i)'))}, {s.q(becomes.replace('$1', chr(92) + '1'))}, '{option}')"
    return x


SECRETS = ["postgresql+psycopg://user:pw@host:5432/db now", "Authorization: bearer abc.DEF-123", "key lsv2_pt_abc123 end", "AIza" + "x" * 24 + " used",
           "mail ana.perez@example.com now", "id 123e4567-e89b-12d3-a456-426614174000.", "api_key: s3cr3t, Password=hunter2; ok", "nothing here"]
view("m_payloads", f"""
SELECT 'd' || doc_id AS text_id, text FROM documents
UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
UNION ALL SELECT 'o' || order_id, {sql_pick(SECRETS, 'order_id')} || ' ' || md5(CAST(order_id AS VARCHAR)) FROM m_orders""")


def payloads(m):
    from zocalo.queries.text_queries import texts
    given = texts(m).filter(~F.startswith("text_id", F.lit("o")) & ~F.startswith("text_id", F.lit("c-")))
    made = m.orders().select(F.concat(F.lit("o"), F.col("order_id").cast("string")).alias("text_id"),
                             F.concat(pick(SECRETS, F.col("order_id")), F.lit(" "), F.md5(F.col("order_id").cast("string"))).alias("text"))
    return given.unionByName(made)


@query("D11_dq_redact_text", f"SELECT text_id, {redact_sql('text')} AS text FROM m_payloads")
def _(m):
    return payloads(m).select("text_id", redaction.redact(F.col("text")).alias("text"))


@query("D11b_dq_redact_hits", """
SELECT sum(len(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b')))::BIGINT AS email,
       (SELECT count(*) FROM m_payloads WHERE contains(text, '://user:pw@host')) AS database_url FROM m_payloads""")
def _(m):
    counts = redaction.hits(F.col("text"))
    return payloads(m).agg(F.sum(counts["email"]).cast("bigint").alias("email"), F.sum(counts["database_url"]).cast("bigint").alias("database_url"))


def leaves(m):
    """Nested payloads of the orders as (payload_id, pos, path, value) leaves."""
    o = F.col("order_id")
    path = lambda *keys: F.array(*[F.lit(k) if isinstance(k, str) else k for k in keys])
    leaf = lambda p, value: F.struct(p.alias("path"), value.cast("string").alias("value"))
    deep = path(*[f"k{i}" for i in range(12)])
    rows = [leaf(path("question"), F.concat(F.lit("mail a@b.io "), o.cast("string"))), leaf(path("config", "My-API-Key"), o), leaf(path("config", "user"), o),
            leaf(path("auth", "Token", "inner"), o), leaf(path("auth", "Token", "other"), o), leaf(deep, o),
            leaf(path("rows", "[0]", "carrier"), o), leaf(path("rows", "[0]", "rate"), o), leaf(path("rows", "[1]", "extra"), o), leaf(path("list", "[0]"), o)]
    return m.orders().select(o.alias("payload_id"), F.posexplode(F.array(*rows)).alias("pos", "leaf")).select("payload_id", "pos", "leaf.path", "leaf.value")


def spoken_leaves(m):
    """Payloads of conversation turns: the words of a turn as keys, twelve deep at most, some of them named like secrets, over its text."""
    plain = F.regexp_replace("text", r"[^\x0A\x20-\x7E]", " ")
    turn = m.spread("conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("payload_id"), plain.alias("t"))
    said = turn.select("payload_id", "t", F.slice(F.regexp_extract_all("t", F.lit("[A-Za-z]+"), F.lit(0)), 1, 12).alias("w")).filter(F.size("w") > 0)
    key = lambda x: F.concat(F.lit("k "), x, F.when(F.length(x) % 9 == 0, "-Token").when(F.length(x) % 7 == 0, " API key").otherwise(""))
    secret = F.concat(F.element_at("w", 1), F.lit("@site.org says password: "), F.element_at("w", -1), F.lit(" "), F.col("t"))
    return said.select("payload_id", F.lit(0).alias("pos"), F.transform("w", key).alias("path"), secret.alias("value"))


@query("D12_dq_redact_keys", f"""
WITH spoken AS (
  SELECT payload_id, list_transform(w, lambda x: 'k ' || x || CASE WHEN length(x) % 9 = 0 THEN '-Token' WHEN length(x) % 7 = 0 THEN ' API key' ELSE '' END) AS path,
         w[1] || '@site.org says password: ' || w[-1] || ' ' || t AS value FROM (
    SELECT payload_id, t, (regexp_extract_all(t, '[A-Za-z]+'))[1:12] AS w FROM (
      SELECT 'c-' || conv_id || '-' || turn AS payload_id, regexp_replace(text, '[^\\x0A\\x20-\\x7E]', ' ', 'g') AS t FROM conversations)) WHERE len(w) > 0),
found AS (
  SELECT payload_id, path, value, coalesce(list_position(list_transform(list_transform(path, lambda k: trim(regexp_replace(lower(k), '[^a-z0-9]+', '_', 'g'), '_')),
    lambda k: list_contains({sql_list(redaction.SENSITIVE_KEYS)}, k) OR regexp_matches(k, '(_api_key|_password|_secret|_token)$')), true), 0) AS hidden FROM spoken)
SELECT payload_id, array_to_string(CASE WHEN hidden BETWEEN 1 AND 10 THEN path[1:hidden] ELSE path[1:10] END, '.') AS path,
       CASE WHEN hidden BETWEEN 1 AND 10 THEN '[REDACTED]' WHEN len(path) >= 10 THEN '[MAX_DEPTH_REACHED]' ELSE {redact_sql('value')} END AS value FROM found
UNION ALL SELECT 'o' || order_id AS payload_id, unnest(['question', 'config.My-API-Key', 'config.user', 'auth.Token', 'k0.k1.k2.k3.k4.k5.k6.k7.k8.k9', 'rows_summary', 'list.[0]']) AS path,
       unnest(['mail [REDACTED_EMAIL] ' || order_id, '[REDACTED]', CAST(order_id AS VARCHAR), '[REDACTED]', '[MAX_DEPTH_REACHED]', '{{"row_count":2,"columns":["carrier","rate","extra"]}}', CAST(order_id AS VARCHAR)]) AS value
FROM m_orders""")
def _(m):
    own = leaves(m).withColumn("payload_id", F.concat(F.lit("o"), F.col("payload_id").cast("string")))
    return quality.redact_leaves(spoken_leaves(m).unionByName(own)).withColumn("path", F.array_join("path", "."))
