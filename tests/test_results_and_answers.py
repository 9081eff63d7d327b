import pytest
from pyspark.sql import functions as F

from zocalo.functions import numbers, redaction, sqltext
from zocalo.functions.labels import column_label
from zocalo.operators import evaluation, presentation, quality
from zocalo.session import run_dir
from zocalo.sources import readers, sinks


def long(spark, case, table):
    return spark.createDataFrame([(case, r, p, v) for r, row in enumerate(table) for p, v in enumerate(row)], "case_id string, row_no int, pos int, value string")


@pytest.mark.parametrize("tolerance,actual,expected,matched", [
    (0.01, [["4.0872966183574879"]], [["4.09"]], True),
    (0.01, [["4869f7a5-dfa2-77a7-dca6-462dcf3b52b2", "226987.93", "fila principal"]], [["4869f7a5dfa277a7dca6462dcf3b52b2", "226987.93"]], True),
    (0.0, [["voucher", "2"], ["credit_card", "10"], ["boleto", "5"]], [["credit_card", "10"], ["boleto", "5"], ["voucher", "2"]], True),
    (0.0, [["2018-03-01"]], [["2018-03"]], True),
    (0.0, [["1"], ["1"]], [["1"]], False),
    (0.0, [["a", "2"]], [["a", "3"]], False),
])
def test_result_facts(spark, tolerance, actual, expected, matched):
    cases = spark.createDataFrame([("c", tolerance)], "case_id string, tolerance double")
    got = evaluation.result_facts(cases, long(spark, "c", actual), long(spark, "c", expected)).collect()
    assert [r["matched"] for r in got] == [matched]


def test_answer_facts(spark):
    answers = {"states": "Los estados con más órdenes son SP (40,501), RJ (12,350) y PR (4,923).", "none": "nada", "silent": " "}
    cases = spark.createDataFrame([(k, 0.01, v) for k, v in answers.items()], "case_id string, tolerance double, answer string")
    expected = spark.createDataFrame([("states", v) for v in ("SP", "40501", "rj", "12350", "PR", "4923")], "case_id string, value string")
    got = {r["case_id"]: r["stated"] for r in evaluation.answer_facts(cases, expected).collect()}
    assert got == {"states": True, "none": True, "silent": False}
    missing = expected.unionByName(spark.createDataFrame([("none", "40501")], "case_id string, value string"))
    assert not {r["case_id"]: r["stated"] for r in evaluation.answer_facts(cases, missing).collect()}["none"]


def test_readings_of_printed_numbers(spark):
    shown = {"1,234.56": [1234.56], "1.234,56": [1234.56], "1,234": [1.234, 1234.0], "12,5": [12.5], "-1,000,000": [-1000000.0], "7.": [7.0]}
    df = spark.createDataFrame([(k,) for k in shown], "t string").select("t", F.transform(numbers.readings(F.col("t")), lambda n: n.cast("double")).alias("r"))
    assert {r["t"]: r["r"] for r in df.collect()} == shown


def test_unsupported_numbers(spark):
    answers = [("ok", "cumple con 0.97."), ("bad", "hay 452 pedidos"), ("pct", "cumple 96,0 %"), ("pct_bad", "cumple 87,6 %"), ("split", "suma 1.234,5")]
    cells = [("ok", "on_time_rate", 0.97), ("bad", "on_time_rate", 0.97), ("pct", "on_time_rate", 0.96), ("pct_bad", "on_time_rate", 0.96), ("split", "total", 1.234)]
    got = quality.unsupported_numbers(spark.createDataFrame(answers, "result_id string, answer string"), spark.createDataFrame(cells, "result_id string, col string, num double"))
    assert sorted(map(tuple, got.collect())) == [("bad", "452"), ("pct_bad", "87,6 %"), ("split", "5")]


def test_unsupported_numbers_against_brute_force(spark):
    said = [(1, round(0.003 * i ** 2, 2)) for i in range(1, 120)]
    values = [(1, "v", round(0.0031 * i ** 2 - 3, 3)) for i in range(1, 120, 3)]
    answers = spark.createDataFrame([(1, " ; ".join(str(x) for _, x in said))], "result_id int, answer string")
    got = {r["number"] for r in quality.unsupported_numbers(answers, spark.createDataFrame(values, "result_id int, col string, num double")).collect()}
    assert got == {str(x) for _, x in said if not any(abs(x - v) <= 0.01 * max(abs(v), 1) for _, _, v in values)}


def test_read_only_and_redaction(spark):
    queries = {"SELECT * FROM orders;": True, "WITH t AS (SELECT 1) SELECT * FROM t": True, "DROP TABLE x": False,
               "WITH r AS (DELETE FROM x RETURNING *) SELECT 1": False, "": False}
    df = spark.createDataFrame([(q,) for q in queries], "q string").select("q", sqltext.read_only(F.col("q")).alias("ok"))
    assert {r["q"]: r["ok"] for r in df.collect()} == queries
    texts = {"password=abc, ok": "password=[REDACTED], ok", "a.b@c.org": "[REDACTED_EMAIL]", "Bearer x.y": "Bearer [REDACTED]", "mysql://u:p@h/db": "[REDACTED]"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", redaction.redact(F.col("t")).alias("r"))
    assert {r["t"]: r["r"] for r in df.collect()} == texts


def test_display(spark):
    cells = [("order_count", "int", "1946", "1,946"), ("average_revenue", "float", "140.7401589162433242", "140.74"), ("comment", "null", None, "—"),
             ("on_time_rate", "float", "0.97", "97.00 %"), ("completion_rate", "int", "97", "97.00 %"), ("active", "bool", "true", "Sí"),
             ("order_date", "text", "2026-07-20", "20/07/2026"), ("created_at", "datetime", "2026-07-20 14:35:10", "20/07/2026 14:35:10"),
             ("customer_id", "int", "123456789", "123456789"), ("year", "int", "2026", "2026")]
    df = spark.createDataFrame([("r", 0, i, k, kind, v) for i, (k, kind, v, _) in enumerate(cells)], "result_id string, row_no int, pos int, key string, kind string, value string")
    got = {r["key"]: r["display"] for r in presentation.result_table(df).collect()}
    assert got == {k: shown for k, _, _, shown in cells}
    names = {"carrier_name": "Transportista", "total_orders": "Total pedidos", "custom_metric_xyz": "Custom metric xyz", "order_item_id": "ID del ítem del pedido"}
    labels = spark.createDataFrame([(n,) for n in names], "n string").select("n", column_label(F.col("n")).alias("l")).collect()
    assert {r["n"]: r["l"] for r in labels} == names


def test_case_file_is_strict(spark, tmp_path):
    good, broken = tmp_path / "good.jsonl", tmp_path / "broken.jsonl"
    good.write_text('{"case_id": "a"}\n\n{"case_id": "b", "enabled": false}\n', encoding="utf-8")
    broken.write_text('{"case_id": "a"}\n{"case_id": "a"}\n', encoding="utf-8")
    assert [r["case_id"] for r in readers.enabled_cases(spark, str(good)).collect()] == ["a"]
    with pytest.raises(ValueError):
        readers.enabled_cases(spark, str(broken))


def test_catalogue_and_bank_files(spark, tmp_path):
    catalogue, bank = tmp_path / "catalogue.json", tmp_path / "bank.json"
    catalogue.write_text('[{"id": "tabla_1", "nombre": "t", "ddl": "x"}, {"id": "tabla_2", "politicas": ["p"]}]', encoding="utf-8")
    bank.write_text('\ufeff{"memories": [{"key": "m", "metrics": ["revenue"]}], "cases": [{"id": "c"}, {"id": "d"}]}', encoding="utf-8")
    assert [r["politicas"] for r in readers.table_catalogue(spark, str(catalogue)).orderBy("id").collect()] == [[], ["p"]]
    memories, cases = readers.memory_bank(spark, str(bank))
    assert memories.first()["status"] == "success" and cases.count() == 2


def test_store_keeps_versions(spark):
    store = sinks.MemoryStore(spark, run_dir(spark, "store"))
    assert store.read() is None
    assert store.write(spark.range(3)) == 0 and store.write(spark.range(5), 4) == 4
    for taken in (4, 1):
        with pytest.raises(ValueError):
            store.write(spark.range(9), taken)
    assert store.read().count() == 5 and store.write(spark.range(2)) == 5


def test_csv_keeps_quotes_breaks_nulls_and_empty_text(spark):
    folder = run_dir(spark, "csv")
    texts = ['say "hi", now', "two\nlines", "", None, "back\\slash", '"', "a,b", " x "]
    rows = list(enumerate(texts))
    sinks.write_csv_tables({"t": spark.createDataFrame(rows, "id int, text string")}, folder)
    assert sorted(map(tuple, readers.csv_table(spark, f"{folder}/t", "id int, text string").collect())) == rows


def test_csv_of_other_writers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"a ""b"" c"\n2,"x\ny"\n3,\n4,""\n', encoding="utf-8")
    got = readers.csv_table(spark, str(tmp_path / "t.csv"), "id int, text string").orderBy("id").collect()
    assert [r["text"] for r in got] == ['a "b" c', "x\ny", None, ""]


def test_result_matching_of_many_rows(spark):
    n = 5000
    cases = spark.createDataFrame([(1, 0.01), (2, 0.01)], "case_id int, tolerance double")
    expected = spark.range(n).selectExpr("explode(array(1, 2)) AS case_id", "id AS row_no", "array(cast(id AS string), concat('name ', id % 50)) AS v")
    actual = spark.range(n).selectExpr("explode(array(1, 2)) AS case_id", "id AS row_no",
                                       "array(concat('NAME ', (4999 - id) % 50), cast(4999 - id + IF(case_id = 2 AND id = 7, 3000.5, 0.004) AS string)) AS v")
    long = lambda df: df.selectExpr("case_id", "row_no", "posexplode(v) AS (pos, value)")
    got = evaluation.result_facts(cases, long(actual), long(expected)).collect()
    assert {r["case_id"]: r["matched"] for r in got} == {1: True, 2: False}


def test_components_of_a_large_case_match_as_the_whole_does(spark):
    import random
    rng = random.Random(3)
    value = lambda: rng.choice(["a", "b", "2018-03-01", "2018-03", "1.0", "1.004", "7", "7.009", None, "4869f7a5-dfa2-77a7-dca6-462dcf3b52b2", "x y", "1e300"])
    cases, actual, expected = [], [], []
    for case in range(60):
        wanted = [[value() for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 6))]
        held = [row + [value()] * rng.randint(0, 1) for row in wanted]
        if rng.random() < 0.5:
            rng.choice(held)[0] = value()
        rng.shuffle(held)
        cases.append((case, 0.01))
        expected += [(case, r, p, v) for r, row in enumerate(wanted) for p, v in enumerate(row)]
        actual += [(case, r, p, v) for r, row in enumerate(held) for p, v in enumerate(row)]
    of = lambda rows: spark.createDataFrame(rows, "case_id int, row_no int, pos int, value string")
    asked = spark.createDataFrame(cases, "case_id int, tolerance double")
    told = [{r["case_id"]: r["matched"] for r in evaluation.result_facts(asked, of(actual), of(expected), large).collect()} for large in (0, 1000)]
    assert told[0] == told[1] and set(told[0].values()) == {True, False}


def test_bucket_store_rewrites_touched_buckets_only(spark):
    store = sinks.BucketStore(spark, run_dir(spark, "buckets"), "k", buckets=8)
    fold = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    frame = lambda keys: spark.createDataFrame([(f"k{i}", 1) for i in keys], "k string, n long")
    assert store.read() is None
    store.merge(frame(range(50)), fold)
    before = {r["bucket"]: r["path"] for r in store.ledger.last()[1]}
    store.merge(frame([3]), fold)
    after = {r["bucket"]: r["path"] for r in store.ledger.last()[1]}
    assert sum(before[b] != after[b] for b in before) == 1
    for _ in range(3):
        store.merge(frame([3, 60]), fold)
    assert {r["k"]: r["n"] for r in store.read().collect()} == {f"k{i}": 1 for i in range(50)} | {"k3": 5, "k60": 3}
    assert len(store.ledger.versions()) == 2 and {r["k"]: r["n"] for r in store.read(store.ledger.versions()[0]).collect()}["k3"] == 4


def test_every_row_asks_by_name(spark):
    from zocalo.queries import QUERIES
    path = "/root/testdata/sf0.001"
    ids = {r["vec_id"] for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id").collect()}
    expected = {(i, f"table_{i + n}", p) for i in ids for n, p in ((1, 0), (2, 1), (13, 5)) if i + n in ids and (i + n) % 13}
    got = [(r["query_id"], r["table"], r["position"]) for r in QUERIES["J08_join_exact_name_lookup"].run(spark, path).collect()]
    assert len(got) == len(expected) and set(got) == expected
