import pytest
from pyspark.sql import functions as F

from zocalo.functions import text
from zocalo.operators import rules, structuring

QUESTIONS = {
    "carrier": "Que transportista tiene la mayor tasa de cumplimiento?",
    "month": "Cual fue el total vendido por mes en 2018?",
    "stock": "Que productos tienen stock critico bajo el punto de reorden?",
    "card": "Cuantas ordenes canceladas hubo en SP con tarjeta?",
    "open": "¿Cuántos tickets de soporte están sin resolver?",
    "pending": "¿Cuántos pedidos pendientes existen?",
    "sellers": "¿Cuáles son los 5 estados de vendedores con más registros de inventario bajo el punto de reorden?",
    "nation": "¿Hay algún proveedor estadounidense?",
    "tickets": "¿Cuántos tickets hay por categoría y qué porcentaje fue resuelto?",
    "words": "Al llegar se ve que es tarde",
    "blank": "   ",
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(list(QUESTIONS.items()), "k string, question string")
    return {r["k"]: r for r in structuring.structure(df, "question").collect()}


def test_structured_fields(found):
    assert "blank" not in found
    assert found["carrier"]["intent"] == "ranking" and found["carrier"]["metrics"] == ["on_time_rate"]
    assert found["carrier"]["normalized_question"].startswith("Listar transportistas")
    assert found["carrier"]["operation"] == "rank_desc"
    assert found["month"]["intent"] == "temporal_trend" and found["month"]["group_by"] == ["month"]
    assert found["month"]["date_range"].asDict() == {"start_date": "2018-01-01", "end_date": "2018-12-31"}
    assert {"stock_qty", "reorder_point", "order_count"} == set(found["stock"]["metrics"])  # "reorden" contains "orden"
    assert [(f.field, f.value) for f in found["card"]["filters"]] == [
        ("state", "SP"), ("order_status", "canceled"), ("payment_type", "credit_card")]
    assert found["open"]["metrics"] == ["ticket_count"] and found["open"]["filters"][0].value == "false"
    assert found["pending"]["filters"] == [] and found["pending"]["metrics"] == ["order_count"]
    assert "olist_sellers_dataset" in found["sellers"]["suggested_tables"]
    assert "olist_customers_dataset" not in found["sellers"]["suggested_tables"]
    assert found["nation"]["suggested_tables"] == []
    assert "product_category_name_translation" not in found["tickets"]["suggested_tables"]
    assert found["words"]["filters"] == []


def test_rule_catalogue_join_agrees_with_compiled_rules(spark):
    texts = list(QUESTIONS.values()) + ["pre-estado; uf", "cliente, unico", "Cliente  único", "estado de la orden"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    joined = {(r["k"], r["rule_id"]) for r in rules.tag_texts(df, "k", "t", rules.term_table(spark)).collect()}
    compiled = df.select("k", F.explode(rules.fired_rules(rules.matching_form(F.col("t")))).alias("rule_id"))
    assert joined == {(r["k"], r["rule_id"]) for r in compiled.collect()}
    assert joined


def test_accents_native_and_any_script(spark):
    samples = ["São_Paulo ÑANDÚ", "ﬁn… ½", "Straße ÇÉ", "éä", "plain", "Ελλάδα Йод", None]
    df = spark.createDataFrame([(s,) for s in samples], "x string").select(
        "x", text.fold(F.col("x")).alias("native"), text.fold_any_script("x").alias("exact"), text.compare_form(F.col("x")).alias("form"))
    rows = df.collect()
    assert [r["native"] for r in rows] == [r["exact"] for r in rows]
    assert rows[0]["form"] == "sao paulo nandu" and rows[2]["form"] == "strasse ce"


def test_rule_terms_of_any_length_and_with_marks(spark):
    terms = ["pre-venta", "uno dos tres cuatro cinco seis", "a/b", "c"]
    own = [rules.Rule(f"r{i}", [t], [], [], [], "") for i, t in enumerate(terms)]
    texts = ["La Pre-Venta hoy", "pre - venta", "preventa", "uno dos tres cuatro cinco seis", "uno dos tres cuatro cinco", "es a/b, c", "-c-", "c", "a / b", "¿c?"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    joined = {(r["k"], r["rule_id"]) for r in rules.tag_texts(df, "k", "t", rules.term_table(spark, own)).collect()}
    folded = df.select("k", F.explode(rules.fired_rules(rules.matching_form(F.col("t")), own)).alias("rule_id"))
    assert joined == {(r["k"], r["rule_id"]) for r in folded.collect()} and (0, "r0") in joined and (3, "r1") in joined


def test_folding_of_other_scripts_and_long_labels(spark):
    from zocalo.functions.labels import column_label
    row = spark.createDataFrame([("ＡＢＣ ガ हि̃", "x" * 1500)], "x string, y string").select(
        text.fold(F.col("x")).alias("native"), text.fold_any_script("x").alias("exact"), F.length(column_label(F.col("y"))).alias("n")).first()
    assert row["native"] == row["exact"] and row["n"] == 1500


def test_folding_equals_full_decomposition_in_every_script(spark):
    import unicodedata
    points = [c for a, b in ((0x80, 0xD800), (0xE000, 0x20000), (0x2F800, 0x2FA20), (0xE0100, 0xE01F0)) for c in range(a, b) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    texts = ["".join("x" + chr(c) for c in points[i:i + 40]) for i in range(0, len(points), 40)] + ["한국어 각 가힣", "㍿ ﷺ ㌀ ½ … 𝔘𝔫𝔦 ①⑳ ☎ 漢字 豈 丽", "a\0b é"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", text.without_accents(F.col("x")).alias("native"))
    wrong = [(r["x"], r["native"]) for r in df.collect() if r["native"] != text.strip_marks(r["x"])]
    assert not wrong, wrong[:2]
