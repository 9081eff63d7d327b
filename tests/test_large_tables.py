"""Jobs over tables that do not fit the driver, come in folders or have very many small groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from zocalo import streaming
from zocalo.operators import presentation
from zocalo.session import run_dir


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_result_table_sends_no_side_through_the_driver(spark, tmp_path):
    rows = [("r", n, p, key, kind, value) for n in range(3) for p, (key, kind, value) in enumerate([
        ("order_date", "text", "2026-07-20"), ("comment", "text", "2026-07-20"), ("seen_at", "text", f"2026-07-20T10:0{n}"), ("n", "int", "5")]) if n != 1 or p != 1]
    spark.createDataFrame(rows, "result_id string, row_no int, pos int, key string, kind string, value string").write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")  # a source whose size is known to be small
    table = presentation.result_table(cells)
    assert "Broadcast" not in plan(table)
    got = {(r["row_no"], r["key"]): (r["first"]["row_no"], r["first"]["pos"], r["type"], r["display"]) for r in table.collect()}
    assert len(got) == 12 and got[0, "order_date"] == (0, 0, "date", "20/07/2026") and got[2, "comment"] == (0, 1, "text", "2026-07-20")
    assert got[1, "comment"] == (0, 1, "text", "—") and got[2, "seen_at"] == (0, 2, "datetime", "20/07/2026 10:02:00") and got[1, "n"] == (0, 3, "integer", "5")


def test_a_table_in_a_folder_of_files_streams_like_one_file(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"mail a{i}@b.org") for i in range(20)], "doc_id long, text string")
    texts.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    texts.write.parquet(f"{tmp_path}/other.parquet")
    stream = streaming.file_stream(spark, str(tmp_path), "documents.parquet", 3)
    got = streaming.run_to_end(streaming.redacted(stream, "text"), run_dir(spark, "redact"))
    assert sorted(map(tuple, got.collect())) == [(i, "mail [REDACTED_EMAIL]") for i in range(20)]


TENTH = ["J09_join_knn_threshold", "W01_win_best_per_key", "M04_mem_search", "M04b_mem_search_prefilter", "J18_join_structural_similarity", "M06_mem_inspect_search",
         "M07_mem_mark_used", "M08_mem_match_sql", "M10_mem_examples", "J10_join_hybrid_retrieval", "J11_join_candidate_decision", "T04_srt_retrieval_order",
         "E08_ev_threshold_sweep", "E09_ev_margin"]


def test_every_tenth_vector_asks(spark):
    from zocalo.queries import QUERIES
    path = "/root/testdata/sf0.001"
    assert all("vec_id % 10 = 0" in QUERIES[name].sql and "% 50" not in QUERIES[name].sql for name in TENTH)
    asking = {r["vec_id"] for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id").collect() if r["vec_id"] % 10 == 0}
    for name in ("J09_join_knn_threshold", "J11_join_candidate_decision"):
        assert {r["query_id"] for r in QUERIES[name].run(spark, path).select("query_id").distinct().collect()} == asking
    swept = QUERIES["E08_ev_threshold_sweep"].run(spark, path).first()
    assert swept["positive_cases"] + swept["negative_cases"] == len(asking)
