"""Hot-key, blocked and distributed paths against plain readings of the same question."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zocalo.operators import aggregates, joins, memory, ordered, retrieval, sampling
from zocalo.plans.marketplace import Marketplace
from zocalo.plans.metrics import MetricSpec, metric_query

PATH = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_asof_is_the_same_when_keys_are_split(spark):
    rng = random.Random(5)
    stamp = lambda: f"2024-01-{rng.randint(1, 5):02d} {rng.randint(0, 23):02d}:{rng.choice(['00', '30'])}:00"
    sales = [(i, "hot" if rng.random() < 0.6 else f"k{i % 4}", stamp() if i % 17 else None) for i in range(300)]
    events = [(f"e{i:03d}", "hot" if rng.random() < 0.5 else f"k{i % 4}", stamp()) for i in range(120)]
    left = spark.createDataFrame(sales, "id int, k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    right = spark.createDataFrame(events, "ev string, k string, t2 string").withColumn("t2", F.col("t2").cast("timestamp_ntz"))
    naive = []
    for i, k, t in sales:
        before = [(t2, ev) for ev, k2, t2 in events if t is not None and k2 == k and t2 <= t]
        naive.append((i, max(before)[1] if before else None))
    for parts in (None, 1, 13):  # more ranges than keys: the hot key lies across most of them
        got = ordered.asof_backward(left, right, ["k"], "t", "t2", "ev", parts=parts).select("id", "ev")
        assert rows(got) == sorted(naive, key=str)


def test_interval_join_is_the_same_for_busy_keys(spark):
    rng = random.Random(9)
    sales = [(i % 40, f"k{i % 3}", f"2024-03-{rng.randint(1, 28):02d} {rng.choice(['00:00', '13:45'])}:00") for i in range(150)]
    spans = [(f"p{i:02d}", f"k{i % 3}", f"2024-03-{a:02d}", f"2024-03-{min(a + rng.randint(0, 6), 28):02d}")
             for i in range(45) for a in [rng.randint(1, 28)]]
    spans += [("ten", "k1", "2024-03-20", "2034-03-20"), ("none", "k2", "2024-03-09", "2024-03-08"), ("nil", None, "2024-03-01", "2024-03-28")]
    left = spark.createDataFrame(sales, "o int, k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    right = spark.createDataFrame(spans, "p string, k string, s string, e string").withColumns({"s": F.col("s").cast("date"), "e": F.col("e").cast("date")})
    best = {}
    for o, k, t in sales:
        for p, k2, s, e in spans:
            if k == k2 and s + " 00:00:00" <= t <= e + " 00:00:00":
                best[o] = min(best.get(o, ("9", "")), (s, p))
    expected = sorted(((o, v[1]) for o, v in best.items()), key=str)
    for parts in (None, 1, 17):
        assert rows(joins.first_valid_interval(left, right, ["k"], "o", "t", "s", "e", "p", parts)) == expected


def test_running_values_over_batches_and_ranges(spark):
    rng = random.Random(11)
    data = [(rng.choice(["hot", "hot", "a", None]), rng.randint(0, 40) if rng.random() < 0.9 else None, i, rng.randint(0, 99) if rng.random() < 0.4 else None) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t int, i int, v int")

    def plain(fold, before):
        out = []
        for k, t, i, _ in data:
            held = [(t2, i2, v) for k2, t2, i2, v in data if k2 == k and t is not None and t2 is not None and v is not None and ((t2, i2) < (t, i) or (t2, i2) == (t, i) and not before)]
            out.append((i, fold(held) if held else None))
        return sorted(out, key=str)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for before in (False, True):
            for parts in (None, 1, 9):
                last = ordered.running_last(df, ["k"], "t", ["i"], F.col("v"), "got", before, parts)
                assert rows(last.select("i", "got")) == plain(lambda held: max(held)[2], before)
                most = ordered.running_max(df, ["k"], "t", ["i"], F.col("v"), "got", before, parts)
                assert rows(most.select("i", "got")) == plain(lambda held: max(v for _, _, v in held), before)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ordered_scan_reads_and_shuffles_once(spark):
    m = Marketplace(spark, PATH)
    frame = ordered.running_last(m.orders(), ["customer_id"], "order_purchase_timestamp", ["order_id"], F.col("order_total"), "last", parts=8)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in plan.splitlines() if "Exchange rangepartitioning" in line]
    assert len(shuffles) == 2 and sum("ReusedExchange" in line for line in shuffles) == 1  # the second reading is of the same shuffle
    small = ordered.running_last(m.orders(), ["customer_id"], "order_purchase_timestamp", ["order_id"], F.col("order_total"), "last")
    small.collect()
    plan = small._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "MapInArrow" not in plan


def test_median_of_large_groups_sorts_only_the_middle(spark):
    data = spark.range(400_000).selectExpr("CASE WHEN id % 4 = 0 THEN NULL ELSE id % 3 END AS g", "CAST(pmod(hash(id), 1000003) AS double) * IF(id % 7 = 0, 1e30, -1) AS v")
    exact = data.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("median"))
    got = aggregates.exact_median(data, ["g"], "v")
    assert rows(got) == rows(exact)
    assert rows(aggregates.exact_median(data, [], "v")) == rows(data.agg(F.expr("percentile(v, 0.5)")))
    assert rows(aggregates.exact_median(data.filter("false"), [], "v")) == [(None,)]
    assert rows(aggregates.exact_median(data.filter("false"), ["g"], "v")) == []


def test_exact_median(spark):
    data = [(i % 5, float((i * 37) % 101)) for i in range(200)]
    df = spark.createDataFrame(data, "g int, v double")
    expected = [(g, float(np.median([v for k, v in data if k == g]))) for g in range(5)]
    assert rows(aggregates.exact_median(df, ["g"], "v")) == expected


def test_nearest_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    docs = [(i, rng.normal(size=8).tolist(), "a" if i < 60 else f"b{i % 3}") for i in range(90)]
    asked = [(i, rng.normal(size=8).tolist(), ["a", "b1"][i % 2]) for i in range(7)]
    d = spark.createDataFrame(docs, "doc int, embedding array<double>, key string")
    q = spark.createDataFrame(asked, "q int, embedding array<double>, key string")

    def brute(same_key):
        out = []
        for i, v, k in asked:
            near = sorted((round(float(((np.array(v) - np.array(w)) ** 2).sum()), 6), j) for j, w, k2 in docs if k == k2 or not same_key)[:4]
            out += [(i, j, dist, n + 1) for n, (dist, j) in enumerate(near)]
        return sorted(out, key=str)

    for by in (None, ["key"]):
        got = retrieval.nearest(q, d, 4, "q", "doc", by=by, document_block=7, query_block=2)
        assert rows(got.select("q", "doc", "distance", "position")) == brute(bool(by))


def test_balls_are_skipped_and_nothing_is_missed():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * 20
    docs = centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16))
    asked = centres[rng.integers(0, 30, 64)] + rng.normal(size=(64, 16))
    for metric in ("l2sq", "cosine"):
        docs[7] = 0
        table = retrieval._distances(asked, docs, metric)
        for k, within, distinct in ((5, None, None), (9000, 0.9, None), (4, None, np.arange(6000) // 3)):
            q, d, far, compared = retrieval.near_in_balls(retrieval.Balls(docs, metric, 200), docs, asked, k, metric, None, within, distinct)
            q, d, far = (np.concatenate(x) for x in (q, d, far))
            if within is None:
                assert compared < 64 * 6000 / 3
            for i in range(64):
                best = sorted((x, j) for j, x in enumerate(table[i]) if within is None or x <= within)
                firsts, seen = [], set()
                for x, j in best:
                    if distinct is None or distinct[j] not in seen:
                        firsts.append((x, j))
                        seen.add(j if distinct is None else distinct[j])
                own = sorted(zip(far[q == i], d[q == i]))
                assert set(firsts[:k]) <= set(own)


@pytest.mark.parametrize("metric,within", [("l2sq", None), ("cosine", None), ("l2sq", 9.0)])
def test_queries_go_only_to_balls_that_may_hold_a_neighbour(spark, metric, within):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 8)) * 15
    docs = [(i, (centres[i % 20] + rng.normal(size=8)).tolist()) for i in range(900)] + [(900, [0.0] * 8), (900, [1.0] * 8), (901, None)]
    d = spark.createDataFrame(docs, "doc int, embedding array<double>")
    q = d.filter("doc % 50 = 0").withColumnRenamed("doc", "q")
    got = retrieval.nearest(q, d, 4, "q", "doc", metric=metric, others=True, within=within, document_block=60, query_block=7)
    expected = []
    usable = [(i, np.array(v)) for i, v in docs if v is not None]
    for i, v in usable:
        if i % 50 == 0:
            far = retrieval._distances(v[None], np.array([w for _, w in usable]), metric)[0]
            near = sorted((x, j) for x, (j, _) in zip(far.tolist(), usable) if j != i and (within is None or x <= within))
            expected += [(i, j, x, n + 1) for n, (x, j) in enumerate(near[:4])]
    if within is not None or metric == "l2sq":
        visits = retrieval._dealt(d.filter("embedding is not null").withColumnRenamed("embedding", "_vector"), q.withColumnRenamed("embedding", "_vector"), [], 6, metric,
                                  "q", "doc", 60, 7, within, True, 902)[1]
        assert visits.count() < q.count() * 12
    mine = [r for r in rows(got.select("q", "doc", "distance", "position")) if r[0] != 900]
    assert mine == sorted((e for e in expected if e[0] != 900), key=str)


def test_sample_and_numbering_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    samples = [rows(sampling.weighted_sample(df.repartition(n), "id", F.col("g") + 1, 50, "s").select("id")) for n in (2, 7)]
    assert samples[0] == samples[1] and len(samples[0]) == 50
    numbered = sampling.numbered(df.repartition(5), ["g"], ["id"], rows=8).collect()
    for g in range(3):
        assert sorted(r["idx"] for r in numbered if r["g"] == g) == list(range(sum(r["g"] == g for r in numbered)))


def event(seq, fp, validated, sql):
    return (seq, fp, validated, sql, "t", "ok", "success" if validated else "no", "m", "q", "q", "count", "count", [], [], None, [], [],
            "v", 1, 0, f"2024-01-{seq:02d}", f"2024-01-{seq:02d}", "")


EVENT = ("seq int, fingerprint string, validated boolean, sql string, sources string, status string, execution_status string, model string, "
         "original_question string, normalized_question string, intent string, operation string, metrics array<string>, "
         "filters array<struct<field: string, operator: string, value: string>>, date_range struct<start_date: string, end_date: string>, "
         "group_by array<string>, context array<string>, embedding_version string, usage_count bigint, retrieval_count bigint, "
         "created_at string, updated_at string, last_used_at string")


def test_merge_never_degrades_and_ignores_batch_order(spark):
    rng = random.Random(1)
    events = [event(i, f"f{rng.randint(0, 3)}", rng.random() < 0.3, f"sql {i}") for i in range(1, 29)]
    expected = {}
    for e in events:  # the rule, one event at a time
        old = expected.get(e[1])
        keep = old and old[0] and not e[2]
        expected[e[1]] = (bool(old and old[0]) or e[2], old[1] if keep else e[3], (old[2] if old else 0) + 1)
    frame = lambda part: spark.createDataFrame(part, EVENT)
    for split in (0, 5, 20):
        shuffled = events[:]
        rng.shuffle(shuffled)
        store = memory.merge(frame(shuffled[:split]), ["seq"]) if split else None
        merged = memory.merge(frame(shuffled[split:]).repartition(3), ["seq"], store)
        assert {r["fingerprint"]: (r["validated"], r["sql"], r["usage_count"]) for r in merged.collect()} == expected


@pytest.mark.parametrize("name", ["J04_join_asof_backward", "J05_join_validity_interval", "J18_join_structural_similarity", "M03_mem_upsert_merge", "D02_dq_groundedness"])
def test_plans_have_no_nested_loops_over_data(spark, name):
    from zocalo.queries import QUERIES
    plan = QUERIES[name].run(spark, PATH)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_date_filter_and_columns_reach_the_scan(spark):
    spec = MetricSpec("revenue", "sum", group_by=("month",), date_range=("1998-01-01", "1998-12-31"))
    plan = metric_query(Marketplace(spark, PATH), spec)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "l_tax" not in plan and "o_orderpriority" not in plan


def test_metric_layer_counts_orders_once_and_rejects_unknown(spark):
    m = Marketplace(spark, PATH)
    by_seller = metric_query(m, MetricSpec("order_count", group_by=("seller",)))
    distinct = m.items().groupBy("seller_id").agg(F.count_distinct("order_id"))
    assert rows(by_seller) == rows(distinct)
    with pytest.raises(ValueError):
        metric_query(m, MetricSpec("profit"))


def test_draws_number_only_the_buckets_they_fall_into(spark):
    df = spark.range(3000).withColumn("k", F.col("id") * 7)
    pools = [rows(sampling.sample_with_replacement(df.repartition(n), ["id"], 400, "s", rows=size)) for n, size in ((2, 4096), (7, 16), (3, 1))]
    assert pools[0] == pools[1] == pools[2] and len(pools[0]) == 400
    order = [r["id"] for r in df.orderBy(sampling.hash32("bucket", F.col("id")), "id").collect()]
    picked = {r["draw"]: r["i"] for r in spark.range(400).select(F.col("id").alias("draw"), (sampling.hash32("s", F.col("id")) % 3000).alias("i")).collect()}
    assert pools[0] == sorted(((d, order[i]) for d, i in picked.items()), key=str)
    assert sampling.sample_with_replacement(df.filter("false"), ["id"], 5, "s").count() == 0


def test_components_of_chains_and_stars(spark):
    from zocalo.operators.graphs import connected
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301)]
    roots = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[i] == 100 for i in range(100, 160)) and roots[301] == 300
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dataset_hash_equals_the_tree_level_by_level(spark):
    import hashlib
    from zocalo.operators import evaluation
    data = {p: f"v{p}" for p in (*range(0, 40), 63, 64, 700, 5000, 70_000)}
    df = spark.createDataFrame(list(data.items()), "p long, v string")
    level = {p: hashlib.sha256(v.encode()).hexdigest() for p, v in data.items()}
    for _ in range(7):
        above = {}
        for p in sorted(level):
            above[p // 4] = above.get(p // 4, "") + level[p]
        level = {p: hashlib.sha256(t.encode()).hexdigest() for p, t in above.items()}
    got = evaluation.content_hash(df, "p", F.col("v"), width=4)
    assert [r[0] for r in got.collect()] == [level[p] for p in sorted(level)] or len(level) > 1
    assert sorted(r[0] for r in got.collect()) == sorted(level.values())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 2


def test_rows_without_a_key_match_no_event(spark):
    left = spark.createDataFrame([(1, None, "2024-01-02"), (2, "a", "2024-01-02"), (3, "a", None)], "id int, k string, t string").withColumn(
        "t", F.col("t").cast("timestamp_ntz"))
    right = spark.createDataFrame([("e1", None, "2024-01-01"), ("e2", "a", "2024-01-01")], "ev string, k string, t2 string").withColumn(
        "t2", F.col("t2").cast("timestamp_ntz"))
    got = ordered.asof_backward(left, right, ["k"], "t", "t2", "ev")
    assert rows(got.select("id", "ev")) == [(1, None), (2, "e2"), (3, None)]


def test_null_and_zero_vectors(spark):
    docs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "doc int, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "q int, embedding array<double>")
    got = retrieval.nearest(asked, docs, 2, "q", "doc", metric="cosine").select("q", "doc", "distance")
    assert rows(got) == [(1, 1, 1.0), (1, 2, 0.0), (2, 1, 1.0), (2, 2, 1.0)]
    assert rows(retrieval.nearest(asked, docs, 2, "q", "doc", metric="cosine", within=0.5).select("q", "doc")) == [(1, 2)]


def test_masks_hold_for_values_of_any_list(spark):
    docs = spark.createDataFrame([(1, [1.0], ["own", "x"]), (2, [1.1], ["x"]), (3, [1.2], []), (4, [9.0], ["own"])], "doc int, embedding array<double>, m array<string>")
    asked = spark.createDataFrame([(1, [1.0], ["own"]), (2, [1.0], []), (3, [1.0], ["nowhere"])], "q int, embedding array<double>, m array<string>")
    got = retrieval.nearest(asked, docs, 2, "q", "doc", mask="m").select("q", "doc")
    assert rows(got) == [(1, 1), (1, 4), (2, 1), (2, 2)]


def test_orders_stay_without_carriers(spark):
    orders = spark.createDataFrame([(1, "a"), (2, "b")], "order_id int, region string")
    carriers = spark.createDataFrame([], "carrier_id int")
    coverage = spark.createDataFrame([], "region string, carrier_id int")
    got = sampling.assign_by_region(orders, coverage, carriers, "order_id", "region", "s")
    assert rows(got.select("order_id", "carrier_id")) == [(1, None), (2, None)]
