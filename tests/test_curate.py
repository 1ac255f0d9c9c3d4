from pyspark.sql import functions as F

from evidence_engine.functions import contracts as C
from evidence_engine.operators import curate, evaluate, relational
from evidence_engine.plans import registry


def test_quota_formulas():
    assert [curate.quota(n, C.HOLDOUT_GROUNDED) for n in (0, 1, 79, 80, 400, 5000)] == [0, 0, 15, 20, 100, 200]
    assert [curate.quota(a[0], C.HOLDOUT_SAFETY, of=a[1]) for a in ((0, 0), (10, 59), (10, 60), (1000, 249), (1000, 250))] == [0, 2, 30, 150, 150]
    assert [curate.quota(n, C.VALID, nearest=True) for n in (0, 1, 4, 5, 25, 35, 100)] == [0, 0, 0, 1, 2, 4, 10]
    assert curate.targets(70, 100, 100) == (15, 15) and curate.targets(0, 100, 5) == (60, 0) and curate.targets(20, 3, 100) == (3, 37)


def test_selection_is_a_partition_with_its_quotas(spark):
    kinds = ["grounded_generation"] * 400 + ["unknown_response"] * 120 + ["recommendation"] * 120 + ["meta_answer"] * 10
    rows = [(i, f"q{i}", f"a{i} 비교 기준", k, "EXACT_MATCH", "X", "Y" if i % 7 == 0 else "", False) for i, k in enumerate(kinds)]
    edge = spark.createDataFrame(rows, "source_row_index long, question string, answer string, answer_type string, match_status string, query_type string, must_not_recommend string, insufficient_context boolean")
    done = curate.selection(curate.classified(curate.candidates(edge, edge.limit(0)))).cache()
    assert done.count() == len(rows) and done.select("stable_id").distinct().count() == len(rows)
    n = {r.split: r["count"] for r in done.groupBy("split").count().collect()}
    assert n["holdout_grounded_generation"] == 100
    left = done.where("include_in_sft and not split like 'holdout%'").groupBy("sft_bucket").count().collect()
    pool = {r.sft_bucket: r["count"] for r in left}
    s, r = curate.targets(pool["grounded_generation"], pool["safety_refusal"], pool["safe_recommendation"])
    assert n["train"] + n["valid"] == pool["grounded_generation"] + s + r
    assert n["valid"] >= 10
    again = curate.selection(curate.classified(curate.candidates(edge.repartition(7), edge.limit(0))))
    assert done.select("stable_id", "split").exceptAll(again.select("stable_id", "split")).isEmpty()


def test_small_pools_give_holdouts_back(spark):
    rows = [(i, f"q{i}", "a", "grounded_generation" if i < 50 else "unknown_response", "M", "X") for i in range(62)]
    rows = [(i, q, f"{a}{i}", *rest) for i, q, a, *rest in rows]
    edge = spark.createDataFrame(rows, "source_row_index long, question string, answer string, answer_type string, match_status string, query_type string")
    done = curate.selection(curate.classified(curate.candidates(edge, edge.limit(0))))
    n = {r.split: r["count"] for r in done.groupBy("split").count().collect()}
    assert n["train"] + n["valid"] >= 60 and sum(n.values()) == 62


def test_class_rules_in_order(spark):
    rows = [(1, "q", "a", "recommendation", "UNKNOWN", "R", "", ""), (2, "q2", "a", "recommendation", "EXACT_MATCH", "R", "y", ""), (3, "q3", "a", "recommendation", "EXACT_MATCH", "R", "", "Y"), (4, "q4", " 비교 기준", "recommendation", "EXACT_MATCH", "R", "", "Y"), (5, "", "a", "meta_answer", "K", "M", "", ""), (6, "q6", None, "meta_answer", "K", "M", "", ""), (7, "q7", "a", "meta_answer", "", "M", "", ""), (8, "q8", "a", "x", "K", "M", "", ""), (8, "q9", "a", "x", "K", "M", "", "")]
    df = spark.createDataFrame(rows, "source_row_index long, question string, answer string, answer_type string, match_status string, query_type string, must_not_recommend string, must_disclose_limit string")
    got = {r.question: r.exclusion_reason for r in curate.classified(curate.candidates(df, df.limit(0))).collect()}
    assert got["q"] == "recommendation_not_exact_match" and got["q2"] == "recommendation_flagged_must_not_recommend" and got["q3"] == "recommendation_missing_disclosure_language" and got["q4"] == ""
    assert got[""] == "missing_question" and got["q6"] == "missing_answer" and got["q7"] == "missing_contract_fields"
    assert sorted([got["q8"], got["q9"]]) == ["duplicate_source_row", "unsupported_answer_type:x"]


def test_empty_metrics_have_their_defaults(spark, sf):
    from evidence_engine.plans import views

    none = views.predictions(spark, sf).where("false")
    m = evaluate.edge_metrics(none).first()
    assert m.total_questions == 0 and m.must_not_recommend_pass_rate == 1.0 and m.doc_hit_rate == 0.0 and m.avg_latency_ms == 0.0


def test_dedup_ties_and_partition_independence(spark, sf):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = registry.structured_top3(spark, sf).toPandas().sort_values(["sigungu", "rank"]).reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    eight = registry.structured_top3(spark, sf).toPandas().sort_values(["sigungu", "rank"]).reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one.equals(eight)


def test_top_k_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 1.0, 1), ("a", 2.0, 3)], "g string, s double, i int")
    assert [r.i for r in relational.top_k(df, ["g"], [F.desc("s"), "i"], 2).orderBy("rank").collect()] == [3, 1]
