"""Routing and answers on the golden listing."""

import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import gates, recommend, route
from evidence_engine.plans import views

GOLDEN = [
    ("데이터 기준 알려줘", "DATA_SCOPE_META", "KNOWN"), ("분양가상한제 뜻이 뭐야", "REAL_ESTATE_KNOWLEDGE", "KNOWN"), ("헬리오시티 지하철 정보 알려줘", "APARTMENT_FACT_LOOKUP", "EXACT_MATCH"),
    ("송파구에서 13억 이하 아파트 추천해줘", "RECOMMEND_STRUCTURED", "EXACT_MATCH"), ("병원 비교해줘", "RECOMMEND_COMPARATIVE", "EXACT_MATCH"), ("병원 좋은 곳 비교해줘", "RECOMMEND_COMPARATIVE", "UNKNOWN"),
    ("송파구에서 1억 이하 아파트 추천해줘", "RECOMMEND_STRUCTURED", "NO_MATCH"), ("송파구 대표 아파트 특징 설명해줘", "GENERAL_RETRIEVAL_QA", None), ("송파구 중소형 추천해줘", "RECOMMEND_STRUCTURED", "UNKNOWN"),
    ("학교 비교해줘", "RECOMMEND_COMPARATIVE", "UNKNOWN"), ("지역 이야기", "GENERAL_RETRIEVAL_QA", None),
]


@pytest.fixture(scope="module")
def answered(spark):
    listing = spark.createDataFrame([("APT_000001", "헬리오시티", "서울", "송파구", "가락동", 84.0, 120000.0, 300.0, 1000, 2018, "중형", 8.0, 9.0, 700.0, "송파역", "2023-09-05")], "doc_id string, name string, sido string, sigungu string, dong string, area double, price double, distance double, households int, year int, band string, park double, hospital double, subway double, station string, cutoff string")
    know = views.knowledge(spark).withColumn("term", F.when(F.col("term") == "시세", "분양가상한제").otherwise(F.col("term")))
    asked = spark.createDataFrame([(i, f"  {q} ") for i, (q, _, _) in enumerate(GOLDEN)], "qid long, question string")
    parsed = route.parse(asked, listing, know, strict_band=True)
    return {r.qid: r for r in parsed.collect()}, {r.qid: r for r in recommend.answers(parsed, listing, know).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(i, answered):
    parsed, answers = answered
    _, kind, status = GOLDEN[i]
    assert parsed[i].query_type == kind
    assert (answers[i].match_status if i in answers else None) == status


def test_band_order_is_a_switch(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("중소형 추천",)], "q string")
    assert df.select(route.asked_band(F.col("q"), True), route.asked_band(F.col("q"))).first()[:] == ("소형", "중소형")


def test_monitor_and_verdict_rules(spark):
    row = dict(rows=10, target_rows=100, window_avg_sec=1.0, window_p95_sec=1.0, output_age_min=1.0, log_age_min=None, heartbeat_age_min=None, benchmark_age_min=None, benchmark_passed=None, blocked_in_log=False, process_alive=True)
    cases = [({}, "RUNNING_HEALTHY"), ({"rows": 100}, "COMPLETED"), ({"window_avg_sec": 99.0}, "RUNNING_SLOW"), ({"output_age_min": 99.0}, "STALL_WARNING"), ({"blocked_in_log": True}, "BLOCKED_BY_GATE"), ({"process_alive": False, "output_age_min": 99.0}, "STALL_CONFIRMED"), ({"process_alive": False}, "STALL_WARNING"), ({"process_alive": False, "benchmark_passed": False}, "BLOCKED_BY_GATE")]
    schema = "rows int, target_rows int, window_avg_sec double, window_p95_sec double, output_age_min double, log_age_min double, heartbeat_age_min double, benchmark_age_min double, benchmark_passed boolean, blocked_in_log boolean, process_alive boolean"
    for change, want in cases:
        df = spark.createDataFrame([tuple((row | change).values())], schema)
        assert df.select(gates.monitor_verdict()).first()[0] == want
