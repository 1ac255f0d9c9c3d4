"""Question templates: shared names, missing values and columns, fixed records, least size."""

import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import generate
from evidence_engine.plans import views

LISTING = "doc_id string, name string, area double, supply_area double, unit_type string, sigungu string, households string, station string, distance double, cutoff string, subject string"
ROWS = [
    ("A1", "가람", 84.5, 110.0, "84A", "송파구", "1200", "잠실", 350.0, None, "clash"),
    ("A2", " 가람 ", 59.0, None, "nan", "강남구", "nan", None, None, "2024-01-02", None),
    ("A3", "나래", None, None, None, "강남구", None, "역삼", None, "2023-09-05", None),
    ("A3", "나래", None, None, None, "강남구", None, "역삼", None, "2023-09-05", None),
    (None, "다솜", 10.0, None, None, "송파구", "5", None, None, None, None),
    ("A5", "NULL", 10.0, None, None, None, "5", None, None, None, None),
]


def made(df):
    return {r.question: r for r in df.collect()}


def test_answers_and_subjects(spark):
    listing = spark.createDataFrame([r for r in ROWS], LISTING).drop("subject")
    got = made(generate.qa_dataset(listing, views.knowledge(spark)))
    assert got["나래 근처 지하철역은 어디야"].answer == "가장 가까운 역은 역삼입니다."
    assert "나래 가까운 역까지 거리는 얼마야" not in got
    assert not [q for q in got if q.startswith(("다솜", "NULL", "이 아파트"))]
    assert "나래 구조는 어떻게 돼" not in got
    assert got["가람 전용면적은 얼마야"].answer == "가람의 전용면적은 84.50㎡입니다."
    assert got["가람 세대수는 몇 세대야"].answer == "가람은 총 1,200세대 규모입니다."
    assert len(got) == generate.qa_dataset(listing, views.knowledge(spark)).count()


def test_shared_names_carry_what_is_known(spark):
    listing = spark.createDataFrame([("A1", "가람", 84.5, 110.0, "84A"), ("A2", "가람", 59.0, None, "nan"), ("A3", "나래", 1.0, None, None)], "doc_id string, name string, area double, supply_area double, unit_type string")
    assert {r.doc_id: r.subject for r in generate.subjects(listing).collect()} == {"A1": "가람 전용 84.50㎡ 공급 110.00㎡ 타입 84A", "A2": "가람 전용 59.00㎡", "A3": "나래"}


def test_fixed_records(spark):
    listing = spark.createDataFrame(ROWS, LISTING)
    got = made(generate.fixed_rows(listing))
    assert len(got) == 7 and "강남구에서 공원 가까운 아파트 비교해줘" in got
    assert got["이 데이터 언제 기준이야"].must_include == "2024-01-02"


def test_empty_inputs(spark):
    listing, knowledge = spark.createDataFrame([], LISTING), views.knowledge(spark).limit(0)
    got = made(generate.qa_dataset(listing, knowledge))
    assert sorted(r.doc_id for r in got.values()) == ["META_001", "META_002", "NO_MATCH_001", "NO_MATCH_002"]
    assert got["이 데이터 언제 기준이야"].must_include == "기준일 미상"


def test_knowledge_ids_count_left_out_terms(spark):
    rows = [(0, "용적률", "비율", None, None), (1, "nan", "x", "y", "z"), (2, "시세", "가격", "f", "c")]
    got = made(generate.knowledge_rows(spark.createDataFrame(rows, "ordinal int, term string, definition string, related_dataset_fields string, caution string")))
    assert got["시세 설명해줘"].doc_id == "KNOW_003" and len(got) == 4
    assert got["용적률이 뭐야"].answer == "일반 설명: 비율\n우리 데이터에서 대응 가능한 필드: 없음"


def test_least_size(spark):
    assert generate.require_rows(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        generate.require_rows(spark.range(2), 3)


EDGE = "doc_id string, sido string, sigungu string, dong string, band string, distance double, price_summary string, price_per_pyeong double, hospital double, park double, subway double, households bigint"


def test_edge_outcomes(spark):
    rows = [
        ("A2", "서울", "송파구", "잠실동", "소형", 650.0, None, None, None, 3.0, None, 10),
        ("A1", "서울", "송파구", "잠실동", "중형", 650.0, "합리적인 편", None, None, None, None, 10),
        ("A3", "서울", "송파구", None, "소형", None, "합리적인 편", 9.0, 2.0, None, 5.0, None),
        (None, None, None, None, None, 1.0, None, None, None, None, None, None),
    ]
    got = made(generate.edge_questions(spark.createDataFrame(rows, EDGE)))
    pick = lambda q: (got[q].expected_doc, got[q].expected_match_status, got[q].must_not_recommend, got[q].must_disclose_limit)
    assert pick("송파구에서 지하철 500m 이내 아파트 추천해줘") == ("", "NO_MATCH", "Y", "N")
    assert pick("송파구에서 지하철 700m 이내 아파트 추천해줘") == ("A1", "EXACT_MATCH", "N", "N")
    assert pick("송파구에서 가격 괜찮은 아파트 추천해줘") == ("A3", "EXACT_MATCH", "N", "N")
    assert pick("잠실동에서 병원 접근 좋은 아파트 추천해줘") == ("", "UNKNOWN", "Y", "N")
    assert pick("송파구에서 중형이면서 공원과 병원 접근성 좋은 아파트 추천해줘") == ("", "UNKNOWN", "Y", "Y")
    assert pick("송파구 아파트 뭐 있어") == ("A1", "UNKNOWN", "N", "N")
    assert pick("송파구에서 괜찮은 아파트 추천해줘") == ("", "UNKNOWN", "Y", "Y")


def test_edge_quota_and_empty(spark):
    empty = spark.createDataFrame([], EDGE)
    got = {r.type: r["count"] for r in generate.edge_questions(empty).groupBy("type").count().collect()}
    # Fixed questions and fill over the stand-ins; of 183 colloquial ones the quota keeps 175.
    assert got == {"condition": 2 + 4, "comparison": 3 + 12, "multi_condition": 16, "region": 15 + 15 + 16 + 16, "vague": 5 + 96, "colloquial": 175}
    few = generate.edge_questions(empty, {"vague": 2, "colloquial": 0}).collect()
    assert [r.question for r in sorted(few, key=lambda r: r.question)] == ["괜찮은 아파트 추천해줘", "살기 좋은 단지 뭐 있어"]


def test_first_come_gives_what_a_fill_leaves_to_later_kinds(spark):
    from evidence_engine.operators import generate

    rows = [("a", "q1", [1], True), ("a", "q2", [2], True), ("a", "q3", [3], True), ("a", "x", [100], False), ("b", "q3", [1], True), ("b", "q4", [2], True), ("b", "y", [100], False), ("b", "x", [101], False), ("b", "z", [102], False), ("c", "z", [5], True), ("c", "y", [6], True), ("c", "w", [100], False), ("c", "x", [101], False)]
    df = spark.createDataFrame(rows, "kind string, q string, ord array<int>, claims boolean")
    out = generate.first_come(df, "q", "kind", "ord", {"a": 2, "b": 2, "c": 3}, F.col("claims")).collect()
    # a: q3 is claimed and cut; its fill has no room, so x stays free. b: q4, then y fills. c: z as b's fill never got to it, then w and x.
    assert sorted((r.kind, r.q) for r in out) == [("a", "q1"), ("a", "q2"), ("b", "q4"), ("b", "y"), ("c", "w"), ("c", "x"), ("c", "z")]
