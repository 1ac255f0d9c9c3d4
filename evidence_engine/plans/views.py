"""The driver's tables in the shape of this library's inputs. Expressions here are valid in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derive as D
from ..functions.contracts import TERMS

_PART = [
    "'APT_' || lpad(CAST(p_partkey AS STRING), 6, '0') AS doc_id", "p_name AS name", "r_name AS sido", "n_name AS sigungu", "p_brand AS dong",
    "CAST(p_size AS DOUBLE) * 3 AS area", "round(p_retailprice * 100) AS price",
    "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 1500 AS DOUBLE) END AS distance",
    "(p_partkey * 91) % 3000 AS households", "2010 + p_partkey % 15 AS year",
    "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 7 AS DOUBLE) END AS park", "CAST(p_partkey % 5 AS DOUBLE) AS hospital",
    "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS station", "p_partkey % 4 AS lines", "CASE WHEN p_partkey % 9 = 0 THEN '적용' WHEN p_partkey % 9 = 1 THEN 'N' WHEN p_partkey % 9 = 2 THEN 'null' ELSE CAST(p_partkey % 3 AS STRING) END AS flag_text",
    "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE '2023-09-05' END AS cutoff", "p_partkey AS ordinal",
]
_BAND = "CASE WHEN area IS NULL THEN '면적 정보 없음' WHEN area < 40 THEN '소형' WHEN area < 60 THEN '중소형' WHEN area < 85 THEN '중형' WHEN area < 120 THEN '중대형' ELSE '대형' END"

LISTING = f"""listing AS (SELECT *, {_BAND} AS band FROM (SELECT {", ".join(_PART)} FROM part JOIN nation ON p_partkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey) AS __l)"""

_TYPES = ["grounded_generation", "recommendation", "unknown_response", "no_match_response", "comparison_recommendation", "meta_answer", "grounded_generation", "fallback_answer", "odd_type", ""]
_ROUTERS = ["RECOMMEND_STRUCTURED", "RECOMMEND_COMPARATIVE", "GENERAL_RETRIEVAL_QA", "DATA_SCOPE_META", ""]
_STATUS = ["EXACT_MATCH", "UNKNOWN", "NO_MATCH", "KNOWN"]


def _pick(expr: str, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN ({expr}) % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_PRED = [
    "conv_id * 1000 + turn AS source_row_index",
    f"text || {_pick('conv_id + turn', [' 소형 비교', ' 살기 좋은', '', ''])} AS question",
    f"CASE WHEN (conv_id * 3 + turn) % 9 = 0 THEN '' ELSE text || {_pick('conv_id + turn', [' 데이터 기준일: 2023', ' 비교 기준', '', ' 판단 보류'])} END AS answer",
    f"{_pick('conv_id * 7 + turn', _TYPES)} AS answer_type", f"{_pick('conv_id + turn * 3', _STATUS)} AS match_status", f"{_pick('conv_id * 3 + turn', _ROUTERS)} AS query_type",
    f"{_pick('conv_id * 7 + turn + (CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END)', _TYPES)} AS expected_answer_type", f"{_pick('conv_id + turn * 3 + (CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END)', _STATUS)} AS expected_match_status",
    f"{_pick('conv_id * 3 + turn + (CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END)', _ROUTERS)} AS expected_router_type",
    "CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE 'D' || CAST(conv_id % 20 AS STRING) END AS top_doc_id",
    "CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE 'D' || CAST(conv_id % 20 AS STRING) || '|D' || CAST((conv_id + 7) % 20 AS STRING) || '| |D' || CAST(turn AS STRING) END AS cited_doc_ids",
    "'D' || CAST(conv_id % 17 AS STRING) AS expected_doc", "'F' || CAST(turn % 3 AS STRING) AS expected_field", "'F' || CAST(conv_id % 3 AS STRING) || '|F9' AS used_fields",
    "CASE WHEN (conv_id + turn) % 3 = 0 THEN text ELSE text || ' 외' END AS expected_answer", "CASE WHEN conv_id % 4 = 0 THEN NULL WHEN turn % 3 = 1 THEN text || ' ?!' ELSE '기준' END AS must_include", "CASE WHEN conv_id % 3 = 0 THEN 'zzz' ELSE '' END AS must_not_include",
    "CASE WHEN conv_id % 6 = 0 THEN ' y ' WHEN conv_id % 3 = 0 THEN ' Y ' WHEN conv_id % 3 = 1 THEN 'N' ELSE '?' END AS must_not_recommend", "CASE WHEN turn % 2 = 0 THEN 'Y' ELSE 'N' END AS must_disclose_limit",
    "conv_id % 8 = 0 AS insufficient_context", "CAST((conv_id * 37 + turn * 11) % 30000 AS DOUBLE) AS latency_ms", "role",
]
PRED = f"pred AS (SELECT {', '.join(_PRED)} FROM conversations)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, nation, region = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    joined = part.join(nation, F.col("p_partkey") % 25 == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.selectExpr(*_PART).withColumn("band", D.area_band(F.col("area")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*_PRED)


_QUESTIONS = [
    "{r}에서 12억 이하 아파트 추천해줘", "{r} 소형 아파트 추천해줘", "{r}에서 지하철 500m 이내 아파트 추천해줘", "{r} 병원 비교해줘", "{r} 대표 아파트 특징 설명해줘", "{r} 살기 좋은 곳 추천해줘",
    "{r} 주변 아파트 뭐 있어", "데이터 기준 알려줘 {r}", "{r} 역 가까운 신축 아파트 찾아줘", "{r} 구역 공원 많은 데 비교해줘", "역세권 뜻이 뭐야 {r}", "{r} 전용면적 84.5 500세대 이상 후보", "지역 {r} 이야기", "{r} 가격 괜찮은 중형 보여줘",
]
_ASKED = [q.replace("{r}", "' || n_name || '") for q in _QUESTIONS]
# A question a listing too, so that questions grow with the table: facts by name, limits without a region, comparisons.
_OF_PART = [
    "p_name || ' 전용면적과 세대수 알려줘'", "p_name || ' 가격 궁금'", "p_name || ' 지하철 정보'", "p_name || ' 병원이랑 공원 어때'", "p_name || ' 통근 정책 건설사 정보'", "'전체 ' || CAST(p_partkey % 23 AS STRING) || '억 이하 아파트 추천해줘'",
    "'지하철 ' || CAST(p_partkey * 37 % 1500 AS STRING) || 'm 이내 신축 찾아줘'", "'전용 ' || CAST(p_partkey % 150 AS STRING) || ' 이상 ' || CAST(p_partkey % 3000 AS STRING) || '세대 이상 역 가까운 후보'", "p_name || ' 알려줘'",
    "'공원과 병원 접근성 좋은 ' || CAST(p_partkey % 20 + 1 AS STRING) || '억 이하 추천'", "'가격 괜찮은 ' || CAST(p_partkey % 900 AS STRING) || 'm 이내 아파트 보여줘'", "p_brand || ' 공원 비교해줘'",
]
_ASKED_OF = "CASE " + " ".join(f"WHEN p_partkey % {len(_OF_PART)} = {i} THEN {q}" for i, q in enumerate(_OF_PART)) + " END"
QUESTIONS = "questions AS (" + " UNION ALL ".join([f"SELECT CAST(n_nationkey * 100 + {i} AS BIGINT) AS qid, '{q}' AS question FROM nation" for i, q in enumerate(_ASKED)] + [f"SELECT CAST(p_partkey + 100000 AS BIGINT), {_ASKED_OF} FROM part"]) + ")"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array(*(F.struct(F.lit(i).alias("i"), F.expr(f"'{q}'").alias("question")) for i, q in enumerate(_ASKED)))
    of_nation = table(spark, sf_dir, "nation").select("n_nationkey", F.inline(made)).select((F.col("n_nationkey") * 100 + F.col("i")).cast("bigint").alias("qid"), "question")
    return of_nation.unionByName(table(spark, sf_dir, "part").selectExpr("CAST(p_partkey + 100000 AS BIGINT) AS qid", f"{_ASKED_OF} AS question"))


# What the question templates need beyond the listing; nulls, blanks and words for missing values among them.
_QA_EXTRA = [
    "area + 7.5 AS supply_area", "CASE WHEN ordinal % 3 = 0 THEN NULL ELSE 'T' || CAST(ordinal % 5 AS STRING) END AS unit_type",
    "CASE WHEN ordinal % 6 = 0 THEN 'nan' ELSE '방 ' || CAST(ordinal % 4 + 1 AS STRING) || '개 구조입니다.' END AS structure",
    "CASE WHEN ordinal % 8 = 0 THEN ' ' ELSE sido || ' ' || sigungu || ' ' || dong || ' ' || CAST(ordinal AS STRING) END AS address",
    "CASE WHEN ordinal % 5 < 2 THEN station || ' 이용 가능' END AS transport_compare", "CASE WHEN ordinal % 7 <> 0 THEN CAST(lines AS STRING) || '호선' END AS line_summary",
    "CASE WHEN ordinal % 12 <> 0 THEN price / 4 END AS price_per_pyeong", "CASE WHEN ordinal % 10 = 3 THEN 'None' WHEN ordinal % 10 < 3 THEN '평당 공급가가 비교적 합리적인 편입니다.' ELSE band || ' 가격 수준' END AS price_summary", "1500 - distance AS subway",
    "CASE WHEN park IS NOT NULL THEN '공원 ' || CAST(CAST(park AS INT) AS STRING) || '개' END AS lifestyle", "'병원 ' || CAST(CAST(hospital AS INT) AS STRING) || '개' AS medical",
    "CASE WHEN ordinal % 4 = 1 THEN NULL ELSE sigungu || ' 통근' END AS commute", "CASE WHEN ordinal % 9 = 2 THEN 'null' ELSE ' ' || dong || ' 시공 ' END AS builder",
    "CASE WHEN ordinal % 3 = 1 THEN '' ELSE '정책 ' || flag_text END AS policy", "name || ' 단지' AS description",
]
QA_LISTING = f"{LISTING}, qa_listing AS (SELECT *, {', '.join(_QA_EXTRA)} FROM listing)"


def qa_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).selectExpr("*", *_QA_EXTRA)


def knowledge(spark: SparkSession, cutoff: str = "2023-09-05") -> DataFrame:
    """The six fixed records in order, stamped with the data's cutoff."""
    rows = F.array(*(F.struct(F.lit(i).alias("ordinal"), *(F.lit(v).alias(n) for n, v in zip(("term", "definition", "related_dataset_fields", "caution"), t))) for i, t in enumerate(TERMS)))
    return spark.range(1).select(F.inline(rows)).withColumns({"source_type": F.lit("general_knowledge"), "data_cutoff": F.lit(cutoff), "answer_template": F.lit("일반 설명: {definition}\n우리 데이터에서 대응 가능한 필드: {related_dataset_fields}")})
