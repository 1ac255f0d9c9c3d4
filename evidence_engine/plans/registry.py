"""The library's queries over the driver's tables, each with the DuckDB SQL of the same rows where SQL has it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as K
from ..functions import contracts as C
from ..functions import derive as D
from ..operators import audit, context, curate, dictionary, evaluate, gates, generate, order, recommend, relational, retrieve, route
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


T, L, P, c = V.table, V.listing, V.predictions, F.col
LIST, PRED, ASK = f"WITH {V.LISTING}", f"WITH {V.PRED}", f"WITH {V.QUESTIONS}"
r6 = lambda x: F.round(x, 6)
NORM = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^0-9a-z가-힣\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
TXT = lambda x: f"CASE WHEN {x} IS NULL OR trim({x}) IN ('', 'nan', 'None', 'NULL', 'null') THEN '' ELSE trim({x}) END"
HAS = lambda x, hints: "(" + " OR ".join(f"contains({x}, '{h}')" for h in hints) + ")"


# Profiles and relational building blocks


@query("SELECT 'c_acctbal' AS column_name, count(*) FILTER (WHERE c_acctbal IS NULL) AS nulls FROM customer UNION ALL SELECT 'segment', count(*) FILTER (WHERE nullif(c_mktsegment, 'BUILDING') IS NULL) FROM customer UNION ALL SELECT 'bal', count(*) FILTER (WHERE c_acctbal < 0) FROM customer")
def scan_profile_nulls(s, d):
    t = T(s, d, "customer").select("c_acctbal", F.nullif(c("c_mktsegment"), F.lit("BUILDING")).alias("segment"), F.when(c("c_acctbal") >= 0, c("c_acctbal")).alias("bal"))
    return relational.null_profile(t)


@query("SELECT CAST(count(*) - count(DISTINCT (l_returnflag, l_linestatus, l_quantity, l_partkey % 100)) AS BIGINT) AS duplicates FROM lineitem")
def exact_dup_count(s, d):
    t = T(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", (c("l_partkey") % 100).alias("k"))
    return relational.duplicate_count(t)


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_full_row(s, d):
    return relational.keep_one(T(s, d, "documents").select("text", "doc_id"), ["text"], ["doc_id"])


@query("SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def dedup_keep_first(s, d):
    return relational.keep_one(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey")


@query("SELECT l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def dedup_keep_last(s, d):
    return relational.keep_one(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], last=True).select("l_orderkey", "l_partkey")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1 AS is_repeat, count(*) OVER (PARTITION BY p_name) > 1 AS is_shared FROM part")
def dup_mask_any(s, d):
    return relational.dup_masks(T(s, d, "part").select("p_partkey", "p_name"), ["p_name"], ["p_partkey"]).select("p_partkey", "is_repeat", "is_shared")


@query("SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def value_counts(s, d):
    return relational.value_counts(T(s, d, "events"), "event_type")


@query("SELECT p_brand, count(*) AS rows FROM part GROUP BY p_brand ORDER BY rows DESC, p_brand LIMIT 5")
def top_values(s, d):
    return relational.value_counts(T(s, d, "part"), "p_brand", 5)


@query(LIST + " SELECT sigungu, coalesce(arg_min(doc_id, (distance, doc_id)) FILTER (WHERE distance IS NOT NULL), min(doc_id)) AS picked FROM listing GROUP BY sigungu")
def pick_doc(s, d):
    return relational.pick_extreme(L(s, d), ["sigungu"], "distance", "doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(s, d):
    done = T(s, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    return relational.resume(T(s, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id < 300")
def slice_by_ordinal(s, d):
    return relational.slice_rows(T(s, d, "events").select("event_id", "value"), "event_id", 100, 200)


@query("""SELECT coalesce(a.metric, b.metric) AS metric, a.value AS left_value, b.value AS right_value, b.value - a.value AS delta
  FROM (SELECT l_returnflag AS metric, round(sum(l_quantity), 6) AS value FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) a
  FULL JOIN (SELECT l_returnflag AS metric, round(sum(l_quantity), 6) AS value FROM lineitem WHERE l_returnflag <> 'A' AND l_linenumber < 4 GROUP BY 1) b ON a.metric = b.metric""")
def metric_full_outer(s, d):
    side = lambda w: T(s, d, "lineitem").where(w).groupBy(c("l_returnflag").alias("metric")).agg(r6(F.sum("l_quantity")).alias("value"))
    return relational.metric_outer(side("l_returnflag <> 'R'"), side("l_returnflag <> 'A' and l_linenumber < 4"))


@query("SELECT k, CAST(sum(w) AS BIGINT) AS surplus FROM (SELECT c_nationkey AS k, 1 AS w FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY k HAVING sum(w) <> 0")
def multiset_diff(s, d):
    return relational.multiset_diff(T(s, d, "customer").select(c("c_nationkey").alias("k")), T(s, d, "supplier").select(c("s_nationkey").alias("k")), ["k"])


@query("SELECT doc_id, quality IS NOT NULL AS matched, quality AS quality_base FROM documents LEFT JOIN labels USING (doc_id)")
def post_train_join(s, d):
    return relational.unmatched_left(T(s, d, "documents").select("doc_id"), T(s, d, "labels").select("doc_id", "quality"), ["doc_id"]).select("doc_id", "matched", "quality_base")


@query("SELECT doc_id, CAST(rank AS INTEGER) AS hash_rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('salt||' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 10")
def hash_rank_sample(s, d):
    return relational.hash_ranked(T(s, d, "documents").select("doc_id", "lang"), "doc_id", "salt", 10, ["lang"]).select("doc_id", "hash_rank")


@query("SELECT n.n_nationkey, arg_max(e.n_name, (length(e.n_name), e.n_name)) AS entry FROM nation n JOIN nation e ON contains(n.n_name || ' 아파트', e.n_name) GROUP BY 1")
def entity_longest_match(s, d):
    n = T(s, d, "nation")
    q = n.select("n_nationkey", F.concat("n_name", F.lit(" 아파트")).alias("q"))
    return dictionary.longest_entries(q, n.select(F.lit("entry").alias("kind"), c("n_name").alias("entry")), "n_nationkey", "q", ["entry"])


@query("""WITH p AS (SELECT p_partkey, p_brand || ' ' || CAST(p_size AS VARCHAR) AS name, p_retailprice FROM part), s AS (SELECT name, 1 AS bit FROM p WHERE p_retailprice < 1000 UNION ALL SELECT name, 2 FROM p WHERE p_retailprice > 1900 UNION ALL SELECT name, 4 FROM p JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_linenumber = 7 AND l_quantity > 45),
  b AS (SELECT name, bit_or(bit) AS bits FROM s WHERE name IS NOT NULL GROUP BY 1)
  SELECT CASE bits WHEN 7 THEN 'all' WHEN 3 THEN 'declared_read' WHEN 5 THEN 'declared_written' WHEN 6 THEN 'read_written' WHEN 1 THEN 'declared_only' WHEN 2 THEN 'read_only' ELSE 'written_only' END AS kind, string_agg(name, ',' ORDER BY name) AS columns FROM b GROUP BY 1""")
def schema_diff(s, d):
    """The seven classes of the brands and sizes that three sides name: cheap parts, dear parts, parts returned in large numbers."""
    parts = T(s, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" "), c("p_size").cast("string")).alias("name"), "p_retailprice")
    returned = T(s, d, "lineitem").where("l_returnflag = 'R' and l_linenumber = 7 and l_quantity > 45").select(c("l_partkey").alias("p_partkey"))
    found = relational.set_classes(parts.where("p_retailprice < 1000"), parts.where("p_retailprice > 1900"), parts.join(returned, "p_partkey", "left_semi"), "name")
    return found.select("kind", F.array_join("names", ",").alias("columns"))


@query("SELECT p_partkey, printf('APT_%06d', row_number() OVER (ORDER BY p_brand, p_partkey)) AS doc_id, row_number() OVER (ORDER BY p_brand, p_partkey) AS ordinal FROM part")
def global_ordinal(s, d):
    """Sequential ids over the whole table."""
    parts = order.with_ordinal(T(s, d, "part").select("p_partkey", "p_brand"), ["p_brand", "p_partkey"])
    return parts.select("p_partkey", F.format_string("APT_%06d", c("ordinal")).alias("doc_id"), "ordinal")


@query("SELECT event_id, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS most FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def trailing_rows(s, d):
    """Over the last fifty of all events."""
    e = T(s, d, "events").select("event_id", "ts", "value")
    return order.trailing(e, ["ts", "event_id"], 50, {"mean": F.avg("value"), "most": F.max("value")}).select("event_id", r6(c("mean")).alias("mean"), "most")


@query("SELECT event_type, event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def trailing_by_type(s, d):
    return evaluate.trailing(T(s, d, "events"), ["event_type"], ["ts", "event_id"], "value", 10).select("event_type", "event_id", r6(c("trailing_avg")).alias("mean"))


# Cleaning


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN NULL ELSE CAST(p_partkey * 1001 AS DOUBLE) END AS cleaned FROM part""")
def clean_numeric(s, d):
    n = c("p_partkey")
    raw = F.when(n % 5 == 0, F.lit("nan")).when(n % 5 == 1, F.concat(n.cast("string"), F.lit("d"))).when(n % 5 == 2, F.concat(F.format_number(n * 1001, 0), F.lit(" 만원"))).when(n % 5 == 3, F.concat(F.lit(" "), (n * 1001).cast("string"), F.lit("㎡"))).otherwise(F.concat((n * 1001).cast("string"), F.lit(".0세대")))
    return T(s, d, "part").select("p_partkey", K.clean_numeric(raw).alias("cleaned"))


@query(LIST + " SELECT doc_id, CASE WHEN flag_text IN ('적용', '1') THEN true WHEN flag_text IN ('N', '0') THEN false END AS flag FROM listing")
def tristate_bool(s, d):
    return L(s, d).select("doc_id", K.to_bool(c("flag_text")).alias("flag"))


@query(LIST + """ SELECT doc_id, replace(sido, ' ', '_') AS sido, CASE WHEN ordinal % 3 = 0 THEN '수원시 팔달구' ELSE sigungu END AS sigungu, CASE WHEN ordinal % 3 = 2 THEN NULL ELSE dong END AS dong,
  CASE WHEN ordinal % 3 = 0 THEN '12 34' WHEN ordinal % 3 = 1 THEN '9' END AS detail, ordinal % 3 <> 2 AS complete FROM listing""")
def parse_address(s, d):
    n = c("ordinal")
    raw = F.when(n % 3 == 0, F.concat_ws("  ", "sido", F.lit("수원시"), F.lit("팔달구"), "dong", F.lit("12 34"))).when(n % 3 == 1, F.concat_ws(" ", "sido", "sigungu", "dong", F.lit("9"))).otherwise(F.concat(F.lit(" "), c("sido"), F.lit(" "), c("sigungu")))
    return L(s, d).withColumn("sido", F.replace("sido", F.lit(" "), F.lit("_"))).select("doc_id", K.address(raw).alias("a")).select("doc_id", "a.*")


@query(f"SELECT doc_id, {NORM('text')} AS normalized FROM documents")
def normalize_text(s, d):
    return T(s, d, "documents").select("doc_id", K.normalize(c("text")).alias("normalized"))


@query(f"SELECT doc_id, CAST(len(list_distinct(list_filter(string_split({NORM('text')}, ' '), lambda t: t <> ''))) AS INTEGER) AS tokens FROM documents")
def token_counts(s, d):
    return T(s, d, "documents").select("doc_id", F.size(K.tokens(c("text"))).alias("tokens"))


@query("SELECT DISTINCT n_name AS station, line FROM nation JOIN region ON n_regionkey = r_regionkey, LATERAL (SELECT unnest([r_name, n_name]) AS line)")
def line_list_explode(s, d):
    j = T(s, d, "nation").join(T(s, d, "region"), c("n_regionkey") == c("r_regionkey"))
    raw = F.when(c("n_nationkey") % 2 == 0, F.concat(F.lit("['"), c("r_name"), F.lit("', '"), c("n_name"), F.lit("', '"), c("r_name"), F.lit("']"))).otherwise(F.concat(c("r_name"), F.lit(", nan,"), c("n_name"), F.lit(",")))
    return j.select(c("n_name").alias("station"), F.explode(K.line_list(raw)).alias("line")).distinct()


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE regexp_replace(substr(text, 1, 39), '\\s+$', '') || '…' END AS clipped FROM documents")
def clip_text(s, d):
    return T(s, d, "documents").select("doc_id", K.clip(c("text"), 40).alias("clipped"))


@query("SELECT o_orderkey, format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS whole, format('{:,.2f}', o_totalprice) || '㎡' AS two FROM orders")
def format_number(s, d):
    return T(s, d, "orders").select("o_orderkey", K.format_number(c("o_totalprice")).alias("whole"), K.metric(c("o_totalprice"), "㎡").alias("two"))


# Derivations


@query(LIST + " SELECT doc_id, band FROM listing")
def area_band(s, d):
    return L(s, d).select("doc_id", D.area_band(c("area")).alias("band"))


@query(LIST + f""", q AS (SELECT quantile_cont(price, 0.33) AS lo, quantile_cont(price, 0.67) AS hi FROM listing)
  SELECT doc_id, CASE WHEN price >= hi THEN '{C.PRICE_LABELS[1]}' WHEN price <= lo THEN '{C.PRICE_LABELS[2]}' ELSE '{C.PRICE_LABELS[3]}' END AS label FROM listing, q""")
def quantile_label(s, d):
    return order.with_quantiles(L(s, d), "price").select("doc_id", D.three_way(c("price"), c("q_low"), c("q_high"), C.PRICE_LABELS).alias("label"))


@query(LIST + f""", t AS (SELECT *, coalesce(park, 0) + coalesce(hospital, 0) + coalesce(lines, 0) AS total FROM listing), q AS (SELECT quantile_cont(total, 0.33) AS lo, quantile_cont(total, 0.67) AS hi FROM t)
  SELECT doc_id, CASE WHEN total >= hi THEN '{C.INFRA_LABELS[1]}' WHEN total <= lo THEN '{C.INFRA_LABELS[2]}' ELSE '{C.INFRA_LABELS[3]}' END AS label FROM t, q""")
def living_infra(s, d):
    t = L(s, d).withColumn("total", D.total(c("park"), c("hospital"), c("lines")))
    return order.with_quantiles(t, "total").select("doc_id", D.three_way(c("total"), c("q_low"), c("q_high"), C.INFRA_LABELS).alias("label"))


_MED = "CASE WHEN lines + hospital + coalesce(park, 0) = 0 THEN '{0}' WHEN coalesce(park, 0) > 0 AND hospital > 0 THEN '{1}' WHEN coalesce(park, 0) > 0 THEN '{2}' WHEN hospital > 0 THEN '{3}' ELSE '{4}' END".format(*C.MEDICAL_LABELS)


@query(LIST + f" SELECT doc_id, {_MED} AS label, CAST(lines + hospital * 2 + coalesce(park, 0) * 3 AS DOUBLE) AS score FROM listing")
def medical_score(s, d):
    k = (c("lines"), c("hospital"), c("park"))
    return L(s, d).select("doc_id", D.medical_label(*k).alias("label"), D.medical_score(*k).alias("score"))


@query(LIST + f" SELECT doc_id, CASE WHEN distance IS NULL AND park IS NULL THEN '{C.COMMUTE_LABELS[0]}' WHEN coalesce(distance, 0) > coalesce(park, 0) THEN '{C.COMMUTE_LABELS[1]}' WHEN coalesce(park, 0) > coalesce(distance, 0) THEN '{C.COMMUTE_LABELS[2]}' ELSE '{C.COMMUTE_LABELS[3]}' END AS label FROM listing")
def commute_label(s, d):
    return L(s, d).select("doc_id", D.commute_label(c("park"), c("distance")).alias("label"))


@query(LIST + " SELECT doc_id, CASE WHEN distance IS NOT NULL THEN greatest(0.0::DOUBLE, 1000 - distance) + lines * 50 + CASE WHEN flag_text IN ('적용', '1') THEN 75 ELSE 0 END END AS score FROM listing")
def subway_score(s, d):
    return L(s, d).select("doc_id", D.subway_score(c("distance"), c("lines"), c("flag_text")).alias("score"))


@query(LIST + f""", f AS (SELECT doc_id, list_filter([CASE WHEN ordinal % 2 = 0 THEN '{C.POLICY_LABELS[0]}' END, CASE WHEN ordinal % 3 = 0 THEN '{C.POLICY_LABELS[1]}' END, CASE WHEN ordinal % 5 = 0 THEN '{C.POLICY_LABELS[2]}' END, CASE WHEN ordinal % 7 = 0 THEN '{C.POLICY_LABELS[3]}' END], lambda x: x IS NOT NULL) AS l FROM listing)
  SELECT doc_id, CASE len(l) WHEN 0 THEN '{C.POLICY_NONE}' WHEN 1 THEN l[1] || ' 단지입니다.' ELSE array_to_string(l[:len(l) - 1], ', ') || ' 및 ' || l[len(l)] || ' 단지입니다.' END AS policy FROM f""")
def policy_summary(s, d):
    flags = [F.when(c("ordinal") % k == 0, w).otherwise(n) for k, w, n in ((2, "Y", "N"), (3, "해당", "0"), (5, "1", "비해당"), (7, "TRUE", "x"))]
    return L(s, d).select("doc_id", D.policy_text(*flags).alias("policy"))


_IS = lambda x: f"lower({x}) IN ('1', '적용')"


@query(LIST + f" SELECT doc_id, coalesce(nullif(concat_ws('; ', CASE WHEN {_IS('flag_text')} THEN '분양 당시 투기과열지구' END, CASE WHEN lines = 1 THEN '현재 투기과열지구' END, CASE WHEN ordinal % 5 = 1 THEN '분양 당시 분양가상한제 적용' END), ''), '규제 특이사항 없음') AS notes FROM listing")
def special_notes(s, d):
    return L(s, d).select("doc_id", D.special_notes(c("flag_text"), c("lines"), F.when(c("ordinal") % 5 < 2, c("ordinal") % 5)).alias("notes"))


@query(LIST + " SELECT doc_id, round_even(distance / 8 * 1000, 1) AS metres FROM listing")
def km_to_m(s, d):
    return L(s, d).select("doc_id", D.metres(c("distance") / 8).alias("metres"))


@query("SELECT lang, format('{:.2f}', CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents) * 100) AS percent FROM documents GROUP BY lang")
def report_percent(s, d):
    docs = T(s, d, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n")).join(F.broadcast(docs.agg(F.count("*").alias("of")))).select("lang", D.percent(c("n"), c("of")).alias("percent"))


_FOOT = "'데이터 기준: ' || CASE WHEN conv_id % 3 = 0 THEN '제공된 문서 기준' ELSE '2023-09-05' END || chr(10) || '답변 가능 범위: ' || CASE WHEN conv_id % 4 = 0 THEN '제공된 문서 문맥 범위' ELSE '가격' END"


@query(f"WITH p AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN '' WHEN conv_id % 7 = 1 THEN 'x 데이터 기준: 1 답변 가능 범위: 2' WHEN conv_id % 7 = 2 THEN 'x 데이터 기준: 1' ELSE 'said ' || CAST(turn AS VARCHAR) END AS answer FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 2 = 1 OR conv_id % 7 = 1 THEN answer WHEN answer = '' THEN {_FOOT} ELSE answer || chr(10) || {_FOOT} END AS answer FROM p")
def disclosure_footer(s, d):
    said = F.expr("CASE WHEN conv_id % 7 = 0 THEN '' WHEN conv_id % 7 = 1 THEN 'x 데이터 기준: 1 답변 가능 범위: 2' WHEN conv_id % 7 = 2 THEN 'x 데이터 기준: 1' ELSE 'said ' || CAST(turn AS STRING) END")
    date, scope = F.when(c("conv_id") % 3 != 0, "2023-09-05"), F.when(c("conv_id") % 4 != 0, "가격").otherwise("nan")
    return T(s, d, "conversations").select("conv_id", "turn", D.disclosed_answer(said, F.when(c("turn") % 2 == 0, " Y ").otherwise("N"), date, scope).alias("answer"))


@query(LIST + """ SELECT doc_id, name || '은 ' || sido || ' ' || sigungu || ' ' || dong || '에 위치한 아파트 단지입니다. 총 ' || format('{:,}', households) || '세대 규모, 전용면적은 ' || format('{:,.2f}', area) || '㎡입니다.'
  || CASE WHEN station IS NULL AND distance IS NULL THEN '' ELSE ' ' || concat_ws(', ', '가장 가까운 지하철역은 ' || station, '약 ' || format('{:,}', CAST(distance AS BIGINT)) || 'm 거리') || '입니다.' END
  || ' 공급가는 ' || format('{:,}', CAST(price AS BIGINT)) || '만원 수준, ' || band || ' ' || '기타' AS description FROM listing""")
def description_concat(s, d):
    text = D.description(c("name"), D.location(c("sido"), c("sigungu"), c("dong")), c("households"), c("area"), c("station"), c("distance"), c("price"), c("band"), F.lit("기타"), F.lit("NULL"))
    return L(s, d).select("doc_id", text.alias("description"))


@query(LIST + " SELECT doc_id, concat_ws(', ', name, sido, sigungu, CASE WHEN station <> name THEN station END, band) AS keywords FROM listing")
def search_keywords(s, d):
    return L(s, d).select("doc_id", D.keywords(c("name"), c("sido"), c("sigungu"), c("name"), c("station"), c("band")).alias("keywords"))


@query(LIST + " SELECT doc_id, coalesce(nullif(concat_ws(', ', CASE WHEN distance IS NULL AND station IS NULL THEN '교통' END, CASE WHEN park IS NULL THEN '공원' END, '학교'), ''), '없음') AS missing FROM listing")
def missing_fields(s, d):
    return L(s, d).select("doc_id", D.missing_fields({"교통": [c("distance"), c("station")], "공원": [c("park")], "학교": []}).alias("missing"))


@query(LIST + " SELECT doc_id, concat_ws('|', '지역', CASE WHEN distance IS NOT NULL OR station IS NOT NULL THEN '교통' END, CASE WHEN park IS NOT NULL THEN '공원' END) AS tags FROM listing")
def query_tags(s, d):
    return L(s, d).select("doc_id", D.query_tags({"지역": [c("sido")], "교통": [c("distance"), c("station")], "공원": [c("park")], "학교": []}).alias("tags"))


@query("SELECT coalesce(r_name, '') AS region, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS districts FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def region_groups(s, d):
    g = T(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("a"))
    return T(s, d, "region").join(g, c("n_regionkey") == c("r_regionkey"), "left").select(c("r_name").alias("region"), F.array_join("a", ",").alias("districts"))


# Recommendations and routing


_RANK = "row_number() OVER (PARTITION BY sigungu ORDER BY distance ASC NULLS LAST, price ASC NULLS LAST, households DESC NULLS LAST, doc_id)"
_TOP3 = LIST + """, m AS (SELECT *, row_number() OVER (PARTITION BY sigungu, name ORDER BY distance ASC NULLS LAST, price ASC NULLS LAST, households DESC NULLS LAST, doc_id) AS n FROM listing WHERE price <= 150000 AND distance <= 900)
  SELECT * FROM (SELECT sigungu, doc_id, name, CAST(%s AS INTEGER) AS rank FROM m WHERE n = 1) WHERE rank <= 3""" % _RANK


@query(LIST + " SELECT doc_id, name, price FROM listing WHERE sido = 'ASIA' AND band = '중형' AND price <= 150000 AND distance <= 900 AND area >= 60 AND year >= 2012 AND households >= 500")
def structured_filter(s, d):
    found, _ = recommend.meets(L(s, d).where(recommend.in_region(sido="ASIA")), band="중형", price_max=150000, distance_max=900, area_min=60.0, year_min=2012, households_min=500)
    return found.select("doc_id", "name", "price")


@query(_TOP3)
def structured_top3(s, d):
    found, _ = recommend.meets(L(s, d), price_max=150000, distance_max=900)
    return recommend.best_names(found, ["sigungu"], recommend.order_for()).select("sigungu", "doc_id", "name", "rank")


@query(LIST + """, m AS (SELECT *, row_number() OVER (PARTITION BY sido, name ORDER BY park DESC, doc_id) AS n FROM listing WHERE park IS NOT NULL)
  SELECT * FROM (SELECT sido, doc_id, park, CAST(row_number() OVER (PARTITION BY sido ORDER BY park DESC, doc_id) AS INTEGER) AS rank FROM m WHERE n = 1) WHERE rank <= 3""")
def comparative_top3(s, d):
    return recommend.comparative(L(s, d), "park", ["sido"]).select("sido", "doc_id", "park", "rank")


_BAND_STRICT = "CASE " + " ".join(f"WHEN contains(question, '{b}') THEN '{b}'" for b in C.BAND_ORDER) + " END"
_NEAR, _FINE = HAS("question", C.NEAR_SUBWAY), HAS("question", C.PRICE_FINE)
_FILTERS = f"""SELECT *, TRY_CAST(nullif(regexp_extract(question, '(\\d+)\\s*억\\s*이하', 1), '') AS BIGINT) * 10000 AS price_max_manwon,
  coalesce(TRY_CAST(nullif(regexp_extract(question, '(?i)(\\d+)\\s*m\\s*이내', 1), '') AS BIGINT), CASE WHEN {_NEAR} THEN 500 END) AS distance_subway_max_m,
  TRY_CAST(nullif(regexp_extract(question, '전용(?:면적)?\\s*(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS exclusive_area_min,
  TRY_CAST(nullif(regexp_extract(question, '(\\d+)\\s*세대\\s*이상', 1), '') AS BIGINT) AS households_min,
  CAST(CASE WHEN contains(question, '신축') THEN 2020 END AS BIGINT) AS move_in_year_min, {_FINE} AS prefer_low_price, {_NEAR} AS prefer_near_subway,
  contains(question, '{C.PARK_AND_HOSPITAL}') AS prefer_park_hospital_access, {_BAND_STRICT} AS area_band_label FROM questions"""


@query(f"{ASK} {_FILTERS}")
def parse_filters(s, d):
    return V.questions(s, d).select("qid", "question", route.filters(K.collapse(c("question")), strict_band=True).alias("f")).select("qid", "question", "f.*")


_TAGS = ", ".join(f"CASE WHEN {' OR '.join(('contains(replace(replace(replace(question, chr(51648) || chr(50669), chr(35)), chr(44396) || chr(50669), chr(35)), chr(44428) || chr(50669), chr(35)), chr(50669))' if a == '역' else f'contains(question, {chr(39)}{a}{chr(39)})') for a in al)} THEN '{t}' END" for t, al in C.COMPARATIVE_ALIASES.items())
_LONGEST = lambda table, col, out: f"(SELECT arg_max(x, (length(x), x)) FROM (SELECT DISTINCT {col} AS x FROM {table}) WHERE contains(question, x)) AS {out}"
_AMB = f"(region AND {HAS('question', C.AMBIGUOUS_SCOPE)} AND NOT ex)"
_UNS = f"(({HAS('question', C.UNSUPPORTED_QUALIFIERS)} AND NOT obj) OR {HAS('question', C.VAGUE_AMENITIES)} OR (area_band_label IS NOT NULL AND prefer_low_price) OR (area_band_label IS NOT NULL AND NOT obj AND NOT phrase) OR (region AND {HAS('question', C.RECOMMEND)} AND plain) OR (region AND {HAS('question', C.VAGUE_SYNTAX)} AND plain))"
_VAGUE = f"(tagged AND {HAS('question', C.VAGUE_PLACES)})"
_UCMP = f"(NOT prefer_low_price AND ({HAS('question', C.UNSUPPORTED_COMPARATIVE)} OR (tagged AND {HAS('question', C.UNSUPPORTED_COMPARATIVE_SYNTAX)})))"
_ROUTE = f"""WITH {V.QA_LISTING}, {V.QUESTIONS}, terms(term) AS (VALUES {", ".join(f"('{t[0]}')" for t in V.TERMS)}),
f AS ({_FILTERS}),
e AS (SELECT *, list_filter([{_TAGS}], lambda x: x IS NOT NULL) AS tags, {_LONGEST("listing", "name", "name")}, {_LONGEST("terms", "term", "term")}, {_LONGEST("listing", "sido", "sido")}, {_LONGEST("listing", "sigungu", "sigungu")}, {_LONGEST("listing", "dong", "dong")} FROM f),
o AS (SELECT *, price_max_manwon IS NOT NULL OR distance_subway_max_m IS NOT NULL OR move_in_year_min IS NOT NULL OR households_min IS NOT NULL OR prefer_low_price OR prefer_near_subway OR prefer_park_hospital_access AS obj,
  coalesce(sido, sigungu, dong) IS NOT NULL AS region, len(tags) > 0 AS tagged, {HAS("question", C.SUPPORTED_PHRASES)} AS phrase FROM e),
x AS (SELECT *, obj OR exclusive_area_min IS NOT NULL AS ex FROM o),
g AS (SELECT *, NOT ex AND NOT tagged AND NOT phrase AS plain FROM x),
r AS (SELECT *, CASE WHEN {HAS("question", C.META)} THEN 'DATA_SCOPE_META' WHEN term IS NOT NULL AND {HAS("question", C.KNOWLEDGE)} THEN 'REAL_ESTATE_KNOWLEDGE' WHEN name IS NOT NULL THEN 'APARTMENT_FACT_LOOKUP'
  WHEN term IS NULL AND NOT tagged AND NOT {HAS("question", C.AMBIGUOUS_SCOPE)} AND NOT {HAS("question", C.UNSUPPORTED_QUALIFIERS)} AND NOT {HAS("question", C.VAGUE_AMENITIES)} AND NOT ex AND NOT {HAS("question", C.HARD_SELECTION)} AND NOT {HAS("question", C.COMPARISON)} AND region AND {HAS("question", C.GENERAL_RETRIEVAL)} THEN 'GENERAL_RETRIEVAL_QA'
  WHEN NOT prefer_low_price AND {HAS("question", C.SUBJECTIVE)} AND {HAS("question", C.SELECTION)} THEN 'RECOMMEND_COMPARATIVE' WHEN {_AMB} OR {_UNS} THEN 'RECOMMEND_STRUCTURED' WHEN {_VAGUE} OR {_UCMP} THEN 'RECOMMEND_COMPARATIVE'
  WHEN tagged AND {HAS("question", C.COMPARISON)} THEN 'RECOMMEND_COMPARATIVE' WHEN {HAS("question", C.RECOMMEND)} OR ex OR area_band_label IS NOT NULL OR region THEN 'RECOMMEND_STRUCTURED' ELSE 'GENERAL_RETRIEVAL_QA' END AS query_type, {_AMB} AS amb, {_UNS} AS uns, {_VAGUE} OR {_UCMP} AS cannot FROM g)
"""


def _parsed(s, d):
    return route.parse(V.questions(s, d), L(s, d), V.knowledge(s), strict_band=True)


@query(_ROUTE + " SELECT qid, query_type, array_to_string(tags, ',') AS tags, sigungu, dong FROM r")
def route_query(s, d):
    return _parsed(s, d).select("qid", "query_type", F.array_join("tags", ",").alias("tags"), "sigungu", "dong")


_NL = "chr(10)"
_LIT0 = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_TEXT = lambda x: f"CASE WHEN trim(CAST({x} AS VARCHAR)) NOT IN ('', 'nan', 'None', 'NULL', 'null') THEN trim(CAST({x} AS VARCHAR)) END"
_HELD = ("households area supply_area price price_summary price_per_pyeong year station distance line_summary medical hospital lifestyle commute policy builder park description").split()
_FIELDS_SQL = "list_concat(" * (len(C.LOOKUP_FIELDS) - 1) + ", ".join((f"CASE WHEN {HAS('question', words)} THEN [{', '.join(repr(n) for n in names)}] ELSE [] END" + (")" if i else "")) for i, (words, names) in enumerate(C.LOOKUP_FIELDS))
_VALUE_SQL = "CASE x " + " ".join(f"WHEN '{f}' THEN {_TEXT('l.' + col)}" for f, col in C.FIELD_COLUMNS.items() if col in _HELD) + " END"
_TAIL = f"'데이터 기준: ' || cutoff || {_NL} || '{C.DISCLOSURE_SCOPE}'"
_WISH = "coalesce(prefer_park_hospital_access, false)", "coalesce(prefer_near_subway, false)", "coalesce(prefer_low_price, false)"
_ANY = " OR ".join(_WISH)
_INF = "CAST('infinity' AS DOUBLE)"
_BY = f"""CASE WHEN {_WISH[0]} THEN coalesce(-l.park, {_INF}) ELSE 0 END, CASE WHEN {_WISH[0]} THEN coalesce(-l.hospital, {_INF}) ELSE 0 END, CASE WHEN {_WISH[1]} OR NOT ({_ANY}) THEN coalesce(l.distance, {_INF}) ELSE 0 END,
  CASE WHEN {_WISH[2]} OR NOT ({_ANY}) THEN coalesce(l.price, {_INF}) ELSE 0 END, CASE WHEN NOT ({_ANY}) THEN coalesce(-l.households, {_INF}) ELSE 0 END, l.doc_id"""
_HERE = "(r.sido IS NULL OR r.sido = l.sido) AND (r.sigungu IS NULL OR r.sigungu = l.sigungu) AND (r.dong IS NULL OR r.dong = l.dong)"
_LIMITS = """(area_band_label IS NULL OR l.band = area_band_label) AND (price_max_manwon IS NULL OR l.price <= price_max_manwon) AND (distance_subway_max_m IS NULL OR l.distance <= distance_subway_max_m)
  AND (exclusive_area_min IS NULL OR l.area >= exclusive_area_min) AND (move_in_year_min IS NULL OR l.year >= move_in_year_min) AND (households_min IS NULL OR l.households >= households_min)"""
_BITS = f"concat_ws(', ', '역 ' || {_TEXT('l.station')}, {_TEXT('l.distance')} || 'm', '공급액 ' || {_TEXT('l.price')} || '만원', '전용 ' || {_TEXT('l.area')} || '㎡', {_TEXT('l.lifestyle')})"
_SCORED = "CASE r.tags[1] WHEN '공원' THEN l.park WHEN '병원' THEN l.hospital WHEN '지하철' THEN l.subway END"
_TOPS = lambda name, where, by, line: f"""{name}1 AS (SELECT qid, l.name AS n, l.doc_id AS d, {line} AS line, row_number() OVER (PARTITION BY qid ORDER BY {by}) AS o, row_number() OVER (PARTITION BY qid, l.name ORDER BY {by}) AS first FROM r JOIN qa_listing l ON {_HERE} AND {where}),
{name}2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY o) AS rank FROM {name}1 WHERE first = 1),
{name} AS (SELECT qid, list(d ORDER BY rank) AS ids, string_agg('- ' || n || ': ' || line, {_NL} ORDER BY rank) AS lines FROM {name}2 WHERE rank <= 3 GROUP BY qid)"""  # noqa: E731
_MEAN = f"'{C.FALLBACK}' || {_NL} || '판단 보류 항목: %s' || {_NL} || {_TAIL}"
_ANSWERS = f"""{_ROUTE}, cut AS (SELECT coalesce(arg_min(cutoff, doc_id) FILTER (WHERE cutoff IS NOT NULL), '{C.NO_CUTOFF}') AS cutoff FROM listing),
kb(kt, definition, fields, caution) AS (VALUES {", ".join("(" + ", ".join(_LIT0(x) for x in term) + ")" for term in V.TERMS)}),
fl AS (SELECT qid, CASE WHEN len(f) = 0 THEN ['description'] ELSE list_filter(f, lambda x, i: list_position(f, x) = i) END AS fields FROM (SELECT qid, {_FIELDS_SQL} AS f FROM r WHERE query_type = 'APARTMENT_FACT_LOOKUP')),
fact AS (SELECT r.qid, l.doc_id AS d, list_filter(list_transform(fl.fields, lambda x: x || ': ' || {_VALUE_SQL}), lambda x: x IS NOT NULL) AS lines FROM r JOIN fl USING (qid) JOIN (SELECT * FROM qa_listing QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id) = 1) l ON l.name = r.name WHERE query_type = 'APARTMENT_FACT_LOOKUP'),
{_TOPS("st", f"query_type = 'RECOMMEND_STRUCTURED' AND NOT amb AND NOT uns AND {_LIMITS}", _BY, _BITS)},
{_TOPS("cm", f"query_type = 'RECOMMEND_COMPARATIVE' AND NOT cannot AND {_SCORED} IS NOT NULL", f"{_SCORED} DESC, l.doc_id", f"CAST({_SCORED} AS VARCHAR)")},
j AS (SELECT r.*, cutoff, kb.*, fact.d AS fact_doc, fact.lines AS facts, st.ids AS st_ids, st.lines AS st_lines, cm.ids AS cm_ids, cm.lines AS cm_lines FROM r CROSS JOIN cut LEFT JOIN kb ON r.query_type = 'REAL_ESTATE_KNOWLEDGE' AND kt = r.term LEFT JOIN fact ON fact.qid = r.qid LEFT JOIN st ON st.qid = r.qid LEFT JOIN cm ON cm.qid = r.qid WHERE r.query_type <> 'GENERAL_RETRIEVAL_QA'),
k AS (SELECT qid, query_type, CASE query_type WHEN 'DATA_SCOPE_META' THEN 'meta_answer' WHEN 'REAL_ESTATE_KNOWLEDGE' THEN 'knowledge_answer' WHEN 'APARTMENT_FACT_LOOKUP' THEN 'apartment_fact_lookup' WHEN 'RECOMMEND_STRUCTURED' THEN CASE WHEN amb OR uns THEN 'unknown_response' WHEN st_ids IS NULL THEN 'no_match_response' ELSE 'recommendation' END
    ELSE CASE WHEN cannot OR NOT tagged THEN 'unsupported_comparative_response' WHEN cm_ids IS NULL THEN 'unknown_response' ELSE 'comparison_recommendation' END END AS answer_type,
  CASE query_type WHEN 'APARTMENT_FACT_LOOKUP' THEN [fact_doc] WHEN 'RECOMMEND_STRUCTURED' THEN coalesce(st_ids, []) WHEN 'RECOMMEND_COMPARATIVE' THEN coalesce(cm_ids, []) ELSE [] END AS ids,
  CASE query_type WHEN 'DATA_SCOPE_META' THEN '데이터 기준: ' || cutoff || {_NL} || '{C.META_SCOPE}' || {_NL} || '{C.META_EXAMPLES}'
    WHEN 'REAL_ESTATE_KNOWLEDGE' THEN '일반 설명: ' || definition || {_NL} || '우리 데이터에 연결 가능한 필드: ' || fields || {_NL} || '주의사항: ' || caution || {_NL} || '데이터 기준: ' || cutoff
    WHEN 'APARTMENT_FACT_LOOKUP' THEN name || ' 정보입니다.' || {_NL} || CASE WHEN len(facts) > 0 THEN array_to_string(facts, {_NL}) ELSE '{C.NO_FACT}' END || {_NL} || '데이터 기준: ' || cutoff
    WHEN 'RECOMMEND_STRUCTURED' THEN CASE WHEN amb THEN {_MEAN % "범위 표현"} WHEN uns THEN {_MEAN % "지원하지 않는 추천 표현"} WHEN st_ids IS NULL THEN '현재 데이터 기준(' || cutoff || ')으로 해당 조건에 맞는 아파트를 찾지 못했습니다.' || {_NL} || '조건을 완화하거나 지역, 예산, 거리 기준을 다시 지정해 주세요.' || {_NL} || {_TAIL} ELSE '조건에 맞는 아파트 후보입니다.' || {_NL} || st_lines || {_NL} || {_TAIL} END
    ELSE CASE WHEN cannot THEN {_LIT0(chr(10).join(C.UNSUPPORTED_ANSWER))} || {_NL} || {_TAIL} WHEN NOT tagged THEN '비교 기준을 해석하지 못했습니다. 공원, 병원, 지하철, 학교처럼 명시적인 기준으로 다시 질문해 주세요.'
      WHEN cm_ids IS NULL THEN '현재 데이터로는 ' || tags[1] || ' 기준 비교를 안전하게 판단할 수 없습니다.' || {_NL} || {_TAIL} ELSE '비교 기준: ' || tags[1] || {_NL} || cm_lines || {_NL} || {_TAIL} END END AS answer FROM j)
SELECT qid, query_type, answer_type, CASE answer_type WHEN 'no_match_response' THEN 'NO_MATCH' WHEN 'unknown_response' THEN 'UNKNOWN' WHEN 'unsupported_comparative_response' THEN 'UNKNOWN' WHEN 'meta_answer' THEN 'KNOWN' WHEN 'knowledge_answer' THEN 'KNOWN' ELSE 'EXACT_MATCH' END AS match_status,
  coalesce(ids[1], '') AS top_doc_id, array_to_string(ids, '|') AS cited_doc_ids, answer FROM k"""


@query(_ANSWERS)
def answer_questions(s, d):
    listing = V.qa_listing(s, d)
    return recommend.answers(route.parse(V.questions(s, d), listing, V.knowledge(s), strict_band=True), listing, V.knowledge(s)).select("qid", "query_type", "answer_type", "match_status", "top_doc_id", F.array_join("cited_doc_ids", "|").alias("cited_doc_ids"), "answer")


@query(f"""WITH {V.LISTING}, t(term, definition) AS (VALUES {", ".join(f"('{t[0]}', '{t[1]}')" for t in V.TERMS)}), q AS (SELECT text AS x FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT n_name || term || ' 뜻' FROM nation, t)
  SELECT term, definition, (SELECT arg_min(cutoff, doc_id) FROM listing WHERE cutoff IS NOT NULL) AS data_cutoff, (SELECT count(*) FROM q WHERE contains(x, term)) AS mentions FROM t""")
def knowledge_base(s, d):
    """The knowledge records with the cutoff of the listings, and how many documents, turns and questions name each term."""
    base = V.knowledge(s)
    asked = T(s, d, "nation").select("n_name").crossJoin(F.broadcast(base.select("term"))).select(F.concat("n_name", "term", F.lit(" 뜻")).alias("text"))  # six terms
    texts = T(s, d, "documents").select("text").unionByName(T(s, d, "conversations").select("text")).unionByName(asked).withColumn("row", F.monotonically_increasing_id())
    named = dictionary.contained(texts, base.select(F.lit("term").alias("kind"), c("term").alias("entry")), "row", "text").groupBy(c("entry").alias("term")).agg(F.count("*").alias("mentions"))
    cut = recommend.data_cutoff(L(s, d)).withColumnRenamed("cutoff", "data_cutoff")
    return base.drop("data_cutoff").join(F.broadcast(cut)).join(named, "term", "left").select("term", "definition", "data_cutoff", F.coalesce("mentions", F.lit(0)).cast("bigint").alias("mentions"))


# Retrieval


_SCORES = f"""WITH q AS (SELECT item_id AS qid, text, unnest(list_distinct(list_filter(string_split({NORM("text")}, ' '), lambda t: t <> ''))) AS token FROM benchmark),
p AS (SELECT doc_id AS doc, unnest(list_distinct(list_filter(string_split({NORM("text")}, ' '), lambda t: t <> ''))) AS token FROM documents),
o AS (SELECT qid, doc, CAST(count(*) AS DOUBLE) AS score FROM q JOIN p USING (token) GROUP BY ALL),
b AS (SELECT item_id AS qid, doc_id AS doc, 2.0::DOUBLE AS score FROM benchmark, documents WHERE contains(benchmark.text, lang)),
t AS (SELECT qid, doc, sum(score) AS score FROM (SELECT * FROM o UNION ALL SELECT * FROM b) GROUP BY ALL),
r AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM t)
"""


def _ranked(s, d):
    return retrieve.top_k(T(s, d, "benchmark"), T(s, d, "documents"), 3, qid="item_id", question="text", doc="doc_id", content="text", boosts={"lang": 2.0})


@query(_SCORES + "SELECT qid, CAST(rank AS INTEGER) AS rank, doc, score FROM r WHERE rank <= 3")
def retrieve_topk(s, d):
    return _ranked(s, d)


@query(_SCORES + "SELECT qid, max(score) AS top_score, CASE WHEN max(score) < 40 THEN 'fallback_answer' ELSE 'grounded_generation' END AS answer_type FROM r GROUP BY qid")
def retrieval_fallback(s, d):
    return retrieve.gated(_ranked(s, d), 40.0)


@query(_SCORES + "SELECT qid, string_agg('[' || doc || '] ' || coalesce(text, ''), chr(10) ORDER BY rank) AS context FROM r JOIN documents ON doc = doc_id WHERE rank <= 3 GROUP BY qid")
def context_block(s, d):
    return retrieve.context_blocks(_ranked(s, d), T(s, d, "documents"), "doc_id", "text")


# Metrics and failures


_NOSPACE = lambda profile, x: HAS(f"replace({x}, ' ', '')", [h.replace(" ", "") for h in C.DISCLOSURE[profile][1]])
_WORDS = lambda x: HAS(NORM(x), C.DISCLOSURE["eval"][1])
_RATE = lambda cond: f"round(CAST(count(*) FILTER (WHERE {cond}) AS DOUBLE) / count(*), 6)"


@query(f"""{PRED} SELECT count(*) AS total_questions, {_RATE("expected_doc <> '' AND list_contains(string_split(cited_doc_ids, '|'), expected_doc)")} AS retrieval_hit_rate,
  {_RATE(f"{NORM('answer')} = {NORM('expected_answer')}")} AS exact_match_rate, {_RATE(f"answer <> '' AND trim(expected_answer) <> '' AND contains({NORM('answer')}, {NORM('expected_answer')})")} AS contains_expected_answer_rate,
  {_RATE("expected_answer_type <> '' AND expected_answer_type = answer_type")} AS answer_type_match_rate, {_RATE("expected_match_status = match_status")} AS match_status_match_rate,
  {_RATE(f"must_include IS NULL OR trim(must_include) = '' OR contains({NORM('answer')}, {NORM('must_include')})")} AS must_include_pass_rate, {_RATE(f"must_not_include = '' OR NOT contains({NORM('answer')}, must_not_include)")} AS must_not_include_pass_rate,
  {_RATE("insufficient_context")} AS insufficient_context_rate, round(avg(latency_ms), 6) AS avg_latency_ms FROM pred""")
def eval_metrics(s, d):
    m = evaluate.eval_metrics(P(s, d).withColumn("expected_doc_id", c("expected_doc")))
    return m.select("total_questions", *(r6(x).alias(x) for x in m.columns[1:]))


@query(f"""{PRED} SELECT count(*) AS total_questions, {_RATE("list_contains(string_split(cited_doc_ids, '|'), expected_doc)")} AS doc_hit_rate, {_RATE("list_contains(string_split(used_fields, '|'), expected_field)")} AS field_hit_rate,
  {_RATE("expected_router_type <> '' AND query_type = expected_router_type")} AS router_match_rate, {_RATE("match_status = expected_match_status")} AS match_status_match_rate,
  round(CAST(count(*) FILTER (WHERE trim(must_not_recommend) = 'Y' AND top_doc_id = '') AS DOUBLE) / count(*) FILTER (WHERE trim(must_not_recommend) = 'Y'), 6) AS must_not_recommend_pass_rate, round(CAST(count(*) FILTER (WHERE must_disclose_limit = 'Y' AND {_WORDS("answer")}) AS DOUBLE) / count(*) FILTER (WHERE must_disclose_limit = 'Y'), 6) AS must_disclose_limit_pass_rate,
  {_RATE("insufficient_context")} AS insufficient_context_rate, round(avg(latency_ms), 6) AS avg_latency_ms FROM pred""")
def edge_metrics(s, d):
    m = evaluate.edge_metrics(P(s, d)).drop("unsafe_recommendation", "disclosure_miss")
    return m.select("total_questions", *(r6(x).alias(x) for x in m.columns[1:]))


_FLAGS = f"""flags AS (SELECT *, answer_type = '' OR match_status = '' OR query_type = '' AS is_legacy_schema, expected_router_type <> '' AND query_type <> expected_router_type AS router_mismatch,
  expected_match_status <> match_status AS match_status_mismatch, trim(must_not_recommend) = 'Y' AND top_doc_id <> '' AS unsafe_recommendation, must_disclose_limit = 'Y' AS disclosure_required, {_NOSPACE("failures", "answer")} AS has_limit_disclosure,
  {HAS("question", C.BAND_ORDER)} AND expected_match_status = 'UNKNOWN' AS area_band_unknown_candidate FROM pred)"""


_MISS = {"disclosure_miss": "disclosure_required AND NOT has_limit_disclosure"}
_BUCKETS = [("legacy_schema", "is_legacy_schema")] + [
    (f"{b}{tail}", f"({_MISS.get(b, b)}){also}")
    for b in ("unsafe_recommendation", "router_mismatch", "match_status_mismatch", "disclosure_miss", "area_band_unknown_candidate")
    for tail, also in (("", ""), ("_current_schema", " AND NOT is_legacy_schema"))
]
_BUCKETS_SQL = f"{PRED}, {_FLAGS} " + " UNION ALL ".join(f"SELECT '{name}' AS bucket, count(*) FILTER (WHERE {test}) AS rows FROM flags" for name, test in _BUCKETS)


@query(_BUCKETS_SQL)
def failure_buckets(s, d):
    return evaluate.schema_buckets(evaluate.failure_flags(P(s, d)))


_FAMILY = f"""CASE WHEN expected_router_type = '' OR expected_router_type = query_type THEN ''
  WHEN expected_router_type = 'RECOMMEND_COMPARATIVE' AND query_type = 'RECOMMEND_STRUCTURED' THEN CASE WHEN {HAS("question", C.SUBJECTIVE)} THEN 'subjective_quality_structured_instead_of_comparative' WHEN contains(question, '비교') AND {HAS("question", C.BAND_ORDER)} THEN 'area_band_comparative_structured_instead_of_comparative' ELSE 'comparative_expected_but_structured_actual' END
  WHEN expected_router_type = 'RECOMMEND_STRUCTURED' AND query_type = 'RECOMMEND_COMPARATIVE' THEN CASE WHEN contains(question, '비교') AND {HAS("question", C.BAND_ORDER)} THEN 'area_band_structured_but_comparative_actual' ELSE 'structured_expected_but_comparative_actual' END
  WHEN query_type = 'GENERAL_RETRIEVAL_QA' THEN 'fell_through_to_grounded_generation' ELSE lower(expected_router_type) || '_to_' || lower(query_type) END"""


@query(f"{PRED}, {_FLAGS} SELECT {_FAMILY} AS router_mismatch_family, count(*) AS rows FROM flags WHERE router_mismatch AND NOT is_legacy_schema GROUP BY 1")
def router_families(s, d):
    return relational.value_counts(evaluate.router_mismatches(evaluate.failure_flags(P(s, d))), "router_mismatch_family")


@query(f"{PRED}, {_FLAGS} SELECT source_row_index, CASE WHEN area_band_unknown_candidate THEN 'route_to_unknown_before_recommendation' ELSE 'review_safety_rule' END AS recommended_action FROM flags WHERE unsafe_recommendation AND NOT is_legacy_schema")
def hard_negative_queue(s, d):
    return evaluate.hard_negatives(evaluate.failure_flags(P(s, d))).select("source_row_index", "recommended_action")


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM events), k AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS w FROM e WHERE n > 2)
  SELECT count(*) AS raw_rows, round(avg(value), 6) AS raw_avg, round(quantile_cont(value, 0.95), 6) AS raw_p95, (SELECT count(*) FROM k WHERE w > 1) AS trimmed_rows, (SELECT round(avg(value), 6) FROM k WHERE w > 1) AS trimmed_avg, (SELECT round(quantile_cont(value, 0.95), 6) FROM k WHERE w > 1) AS trimmed_p95 FROM events""")
def latency_trimmed(s, d):
    m = evaluate.latency_stats(T(s, d, "events"), ["event_id"], "value")
    return m.select("raw_rows", r6(c("raw_avg")).alias("raw_avg"), r6(c("raw_p95")).alias("raw_p95"), "trimmed_rows", r6(c("trimmed_avg")).alias("trimmed_avg"), r6(c("trimmed_p95")).alias("trimmed_p95"))


@query("SELECT count(*) AS rows, round(avg(value), 6) AS window_avg, round(quantile_cont(value, 0.95), 6) AS window_p95 FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 50)")
def latency_tail_window(s, d):
    return evaluate.tail_window(T(s, d, "events"), ["event_id"], "value", 50).select("rows", r6(c("window_avg")).alias("window_avg"), r6(c("window_p95")).alias("window_p95"))


@query("SELECT CAST(min(n) AS INTEGER) AS min_tokens, CAST(max(n) AS INTEGER) AS max_tokens, round(avg(n), 6) AS avg_tokens, count(*) FILTER (WHERE n > 400) AS over_budget FROM (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS n FROM documents)")
def token_stats(s, d):
    return evaluate.token_stats(T(s, d, "documents"), "text", 400).withColumn("avg_tokens", r6(c("avg_tokens")))


# Curation and gates


def _candidates(s, d):
    p = P(s, d)
    return curate.candidates(p.where("role = 'user'").drop("role", "must_include"), p.where("role <> 'user'").drop("role", "expected_field"))


_ID = "sha256(source_dataset || '||' || source_row_index || '||' || trim(question) || '||' || answer_type)"
_CAND = f"""{PRED}, cand AS (SELECT *, {_ID} AS stable_id, CASE WHEN upper(trim(must_not_recommend)) IN ('Y', 'N') THEN upper(trim(must_not_recommend)) ELSE '' END AS no_rec FROM (SELECT *, CASE WHEN role = 'user' THEN 'edge' ELSE 'eval' END AS source_dataset FROM pred)),
dup AS (SELECT *, row_number() OVER (PARTITION BY source_dataset, source_row_index ORDER BY stable_id) > 1 AS rep, row_number() OVER (PARTITION BY trim(question), trim(answer) ORDER BY source_dataset, source_row_index, stable_id) > 1 AS again FROM cand),
cls AS (SELECT *, CASE WHEN rep THEN 'duplicate_source_row' WHEN again AND trim(question) <> '' AND trim(answer) <> '' THEN 'duplicate_question_answer' WHEN trim(question) = '' THEN 'missing_question' WHEN trim(answer) = '' THEN 'missing_answer' WHEN answer_type = '' OR match_status = '' OR query_type = '' THEN 'missing_contract_fields'
  WHEN answer_type = 'grounded_generation' THEN CASE WHEN insufficient_context THEN 'grounded_generation_insufficient_context' ELSE '' END WHEN answer_type IN ('unsupported_comparative_response', 'no_match_response', 'unknown_response') THEN ''
  WHEN answer_type IN ('recommendation', 'comparison_recommendation') THEN CASE WHEN match_status <> 'EXACT_MATCH' THEN 'recommendation_not_exact_match' WHEN no_rec = 'Y' THEN 'recommendation_flagged_must_not_recommend' WHEN must_disclose_limit = 'Y' AND NOT {_NOSPACE("sft", "answer")} THEN 'recommendation_missing_disclosure_language' ELSE '' END
  WHEN answer_type = 'meta_answer' THEN 'deterministic_meta_excluded' WHEN answer_type = 'fallback_answer' THEN 'fallback_answer_excluded' ELSE 'unsupported_answer_type:' || answer_type END AS reason FROM dup),
bkt AS (SELECT *, CASE WHEN reason <> '' THEN 'excluded' WHEN answer_type = 'grounded_generation' THEN 'grounded_generation' WHEN answer_type IN ('no_match_response', 'unknown_response') THEN 'safety_refusal' ELSE 'safe_recommendation' END AS bucket FROM cls)"""


@query(f"{_CAND} SELECT source_dataset, source_row_index, stable_id FROM cand")
def stable_ids(s, d):
    return _candidates(s, d).select("source_dataset", "source_row_index", "stable_id")


@query(f"{_CAND} SELECT source_dataset, count(*) AS rows, count(*) FILTER (WHERE no_rec = 'Y') AS flagged FROM cand GROUP BY 1")
def union_candidates(s, d):
    return _candidates(s, d).groupBy("source_dataset").agg(F.count("*").alias("rows"), F.count_if(c("must_not_recommend") == "Y").alias("flagged"))


@query(f"{_CAND} SELECT source_dataset, source_row_index, bucket AS sft_bucket, reason AS exclusion_reason FROM bkt")
def classify_rows(s, d):
    return curate.classified(_candidates(s, d)).select("source_dataset", "source_row_index", "sft_bucket", "exclusion_reason")


@query(f"""{_CAND}, w AS (SELECT stable_id, bucket, count(*) OVER (PARTITION BY bucket) AS n, row_number() OVER (PARTITION BY bucket ORDER BY sha256('valid::' || bucket || '||' || stable_id), stable_id) AS r FROM bkt)
  SELECT stable_id, bucket AS sft_bucket, CASE WHEN r <= CASE WHEN n <= 1 THEN 0 ELSE least(CASE WHEN round_even(n * 0.1, 0) = 0 THEN CASE WHEN n >= 5 THEN 1 ELSE 0 END ELSE round_even(n * 0.1, 0) END, n - 1) END THEN 'valid' ELSE 'train' END AS split FROM w""")
def stratified_split(s, d):
    return curate.stratified(curate.classified(_candidates(s, d)), "sft_bucket", "stable_id").select("stable_id", "sft_bucket", "split")


def _quota_sql(pool, bands, of=None, nearest=False):
    part = lambda share: f"round_even({pool} * {share}, 0)" if nearest else f"floor({pool} * {share})"
    arms = " ".join(f"WHEN {of or pool} >= {start} THEN least({'(' + pool + ') - 1' if most is None else most}, greatest({least}, {part(share)}))" for start, share, least, most in sorted(bands, reverse=True))
    return f"CAST(CASE WHEN {pool} = 0 THEN 0 {arms} END AS BIGINT)"


def _first_sql(source, salt, n):
    return f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY sha256('{salt}||' || stable_id), stable_id) AS turn FROM {source}) WHERE turn <= ({n}))"


_LEAST = C.MIN_TRAIN + C.MIN_VALID
_MIX = lambda name: f"CAST(round_even(g * {C.TARGET_MIX[name] / C.TARGET_MIX['grounded_generation']!r}, 0) AS BIGINT)"
_SELECTION = f"""{_CAND}, inc AS (SELECT * FROM bkt WHERE reason = ''),
gg AS (SELECT * FROM inc WHERE bucket = 'grounded_generation'),
hg0 AS {_first_sql("gg", C.SALTS["grounded"], "SELECT " + _quota_sql("(SELECT count(*) FROM gg)", C.HOLDOUT_GROUNDED))},
risky AS (SELECT * FROM bkt WHERE (reason = '' OR reason IN ({", ".join(f"'{r}'" for r in C.SAFETY_UNIVERSE_REASONS)})) AND stable_id NOT IN (SELECT stable_id FROM hg0) AND (no_rec = 'Y' OR must_disclose_limit = 'Y' OR bucket = 'safety_refusal')),
hs0 AS {_first_sql("risky", C.SALTS["safety"], "SELECT " + _quota_sql("(SELECT count(*) FROM risky)", C.HOLDOUT_SAFETY, of="(SELECT count(*) FROM inc)"))},
r0 AS (SELECT stable_id, bucket FROM inc WHERE stable_id NOT IN (SELECT stable_id FROM hg0) AND stable_id NOT IN (SELECT stable_id FROM hs0)),
hg AS {_first_sql("(SELECT * EXCLUDE (turn) FROM hg0)", C.SALTS["release_grounded"], f"SELECT (SELECT count(*) FROM hg0) - least((SELECT count(*) FROM hg0), greatest(0, {_LEAST} - (SELECT count(*) FROM r0)))")},
r1 AS (SELECT * FROM r0 UNION ALL SELECT stable_id, bucket FROM hg0 WHERE stable_id NOT IN (SELECT stable_id FROM hg)),
hs AS {_first_sql("(SELECT * EXCLUDE (turn) FROM hs0)", C.SALTS["release_safety"], f"SELECT (SELECT count(*) FROM hs0) - least((SELECT count(*) FROM hs0), greatest(0, {_LEAST} - (SELECT count(*) FROM r1)))")},
r2 AS (SELECT * FROM r1 UNION ALL SELECT stable_id, bucket FROM hs0 WHERE stable_id NOT IN (SELECT stable_id FROM hs)),
n AS (SELECT count(*) FILTER (WHERE bucket = 'grounded_generation') AS g, count(*) FILTER (WHERE bucket = 'safety_refusal') AS sf, count(*) FILTER (WHERE bucket = 'safe_recommendation') AS rc FROM r2),
t AS (SELECT g, sf, rc, least(sf, {_MIX("safety_refusal")}) AS s0, least(rc, {_MIX("safe_recommendation")}) AS c0 FROM n),
u AS (SELECT *, greatest(0, {_LEAST} - g - s0 - c0) AS room FROM t), v AS (SELECT *, least(sf - s0, room) AS more FROM u),
target AS (SELECT 'grounded_generation' AS bucket, g AS want FROM v UNION ALL SELECT 'safety_refusal', s0 + more FROM v UNION ALL SELECT 'safe_recommendation', c0 + least(rc - c0, room - more) FROM v),
pool AS (SELECT stable_id, bucket, want FROM (SELECT r2.*, want, row_number() OVER (PARTITION BY bucket ORDER BY sha256(CASE bucket WHEN 'safety_refusal' THEN '{C.SALTS["pool_safety"]}' ELSE '{C.SALTS["pool_recommendation"]}' END || '||' || stable_id), stable_id) AS turn FROM r2 JOIN target USING (bucket)) WHERE turn <= want),
cut AS (SELECT stable_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY sha256('valid::' || bucket || '||' || stable_id), stable_id) <= {_quota_sql("want", C.VALID, nearest=True)} AS valid FROM pool),
more AS {_first_sql("(SELECT * FROM cut WHERE NOT valid)", C.SALTS["topup"], f"SELECT CASE WHEN count(*) FILTER (WHERE valid) < {C.MIN_VALID} AND count(*) FILTER (WHERE NOT valid) > {C.MIN_TRAIN} THEN least({C.MIN_VALID} - count(*) FILTER (WHERE valid), count(*) FILTER (WHERE NOT valid) - {C.MIN_TRAIN}) ELSE 0 END FROM cut")}
SELECT source_dataset, source_row_index, bucket AS sft_bucket, CASE WHEN stable_id IN (SELECT stable_id FROM hs) THEN 'holdout_edge_safety' WHEN stable_id IN (SELECT stable_id FROM hg) THEN 'holdout_grounded_generation'
  WHEN stable_id IN (SELECT stable_id FROM more) OR stable_id IN (SELECT stable_id FROM cut WHERE valid) THEN 'valid' WHEN stable_id IN (SELECT stable_id FROM cut) THEN 'train' ELSE 'excluded' END AS split FROM bkt"""


@query(_SELECTION)
def final_selection(s, d):
    return curate.selection(curate.classified(_candidates(s, d))).select("source_dataset", "source_row_index", "sft_bucket", "split")


# A release with planted breaches: training answers of every 29th source row are changed, every 41st valid record is missing,
# and the summary declares one holdout row and one bucket row too many.
_BREACH = f"""{_SELECTION.replace("SELECT source_dataset, source_row_index, bucket AS sft_bucket, CASE WHEN", ", sel AS (SELECT source_row_index, trim(question) AS question, trim(answer) AS answer, bucket AS sft_bucket, CASE WHEN")}),
rec AS (SELECT split, question, CASE WHEN split = 'train' AND source_row_index % 29 = 0 THEN answer || '!' ELSE answer END AS answer FROM sel WHERE split = 'train' OR (split = 'valid' AND source_row_index % 41 <> 0)),
declared AS (SELECT split, count(*) + CASE WHEN split = 'holdout_edge_safety' THEN 1 ELSE 0 END AS n FROM sel WHERE split <> 'excluded' GROUP BY 1),
w(kind, split) AS (VALUES ('records', 'train'), ('records', 'valid'), ('candidates', 'train'), ('candidates', 'valid'), ('holdout', 'holdout_grounded_generation'), ('holdout', 'holdout_edge_safety')),
c AS (SELECT split || '_' || kind AS check_name, coalesce((SELECT n FROM declared WHERE declared.split = w.split), 0) AS expected, CASE WHEN kind = 'records' THEN (SELECT count(*) FROM rec WHERE rec.split = w.split) ELSE (SELECT count(*) FROM sel WHERE sel.split = w.split) END AS actual FROM w),
d AS (SELECT split, question, answer FROM (SELECT split, question, answer, 1 AS x FROM rec UNION ALL SELECT split, question, answer, -1 FROM sel WHERE split IN ('train', 'valid')) GROUP BY ALL HAVING sum(x) <> 0),
b AS (SELECT 'train' AS split, count(DISTINCT sft_bucket) AS n FROM sel WHERE split = 'train' AND sft_bucket = 'safety_refusal')
SELECT check_name, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, expected = actual AS passed FROM (SELECT * FROM c UNION ALL SELECT s || '_content', 0, (SELECT count(*) FROM d WHERE split = s) FROM (VALUES ('train'), ('valid')) AS t(s) UNION ALL SELECT 'train_buckets', 0, (SELECT n FROM b) UNION ALL SELECT 'valid_buckets', 0, 0)"""


@query(_BREACH)
def split_contract(s, d):
    """The release of all candidates against a summary, with planted breaches."""
    chosen = curate.selection(curate.classified(_candidates(s, d))).select("source_row_index", "question", "answer", "sft_bucket", "split")
    row = c("source_row_index")
    records = chosen.where("split = 'train' or split = 'valid'").where((c("split") == "train") | (row % 41 != 0)).select("split", "question", F.when((c("split") == "train") & (row % 29 == 0), F.concat("answer", F.lit("!"))).otherwise(c("answer")).alias("answer"))
    summary = chosen.where("split <> 'excluded'").groupBy("split").agg(F.count("*").alias("n")).select(F.concat("split", F.lit("_rows")).alias("name"), (c("n") + F.when(c("split") == "holdout_edge_safety", 1).otherwise(0)).alias("rows"))
    buckets = chosen.groupBy("split", "sft_bucket").agg(F.count("*").alias("n")).where("split in ('train', 'valid')").select("split", "sft_bucket", (c("n") + F.when((c("split") == "train") & (c("sft_bucket") == "safety_refusal"), 1).otherwise(0)).alias("rows"))
    return audit.split_contract(records, chosen, chosen.where("split like 'holdout%'").select("split"), summary, buckets)


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'missing_key' WHEN conv_id % 7 = 0 THEN 'empty_instruction' WHEN trim(text) = '' OR turn % 3 = 2 THEN 'empty_output' WHEN conv_id % 11 = 1 THEN 'input_not_empty' END AS error FROM conversations
  WHERE turn % 5 = 4 OR conv_id % 7 = 0 OR trim(text) = '' OR turn % 3 = 2 OR conv_id % 11 = 1""")
def record_errors(s, d):
    """Training records made of all conversations, with missing keys, blanks and inputs planted."""
    records = T(s, d, "conversations").select("conv_id", "turn", F.when(c("conv_id") % 7 == 0, " ").otherwise(c("role")).alias("instruction"), F.when(c("conv_id") % 11 == 1, "x").otherwise("").alias("input"), F.when(c("turn") % 5 != 4, F.when(c("turn") % 3 == 2, "").otherwise(c("text"))).alias("output"))
    return gates.record_faults(records).select("conv_id", "turn", "error")


@query(f"""{_CAND} SELECT question AS instruction, '' AS input, trim(answer) AS output FROM (SELECT trim(question) AS question, answer, bucket FROM bkt) WHERE bucket <> 'excluded'""")
def training_records(s, d):
    return curate.training_records(curate.classified(_candidates(s, d)).where("include_in_sft"))


_GATED = f"""WITH dataset AS (SELECT count(*) AS train_rows, (SELECT count(*) FROM labels) AS valid_rows, count(*) FILTER (WHERE text IS NULL OR text = '') AS missing_contract_fields, (SELECT count(*) FROM conversations) AS holdout_edge_safety_rows FROM documents), edge AS ({ORACLES["edge_metrics"]}), eval AS ({ORACLES["eval_metrics"]})
""" + " UNION ALL ".join(f"SELECT '{s}' AS source, '{n}' AS check_name, coalesce({f'(SELECT {n} FROM {s})' if n != 'holdout_grounded_generation_rows' else 'NULL'}, 0) {op} {limit!r} AS passed" for n, s, op, limit in C.READINESS)


@query(_GATED)
def readiness_gate(s, d):
    """The checks over what the tables hold and the metrics of all predictions; a number that nobody gives counts as 0."""
    docs = T(s, d, "documents").agg(F.count("*").alias("train_rows"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("missing_contract_fields"))
    dataset = docs.join(T(s, d, "labels").agg(F.count("*").alias("valid_rows"))).join(T(s, d, "conversations").agg(F.count("*").alias("holdout_edge_safety_rows")))
    p = P(s, d)
    checks = gates.readiness(dataset, evaluate.edge_metrics(p), evaluate.eval_metrics(p.withColumn("expected_doc_id", c("expected_doc"))))
    return checks.select("source", c("check").alias("check_name"), "passed")


@query(f"""{PRED} SELECT count(*) AS actual_rows, count(DISTINCT source_row_index) AS distinct_rows, count(*) FILTER (WHERE trim(answer) = '') AS empty_answers, CAST(greatest(1000000 - count(DISTINCT source_row_index), 0) AS BIGINT) AS missing_rows, 'FAIL' AS verdict FROM pred""")
def completeness_gate(s, d):
    return gates.completeness(P(s, d), 1_000_000).select("actual_rows", "distinct_rows", "empty_answers", "missing_rows", "verdict")


@query("""WITH src AS (SELECT p_partkey AS source_row_index, p_name || CAST(p_partkey % 40 AS STRING) AS question FROM part),
  pr AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN -p_partkey WHEN p_partkey % 5 = 2 THEN p_partkey - 1 ELSE p_partkey END AS i, p_name || CAST(p_partkey % 40 AS STRING) AS question, p_partkey AS written FROM part),
  u AS (SELECT question, min(source_row_index) AS f FROM src GROUP BY question HAVING count(*) = 1), fl AS (SELECT coalesce(i, f) AS source_row_index, written FROM pr LEFT JOIN u USING (question))
  SELECT source_row_index, max(written) AS written FROM fl WHERE source_row_index IN (SELECT source_row_index FROM src) GROUP BY 1""")
def sanitize_outputs(s, d):
    """All parts: every third index missing, every seventh-and-one stale, every fifth-and-two its neighbour's."""
    key = c("p_partkey")
    rows = T(s, d, "part").select(key, F.concat("p_name", (key % 40).cast("string")).alias("question"))
    index = F.when(key % 3 == 0, None).when(key % 7 == 1, -key).when(key % 5 == 2, key - 1).otherwise(key)
    pred = rows.select(index.alias("source_row_index"), "question", key.alias("written"))
    return gates.sanitized(pred, rows.select(key.alias("source_row_index"), "question")).select("source_row_index", "written")


@query("""SELECT event_id, CASE WHEN rows >= 100 THEN 'COMPLETED' WHEN blocked OR (NOT alive AND NOT passed) THEN 'BLOCKED_BY_GATE' WHEN alive AND age > 10 THEN 'STALL_WARNING' WHEN alive AND slow > 25 THEN 'RUNNING_SLOW' WHEN alive THEN 'RUNNING_HEALTHY' WHEN age >= 20 THEN 'STALL_CONFIRMED' ELSE 'STALL_WARNING' END AS verdict
  FROM (SELECT event_id, event_id % 105 AS rows, event_id % 17 = 0 AS blocked, event_id % 3 = 0 AS alive, event_id % 4 <> 0 AS passed, event_id % 29 AS age, event_id % 40 AS slow FROM events)""")
def monitor_verdict(s, d):
    e = c("event_id")
    signals = T(s, d, "events").select("event_id", (e % 105).alias("rows"), F.lit(100).alias("target_rows"), (e % 17 == 0).alias("blocked_in_log"), (e % 3 == 0).alias("process_alive"), (e % 4 != 0).alias("benchmark_passed"), F.lit(5).alias("benchmark_age_min"), (e % 29).cast("double").alias("output_age_min"), F.lit(None).cast("double").alias("log_age_min"), F.lit(None).cast("double").alias("heartbeat_age_min"), (e % 40).alias("window_avg_sec"), F.lit(0).alias("window_p95_sec"))
    return signals.select("event_id", gates.monitor_verdict().alias("verdict"))


_G = {"a": "safety_disclosure_miss", "b": "grounded_doc_hit_rate", "v": "valid_answer_type_match_rate"}


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 'reject' WHEN b < 0.5 THEN CASE WHEN event_id % 2 = 0 THEN 'experiment_only' ELSE 'reject' END WHEN event_id % 2 = 0 AND b > 0.5 THEN 'next_baseline' ELSE 'experiment_only' END AS verdict FROM (SELECT event_id, (event_id % 10) / 10.0 AS b FROM events)""")
def run_verdict(s, d):
    e = c("event_id")
    same = ["must_not_recommend_pass_rate", "must_disclose_limit_pass_rate", "unsafe_recommendation"]
    cols = {f"{p}_{m}": F.lit(1.0) for p in ("safety", "base_safety") for m in same} | {f"{p}_{m}": F.lit(0.5) for p in ("grounded", "base_grounded") for m in ("doc_hit_rate", "field_hit_rate", "match_status_match_rate")}
    cols |= {"grounded_doc_hit_rate": (e % 10) / 10.0, "safety_disclosure_miss": F.when(e % 5 == 0, 1).otherwise(0), "valid_empty_answer_rate": F.lit(0.0), "valid_short_output_rate": F.lit(0.1)}
    cols |= {"valid_answer_type_match_rate": F.when(e % 2 == 0, 0.95).otherwise(0.94), "valid_match_status_match_rate": F.lit(1.0), "valid_must_not_include_pass_rate": F.lit(0.99)}
    return T(s, d, "events").select("event_id").withColumns(cols).select("event_id", gates.run_verdict(e % 7 != 0).alias("verdict"))


# Context and generation


_DOCS = "docs AS (SELECT 'D' || CAST(doc_id AS STRING) AS doc, text AS content FROM documents)"
_CITED = f"""{PRED}, {_DOCS}, k AS (SELECT source_row_index, list_filter(list_transform(string_split(cited_doc_ids, '|'), lambda x: trim(x)), lambda x: x <> '')[:2] AS ids FROM pred),
f AS (SELECT source_row_index, p AS pos, ids[p] AS doc, content FROM k, LATERAL (SELECT unnest(range(1, len(ids) + 1)) AS p) JOIN docs ON docs.doc = ids[p])"""


def _cited(s, d):
    rows = P(s, d)
    docs = T(s, d, "documents").select(F.concat(F.lit("D"), c("doc_id").cast("string")).alias("doc"), c("text").alias("content"))
    return rows, context.cited_documents(rows, docs, key="source_row_index", cited="cited_doc_ids", doc="doc")


@query(_CITED + " SELECT k.source_row_index, CAST(count(doc) AS INTEGER) AS n_docs, coalesce(string_agg(doc, ',' ORDER BY pos), '') AS docs FROM k LEFT JOIN f USING (source_row_index) GROUP BY 1")
def context_docs(s, d):
    return _cited(s, d)[1].select("source_row_index", "n_docs", F.coalesce(F.array_join(c("docs.doc"), ","), F.lit("")).alias("docs"))


_BARE = lambda x: f"nullif(CASE WHEN {x} IN ('nan', 'None', 'NULL', 'null') THEN '' ELSE {x} END, '')"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_Y = lambda x: f"trim({x}) = 'Y'"
_SAY = "nullif(concat_ws(chr(10), body, '데이터 기준: ' || dt, '답변 가능 범위: ' || sc), '')"


@query(f"""{_CITED}, one AS (SELECT source_row_index, arg_min(doc, pos) AS doc FROM f GROUP BY 1),
o AS (SELECT pred.*, k.ids, one.doc AS doc, {_BARE(_STRIP('documents.text'))} AS body, CASE WHEN doc_id % 4 <> 0 THEN '2023-09-05' END AS dt, CASE WHEN doc_id % 3 <> 0 THEN lang END AS sc FROM pred JOIN k USING (source_row_index) LEFT JOIN one USING (source_row_index) LEFT JOIN documents ON 'D' || CAST(doc_id AS STRING) = one.doc)
SELECT source_row_index, CASE WHEN doc IS NOT NULL AND query_type = 'GENERAL_RETRIEVAL_QA' AND {_SAY} IS NOT NULL THEN {_SAY} WHEN doc IS NOT NULL AND {_Y('must_not_recommend')} THEN concat_ws(chr(10), '{C.NO_RECOMMENDATION}', {_SAY}) WHEN doc IS NOT NULL AND body IS NOT NULL THEN {_SAY}
  WHEN {_Y('must_disclose_limit')} OR {_Y('must_not_recommend')} THEN concat_ws(chr(10), '{C.NO_CONTEXT_LIMITED[0]}', '{C.NO_CONTEXT_LIMITED[1]}', '{C.NO_CONTEXT_LIMITED[2]}' || coalesce(nullif(top_doc_id, ''), '{C.NONE_WORD}'), '{C.NO_CONTEXT_LIMITED[3]}' || coalesce(nullif(array_to_string(ids, '|'), ''), '{C.NONE_WORD}')) ELSE '{C.NO_CONTEXT}' END AS answer FROM o""")
def fallback_answers(s, d):
    """All predictions; documents have a date or a scope or neither."""
    rows, i = P(s, d), c("doc_id")
    docs = T(s, d, "documents").select(F.concat(F.lit("D"), i.cast("string")).alias("doc"), c("text").alias("description"), F.when(i % 4 != 0, "2023-09-05").alias("data_date"), F.when(i % 3 != 0, c("lang")).alias("scope"))
    found = context.cited_documents(rows, docs, key="source_row_index", cited="cited_doc_ids", doc="doc")
    first = F.get("docs", F.lit(0))
    said = context.fallback_answer(c("n_docs") > 0, first["description"], first["data_date"], first["scope"], c("query_type"), c("must_not_recommend"), c("must_disclose_limit"), c("top_doc_id"), c("cited_doc_ids"))
    return rows.join(found, "source_row_index").select("source_row_index", said.alias("answer"))


@query(f"""{PRED} SELECT source_row_index, concat_ws(' ', {_LIT0(C.INSTRUCTION[0])}, CASE WHEN {_Y('must_not_recommend')} THEN {_LIT0(C.INSTRUCTION[1])} END, CASE WHEN {_Y('must_disclose_limit')} THEN {_LIT0(C.INSTRUCTION[2])} END) AS instruction,
  concat_ws(chr(10), {", ".join(map(_LIT0, C.OUTPUT_RULES))}, CASE WHEN query_type = 'GENERAL_RETRIEVAL_QA' THEN {_LIT0(C.SUMMARY_RULE)} ELSE {_LIT0(C.CANDIDATE_RULE)} END, CASE WHEN {_Y('must_not_recommend')} THEN {_LIT0(C.LIMIT_RULES[0])} END, CASE WHEN {_Y('must_disclose_limit')} THEN {_LIT0(C.LIMIT_RULES[1])} END) AS rules FROM pred""")
def contextual_rules(s, d):
    flags = c("must_not_recommend"), c("must_disclose_limit")
    return P(s, d).select("source_row_index", context.instruction(*flags).alias("instruction"), context.output_rules(c("query_type"), *flags).alias("rules"))


@query()
def contextual_input(s, d):
    """Over all documents and whole texts; tests hold it against brute force."""
    rows, found = _cited(s, d)
    return context.contextual(rows.withColumn("sft_bucket", F.lit("x")), found, key="source_row_index", content="content").select("source_row_index", "input")


_NULL = lambda x: f"CASE WHEN trim({x}) NOT IN ('', 'nan', 'None', 'NULL', 'null') THEN trim({x}) END"
_N0, _N2 = lambda x: f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))", lambda x: f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"
_SUBJ = f"CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN concat_ws(' ', name, '전용 ' || {_N2('area')} || '㎡', '공급 ' || {_N2('supply_area')} || '㎡', '타입 ' || unit_type) ELSE name END"
_SAID = {
    "fact_area": f"name || '의 전용면적은 ' || {_N2('area')} || '㎡입니다.'", "supply_area": f"name || '의 공급면적은 ' || {_N2('supply_area')} || '㎡입니다.'",
    "households": f"name || '은 총 ' || {_N0('households')} || '세대 규모입니다.'", "structure": f"name || '의 구조 요약은 ' || {_NULL('structure')}", "area_band": "name || '은 ' || band || ' 면적대로 분류됩니다.'",
    "location": "name || '은 ' || sido || ' ' || sigungu || ' ' || dong || '에 위치합니다.'", "location_detail": f"name || '의 주소는 ' || {_NULL('address')} || '입니다.'",
    "station": f"CASE WHEN distance IS NULL THEN '가장 가까운 역은 ' || station || '입니다.' ELSE '가장 가까운 역은 ' || station || '이며 약 ' || {_N0('distance')} || 'm 거리입니다.' END",
    "transport_summary": "coalesce(transport_compare, line_summary)", "distance": f"'가장 가까운 역까지 거리는 약 ' || {_N0('distance')} || 'm입니다.'",
    "price": f"name || '의 공급액은 ' || {_N0('price')} || '만원입니다.'", "price_per_pyeong": f"'평당 공급액은 ' || {_N2('price_per_pyeong')} || '만원입니다.'",
    **{k: _NULL(k) for k in ("price_summary", "lifestyle", "medical", "commute", "builder", "policy", "description")},
}
_LIT = lambda x: "'" + x.replace("'", "''") + "'"
_ROWS = lambda rows: ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _LIT(v) for v in r) + ")" for r in rows)
_QA_SQL = (
    f"WITH {V.QA_LISTING}, s AS (SELECT *, {_SUBJ} AS subject FROM qa_listing), facts AS (SELECT (SELECT cutoff FROM listing WHERE cutoff IS NOT NULL ORDER BY doc_id LIMIT 1) AS cutoff, (SELECT sigungu FROM listing GROUP BY 1 ORDER BY count(*) DESC, sigungu LIMIT 1) AS region), a AS ("
    + " UNION ALL ".join(f"SELECT 0 AS pool, {i} AS ord, subject || '{q}' AS question, {_SAID[k]} AS answer, name, doc_id, '{kind}' AS category, 'apartment_fact_lookup' AS answer_type, 'EXACT_MATCH' AS expected_match_status, name AS must_include, '' AS must_not_include FROM s" for i, (kind, k, q) in enumerate(C.QA_TEMPLATES))
    + f" UNION ALL SELECT 1, i * 2 + n, term || CASE n WHEN 0 THEN '이 뭐야' ELSE ' 설명해줘' END, '일반 설명: ' || definition || chr(10) || '우리 데이터에서 대응 가능한 필드: ' || fields || chr(10) || '주의사항: ' || caution, 'GENERAL_KNOWLEDGE', 'KNOW_' || lpad(CAST(i + 1 AS VARCHAR), 3, '0'), 'knowledge_term', 'knowledge_answer', 'KNOWN', CASE n WHEN 0 THEN '일반 설명' ELSE term END, '' FROM (VALUES {_ROWS((i, *t) for i, t in enumerate(V.TERMS))}) AS k(i, term, definition, fields, caution), (VALUES (0), (1)) AS two(n)"
    + f" UNION ALL SELECT 2, i, replace(q, '{{region}}', region), replace(an, '{{cutoff}}', cutoff), nm, id, cat, kind, st, replace(inc, '{{cutoff}}', cutoff), exc FROM (VALUES {_ROWS((i, *r) for i, r in enumerate(C.QA_FIXED))}) AS f(i, q, an, nm, id, cat, kind, st, inc, exc), facts)"
    + " SELECT question, answer, name, doc_id, category, answer_type, answer_type AS expected_answer_type, expected_match_status, must_include, must_not_include FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY pool, doc_id, ord) AS n FROM a WHERE answer IS NOT NULL) WHERE n = 1"
)


@query(_QA_SQL)
def qa_templates(s, d):
    return generate.qa_dataset(V.qa_listing(s, d), V.knowledge(s))


def _edge_block(block, kind, levels, specs):
    tops = ", ".join(f"(SELECT {n}, row_number() OVER (ORDER BY count(*) DESC, {n}) - 1 AS r_{n} FROM listing GROUP BY 1 ORDER BY 2 LIMIT {most}) AS t_{n}" for n, most in levels)
    names = [n for n, _ in levels]
    for i, (pattern, where, by, greatest, field, router, hit, miss, tell) in enumerate(specs):
        asked = "printf('" + pattern + "', " + ", ".join(f"t_{n}.{n}" for n in names) + ")"
        held = f"FROM qa_listing AS q WHERE {' AND '.join(f'q.{n} = t_{n}.{n}' for n in names)} AND {where}"
        none = f"(SELECT count(*) {held}) = 0"
        refuse = "'N'" if router == "GENERAL_RETRIEVAL_QA" else f"CASE WHEN {none} THEN 'Y' ELSE 'N' END"
        best = f"coalesce((SELECT arg_min(doc_id, ({by} IS NULL, coalesce({'-' if greatest else ''}{by}, 0), doc_id)) {held}), '')"
        yield f"SELECT {list(C.EDGE_QUOTAS).index(kind)} AS kind, [{1 + block}, {', '.join(f'r_{n}' for n in names)}, {i}] AS ord, '{kind}' AS type, {asked} AS question, {best} AS expected_doc, '{field}' AS expected_field, '{router}' AS expected_router_type, CASE WHEN {none} THEN '{miss}' ELSE '{hit}' END AS expected_match_status, {refuse} AS must_not_recommend, CASE WHEN {none} THEN '{tell}' ELSE 'N' END AS must_disclose_limit FROM {tops}"


def _edge_fill(block, kind, levels, pattern, words, field, router, refuse):
    tops = [f"(SELECT {n}, row_number() OVER (ORDER BY count(*) DESC, {n}) - 1 AS r_{n} FROM listing GROUP BY 1 ORDER BY 2 LIMIT {most}) AS t_{n}" for n, most, _ in levels]
    tops += [f"(VALUES {_ROWS(enumerate(w))}) AS w{i}(i{i}, w{i})" for i, w in enumerate(words)]
    asked = ", ".join([f"t_{n}.{n}" for n, *_ in levels] + [f"w{i}.w{i}" for i in range(len(words))])
    order = ", ".join([f"r_{n}" for n, *_ in levels] + [f"i{i}" for i in range(len(words))])
    return f"SELECT {list(C.EDGE_QUOTAS).index(kind)}, [{100 + block}, {order}], '{kind}', printf('{pattern}', {asked}), '', '{field}', '{router}', 'UNKNOWN', '{refuse}', '{refuse}' FROM {', '.join(tops)}"


_EDGE_SQL = (
    f"WITH {V.QA_LISTING}, a AS MATERIALIZED (" + " UNION ALL ".join([x for i, block in enumerate(C.EDGE_BLOCKS) for x in _edge_block(i, *block)] + [_edge_fill(i, *block) for i, block in enumerate(C.EDGE_FILL)])
    + "".join(f" UNION ALL SELECT {list(C.EDGE_QUOTAS).index(kind)}, [{99 if at else 0}, {i}], '{kind}', '{q}', '', '{field}', '{router}', '{status}', 'Y', '{tell}'" for i, (kind, at, q, field, router, status, tell) in enumerate(C.EDGE_FIXED))
    + "), s0 AS (SELECT '' AS question WHERE false)"
    + "".join(
        f", d{i} AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ord) AS n FROM a WHERE kind = {i}) WHERE n = 1 AND question NOT IN (SELECT question FROM s{i}))"
        f", t{i} AS (SELECT * FROM d{i} WHERE question IN (SELECT question FROM a WHERE kind = {i} AND ord[1] < 100)), k{i} AS (SELECT * FROM t{i} ORDER BY ord LIMIT {most})"
        f", f{i} AS (SELECT * EXCLUDE (turn) FROM (SELECT *, row_number() OVER (ORDER BY ord) AS turn FROM d{i} WHERE question NOT IN (SELECT question FROM t{i})) WHERE turn <= {most} - (SELECT count(*) FROM t{i}))"
        f", s{i + 1} AS (SELECT question FROM s{i} UNION ALL SELECT question FROM t{i} UNION ALL SELECT question FROM f{i})"
        for i, most in enumerate(C.EDGE_QUOTAS.values())
    )
    + " SELECT type, question, expected_doc, expected_field, expected_router_type, expected_match_status, must_not_recommend, must_disclose_limit FROM (" + " UNION ALL ".join(f"SELECT * FROM k{i} UNION ALL SELECT * FROM f{i}" for i in range(len(C.EDGE_QUOTAS))) + ")"
)


@query(_EDGE_SQL)
def edge_questions(s, d):
    return generate.edge_questions(V.qa_listing(s, d))
