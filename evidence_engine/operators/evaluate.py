"""Metrics over predictions: one aggregate pass each, rates guarded against empty denominators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions.clean import disclosed, normalize, text
from .order import quantiles


def rate(hit: Column, of: Column | None = None, empty: float = 0.0) -> Column:
    """Share of rows (or of those where ``of``) with hit; ``empty`` where there are none."""
    n = F.count("*") if of is None else F.count_if(of)
    return F.coalesce(F.try_divide(F.count_if(hit if of is None else hit & of).cast("double"), n), F.lit(empty))


def cites(ids: Column, wanted: Column) -> Column:
    return (wanted != "") & F.array_contains(F.split(ids, "[|]"), wanted)


def includes(answer: Column, wanted: Column) -> Column:
    return (wanted == "") | normalize(answer).contains(normalize(wanted))


def excludes(answer: Column, unwanted: Column) -> Column:
    return (unwanted == "") | ~normalize(answer).contains(normalize(unwanted))


def agrees(actual: Column, expected: Column, require_expected: bool = True) -> Column:
    """Equal texts; where nothing is expected that is no match, unless require_expected is off and both are blank."""
    return (actual == expected) & ((expected != "") if require_expected else F.lit(True))


def _texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: text(F.col(c)) for c in columns})


def eval_metrics(pred: DataFrame) -> DataFrame:
    p = _texts(pred, "answer", "expected_answer", "expected_doc_id", "cited_doc_ids", "expected_answer_type", "answer_type", "expected_match_status", "match_status", "must_include", "must_not_include")
    c = F.col
    return p.agg(
        F.count("*").alias("total_questions"),
        rate(cites(c("cited_doc_ids"), c("expected_doc_id"))).alias("retrieval_hit_rate"),
        rate(normalize(c("answer")) == normalize(c("expected_answer"))).alias("exact_match_rate"),
        rate((c("answer") != "") & (c("expected_answer") != "") & normalize(c("answer")).contains(normalize(c("expected_answer")))).alias("contains_expected_answer_rate"),
        rate(agrees(c("answer_type"), c("expected_answer_type"))).alias("answer_type_match_rate"),
        rate(agrees(c("match_status"), c("expected_match_status"))).alias("match_status_match_rate"),
        rate(includes(c("answer"), c("must_include"))).alias("must_include_pass_rate"),
        rate(excludes(c("answer"), c("must_not_include"))).alias("must_not_include_pass_rate"),
        rate(F.coalesce(c("insufficient_context"), F.lit(False))).alias("insufficient_context_rate"),
        F.coalesce(F.avg(F.coalesce(c("latency_ms").cast("double"), F.lit(0.0))), F.lit(0.0)).alias("avg_latency_ms"),
    )


def edge_metrics(pred: DataFrame, profile: str = "eval", require_expected: bool = True) -> DataFrame:
    p = _texts(pred, "answer", "expected_doc", "expected_field", "cited_doc_ids", "used_fields", "expected_router_type", "query_type", "expected_match_status", "match_status", "must_not_recommend", "must_disclose_limit", "top_doc_id")
    c = F.col
    return p.agg(
        F.count("*").alias("total_questions"),
        rate(cites(c("cited_doc_ids"), c("expected_doc"))).alias("doc_hit_rate"),
        rate(cites(c("used_fields"), c("expected_field"))).alias("field_hit_rate"),
        rate(agrees(c("query_type"), c("expected_router_type"), require_expected)).alias("router_match_rate"),
        rate(agrees(c("match_status"), c("expected_match_status"), require_expected)).alias("match_status_match_rate"),
        rate(c("top_doc_id") == "", c("must_not_recommend") == "Y", 1.0).alias("must_not_recommend_pass_rate"),
        rate(disclosed(c("answer"), profile), c("must_disclose_limit") == "Y", 1.0).alias("must_disclose_limit_pass_rate"),
        F.count_if((c("must_not_recommend") == "Y") & (c("top_doc_id") != "")).alias("unsafe_recommendation"),
        F.count_if((c("must_disclose_limit") == "Y") & ~disclosed(c("answer"), profile)).alias("disclosure_miss"),
        rate(F.coalesce(c("insufficient_context"), F.lit(False))).alias("insufficient_context_rate"),
        F.coalesce(F.avg(F.coalesce(c("latency_ms").cast("double"), F.lit(0.0))), F.lit(0.0)).alias("avg_latency_ms"),
    )


def valid_metrics(pred: DataFrame, short: int = 10) -> DataFrame:
    """The validation scope after training: matches, contents, and empty or very short outputs."""
    p = _texts(pred, "answer", "expected_answer_type", "answer_type", "expected_match_status", "match_status", "must_include", "must_not_include")
    c = F.col
    return p.agg(
        F.count("*").alias("rows"),
        rate(agrees(c("answer_type"), c("expected_answer_type"))).alias("answer_type_match_rate"), rate(agrees(c("match_status"), c("expected_match_status"), False)).alias("match_status_match_rate"),
        rate(includes(c("answer"), c("must_include"))).alias("must_include_pass_rate"), rate(excludes(c("answer"), c("must_not_include"))).alias("must_not_include_pass_rate"),
        rate(c("answer") == "").alias("empty_answer_rate"), rate(F.length("answer") < short).alias("short_output_rate"),
    )


def as_rows(metrics: DataFrame) -> DataFrame:
    """(metric, value) of a one-row frame's numbers."""
    names = metrics.columns
    return metrics.select(*(F.col(c).cast("double").alias(c) for c in names)).unpivot([], names, "metric", "value")


def router_family(question: Column, expected: Column, actual: Column) -> Column:
    any_of = lambda hints: reduce(Column.__or__, (question.contains(h) for h in hints))
    comparison = question.contains("비교") & any_of(C.BAND_ORDER)
    structured, comparative = "RECOMMEND_STRUCTURED", "RECOMMEND_COMPARATIVE"
    forth, back = (expected == comparative) & (actual == structured), (expected == structured) & (actual == comparative)
    return (
        F.when((expected == "") | (expected == actual), "")
        .when(forth & any_of(C.SUBJECTIVE), "subjective_quality_structured_instead_of_comparative")
        .when(forth & comparison, "area_band_comparative_structured_instead_of_comparative")
        .when(forth, "comparative_expected_but_structured_actual")
        .when(back & comparison, "area_band_structured_but_comparative_actual")
        .when(back, "structured_expected_but_comparative_actual")
        .when(actual == "GENERAL_RETRIEVAL_QA", "fell_through_to_grounded_generation")
        .otherwise(F.concat(F.lower(expected), F.lit("_to_"), F.lower(actual)))
    )




def failure_flags(pred: DataFrame) -> DataFrame:
    names = ("question", "answer_type", "match_status", "query_type", "expected_router_type", "expected_match_status", "must_not_recommend", "must_disclose_limit", "top_doc_id", "answer")
    p = pred.withColumns({n: text(F.col(n), weak=True) if n in pred.columns else F.lit("") for n in names})
    c = F.col
    told = disclosed(c("answer"), "failures")
    return p.withColumns({
        "is_legacy_schema": (c("answer_type") == "") | (c("match_status") == "") | (c("query_type") == ""),
        "router_mismatch": (c("expected_router_type") != "") & (c("query_type") != c("expected_router_type")),
        "match_status_mismatch": (c("expected_match_status") != "") & (c("match_status") != c("expected_match_status")),
        "unsafe_recommendation": (c("must_not_recommend") == "Y") & (c("top_doc_id") != ""),
        "disclosure_required": c("must_disclose_limit") == "Y",
        "has_limit_disclosure": told,
        "disclosure_miss": (c("must_disclose_limit") == "Y") & ~told,
        "area_band_unknown_candidate": reduce(Column.__or__, (c("question").contains(b) for b in C.BAND_ORDER)) & (c("expected_match_status") == "UNKNOWN"),
        "router_mismatch_family": router_family(c("question"), c("expected_router_type"), c("query_type")),
    })


def schema_buckets(flagged: DataFrame) -> DataFrame:
    """(bucket, rows): legacy rows, and each failure among all rows and among those of the current schema."""
    legacy = F.col("is_legacy_schema")
    counts = [F.count_if(legacy).alias("legacy_schema")]
    for f in ("unsafe_recommendation", "router_mismatch", "match_status_mismatch", "disclosure_miss", "area_band_unknown_candidate"):
        counts += [F.count_if(F.col(f)).alias(f), F.count_if(~legacy & F.col(f)).alias(f"{f}_current_schema")]
    made = flagged.agg(*counts)
    return made.unpivot([], made.columns, "bucket", "rows")


def hard_negatives(flagged: DataFrame) -> DataFrame:
    """Unsafe rows of the current schema, and what to do with each."""
    action = F.when(F.col("area_band_unknown_candidate"), "route_to_unknown_before_recommendation").otherwise("review_safety_rule")
    return flagged.where(~F.col("is_legacy_schema") & F.col("unsafe_recommendation")).withColumn("recommended_action", action)


def router_mismatches(flagged: DataFrame) -> DataFrame:
    """Rows of the current schema that went to another route than expected."""
    return flagged.where(~F.col("is_legacy_schema") & F.col("router_mismatch"))


def latency_stats(log: DataFrame, order: list[str], value: str, warmup: int = 2, worst: int = 1) -> DataFrame:
    """Raw and trimmed latencies (seconds): the first rows and the worst of the rest are left out of the trimmed ones.

    The two ranks meet on the few rows that they drop, so that no window runs over the whole log.
    """
    first = log.select(*order).orderBy(*order).limit(warmup)
    rest = log.join(F.broadcast(first), order, "left_anti") if warmup else log
    drop = rest.select(*order, value).orderBy(F.desc(value), *order).limit(worst)
    kept = rest.join(F.broadcast(drop.select(*order)), order, "left_anti") if worst else rest

    def stats(df, prefix):
        half, most = quantiles(df, value, [0.5, 0.95])
        one = df.agg(F.count("*").alias(f"{prefix}_rows"), F.avg(value).alias(f"{prefix}_avg"), F.try_divide(F.lit(3600.0), F.avg(value)).alias(f"{prefix}_rows_per_hour"))
        return one.withColumns({f"{prefix}_p50": F.lit(half).cast("double"), f"{prefix}_p95": F.lit(most).cast("double")})

    return stats(log, "raw").join(stats(kept, "trimmed"))


def tail_window(log: DataFrame, order: list[str], value: str, rows: int) -> DataFrame:
    """Mean and 95th percentile of the last rows: each task keeps its last ``rows``."""
    last = log.orderBy(*(F.desc(o) for o in order)).limit(rows)
    return last.agg(F.count("*").alias("rows"), F.avg(value).alias("window_avg"), F.percentile(value, 0.95).alias("window_p95"))


def token_stats(df: DataFrame, content: str, budget: int) -> DataFrame:
    n = F.size(F.filter(F.split(F.coalesce(content, F.lit("")), r"(?U)\s+"), lambda t: t != ""))
    return df.select(n.alias("n")).agg(F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.avg("n").alias("avg_tokens"), F.count_if(F.col("n") > budget).alias("over_budget"))


def joined_deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    a = as_rows(current).withColumnRenamed("value", "now")
    return a.join(as_rows(baseline).withColumnRenamed("value", "base"), "metric").withColumn("delta", F.col("now") - F.col("base"))


def trailing(df: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Adds trailing_avg, the mean of the last n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("trailing_avg", F.avg(value).over(w))
