"""Contextual training records: cited documents looked up in order, compact inputs, and a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions.clean import clip, pipe_values, text
from .relational import keep_one


def cited_documents(rows: DataFrame, docs: DataFrame, *, key: str, cited: str, doc: str, most: int = 2) -> DataFrame:
    """(key, n_docs, docs): the first cited documents that exist, in citation order. Of repeated ids the first document counts."""
    asked = rows.select(key, F.posexplode(pipe_values(F.col(cited), most)).alias("pos", "doc"))
    cited_only = docs.join(asked.select(F.col("doc").alias(doc)).distinct(), doc, "left_semi")
    own = keep_one(cited_only, [doc], [c for c in docs.columns if c != doc] or [doc]).withColumnRenamed(doc, "doc")
    found = asked.join(own, "doc").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "doc", *[c for c in own.columns if c != "doc"]))).alias("docs"))
    return rows.select(key).join(found, key, "left").select(key, F.coalesce(F.size("docs"), F.lit(0)).alias("n_docs"), "docs")


def compact_input(query_type: Column, match_status: Column, bucket: Column, documents: Column) -> Column:
    """q=…;m=…;b=… and a line a document."""
    head = F.concat_ws(";", F.concat(F.lit("q="), text(query_type)), F.concat(F.lit("m="), text(match_status)), F.concat(F.lit("b="), text(bucket)))
    return F.concat_ws("\n", head, F.nullif(F.array_join(documents, "\n"), F.lit("")))


def document_line(doc: Column, content: Column, chars: int = 12) -> Column:
    return F.concat(F.lit("d="), doc.cast("string"), F.lit(";s="), clip(text(content), chars))


def count_words(c: Column) -> Column:
    """The default token count: words between white space."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != ""))


def contextual(rows: DataFrame, found: DataFrame, *, key: str, content: str, budget: int = 512, tokens=count_words, chars: int = 12) -> DataFrame:
    """Adds input, full_tokens and status: kept, no_context or over_budget."""
    lines = F.transform(F.coalesce("docs", F.expr("array()")), lambda d: document_line(d["doc"], d[content], chars))
    joined = rows.join(found, key).withColumn("input", compact_input(F.col("query_type"), F.col("match_status"), F.col("sft_bucket"), lines))
    full = tokens(F.concat_ws("\n", "question", "input", "answer"))
    status = F.when(F.col("n_docs") == 0, "no_context").when(F.col("full_tokens") > budget, "over_budget").otherwise("kept")
    return joined.withColumn("full_tokens", full).withColumn("status", status).drop("docs")


def accepted(summary: DataFrame) -> DataFrame:
    """One row: whether a view has rows and none of them is beyond the budget."""
    return summary.agg(((F.count_if(F.col("status") == "kept") > 0) & (F.count_if(F.col("status") == "over_budget") == 0)).alias("accepted"))


def instruction(must_not_recommend: Column, must_disclose: Column) -> Column:
    """The contextual instruction: what always holds, and what a row's two flags add."""
    base, no_recommendation, footer = map(F.lit, C.INSTRUCTION)
    return F.concat_ws(" ", base, F.when(text(must_not_recommend) == "Y", no_recommendation), F.when(text(must_disclose) == "Y", footer))


def output_rules(query_type: Column, must_not_recommend: Column, must_disclose: Column) -> Column:
    """The rules for an output, a line each, by the kind of question and the two flags."""
    shape = F.when(text(query_type) == "GENERAL_RETRIEVAL_QA", C.SUMMARY_RULE).otherwise(C.CANDIDATE_RULE)
    return F.concat_ws("\n", *map(F.lit, C.OUTPUT_RULES), shape, F.when(text(must_not_recommend) == "Y", C.LIMIT_RULES[0]), F.when(text(must_disclose) == "Y", C.LIMIT_RULES[1]))


def fallback_answer(found: Column, description: Column, data_date: Column, scope: Column, query_type: Column, must_not_recommend: Column, must_disclose: Column, top_doc: Column, cited: Column, most: int = 2) -> Column:
    """What is answered without a model: from the first cited document that exists, or that there is none. found: whether one does; the others are null then."""
    given = lambda c: F.nullif(text(c), F.lit(""))
    tail = (F.concat(F.lit("데이터 기준: "), given(data_date)), F.concat(F.lit("답변 가능 범위: "), given(scope)))
    told = F.nullif(F.concat_ws("\n", given(description), *tail), F.lit(""))
    refuse, limited = text(must_not_recommend) == "Y", text(must_disclose) == "Y"
    head, basis, top, ids = C.NO_CONTEXT_LIMITED
    without = F.concat_ws("\n", F.lit(head), F.lit(basis), F.concat(F.lit(top), F.coalesce(given(top_doc), F.lit(C.NONE_WORD))), F.concat(F.lit(ids), F.coalesce(F.nullif(F.array_join(pipe_values(cited, most), "|"), F.lit("")), F.lit(C.NONE_WORD))))
    return (
        F.when(found & (text(query_type) == "GENERAL_RETRIEVAL_QA") & told.isNotNull(), told)
        .when(found & refuse, F.concat_ws("\n", F.lit(C.NO_RECOMMENDATION), told))
        .when(found & given(description).isNotNull(), told)
        .when(limited | refuse, without).otherwise(C.NO_CONTEXT)
    )
