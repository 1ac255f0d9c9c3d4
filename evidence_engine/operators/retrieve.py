"""Lexical retrieval: the k best documents by token overlap with boosts, zero-score padding and the answers built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions.clean import format_number, text
from . import impact


def top_k(questions: DataFrame, docs: DataFrame, k: int = 3, *, qid: str, doc: str, question: str, content: str, boosts: dict[str, float] | None = None) -> DataFrame:
    """(qid, rank, doc, score): exactly k documents a question, filled up with the smallest ids at score 0. A written table."""
    index = impact.build(docs, doc, content, boosts)
    found = impact.search(index, questions, k, qid=qid, question=question)
    # Among the k smallest ids and a question's k best there are always k to choose from.
    least = docs.select(F.col(doc).alias("doc")).distinct().orderBy("doc").limit(k).agg(F.collect_list("doc").alias("fill"))
    padded = questions.select(F.col(qid).alias("qid")).join(F.broadcast(least)).select("qid", F.explode("fill").alias("doc"), F.lit(0.0).alias("score"))
    both = found.select("qid", "doc", "score").unionByName(padded).groupBy("qid", "doc").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))
    out = index.scratch.settled(both.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", "doc", "score"))
    index.scratch.clear(out)
    return out


def gated(ranked: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(qid, top_score, answer_type): fallback where the best score is below the threshold."""
    best = ranked.groupBy("qid").agg(F.max("score").alias("top_score"))
    return best.withColumn("answer_type", F.when(F.col("top_score") < threshold, "fallback_answer").otherwise("grounded_generation"))


def detail(row: dict[str, Column]) -> Column:
    """A listing's line of an answer: its description, or what is known of where it is."""
    station = F.nullif(text(row["station"]), F.lit(""))
    where = F.concat_ws(", ", *(F.nullif(text(row[c]), F.lit("")) for c in ("sigungu", "dong")), F.concat_ws(" ", station, F.when(station.isNotNull(), F.concat(format_number(row["distance"]), F.lit("m")))))
    summary = F.coalesce(F.nullif(text(row["description"]), F.lit("")), F.nullif(where, F.lit("")))
    name = F.coalesce(F.nullif(text(row["name"]), F.lit("")), F.lit("단지명 미상"))
    return F.concat(F.lit("- "), F.concat_ws(": ", name, summary))


def grounded_answers(ranked: DataFrame, lines: DataFrame) -> DataFrame:
    """(qid, answer) from ranked documents and (doc, line)."""
    joined = ranked.where("rank <= 3").join(lines, "doc").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("top"))
    return joined.select("qid", F.concat_ws("\n", F.lit("질문과 관련된 단지 정보입니다."), F.array_join(F.col("top.line"), "\n"), F.lit("데이터 기준은 저장된 아파트 문서 요약입니다.")).alias("answer"))


def context_blocks(ranked: DataFrame, docs: DataFrame, doc: str, content: str) -> DataFrame:
    """(qid, context): the documents of each question in rank order, each under its id."""
    line = docs.select(F.col(doc).alias("doc"), F.concat(F.lit("["), F.col(doc).cast("string"), F.lit("] "), F.coalesce(content, F.lit(""))).alias("line"))
    joined = ranked.join(line, "doc").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("top"))
    return joined.select("qid", F.array_join(F.col("top.line"), "\n").alias("context"))


def without_labels(answer: Column) -> Column:
    """Generated text without a leading answer label and what follows a citation."""
    bare = F.regexp_replace(answer, r"(?U)^\s*(답변|answer)\s*[:：]\s*", "")
    return F.regexp_replace(F.get(F.split(bare, "근거 문서"), 0), r"(?U)^\s+|\s+$", "")


FALLBACK = C.FALLBACK
