import json

from pyspark.sql import functions as F

from evidence_engine.operators import context, gates, retrieve
from evidence_engine.sources import files
from evidence_engine.streaming import runner


def test_csv_encodings(spark, tmp_path):
    text = "이름,값\n\"송파, 구\",1\n"
    for name in ("utf-8-sig", "cp949", "utf-8"):
        p = tmp_path / f"{name}.csv"
        p.write_bytes(text.encode(name))
        df, found = files.read_csv(spark, str(p))
        assert df.columns == ["이름", "값"] and df.first()[0] == "송파, 구" and found in (name, "utf-8-sig")


def test_jsonl(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"instruction": "a", "input": "", "output": "b"}\n\n{broken\n{"instruction": "", "input": "x", "output": "c"}\n')
    df = files.read_jsonl(spark, str(p))
    assert df.count() == 3 and df.where("malformed is not null").count() == 1
    errors = gates.record_errors(df.where("malformed is null").withColumn("ordinal", F.monotonically_increasing_id()))
    assert [r.error for r in errors.collect()] == ["empty_instruction"]
    files.write_jsonl(df.select("instruction", "input", "output").where("instruction = 'a'"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_documents_tables_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc", None)], "n int, t string, x double")
    assert files.markdown(df) == "| n | t | x |\n| --- | --- | --- |\n| 1 | a/b c |  |" and files.markdown(df.limit(0)).startswith("| 데이터 없음 |")
    files.write_document(df, str(tmp_path / "d" / "m.json"))
    assert json.loads((tmp_path / "d" / "m.json").read_text())["n"] == 1
    one = files.described(spark, [str(tmp_path / "d" / "m.json")]).first()
    assert one.sha256 == files.digest(str(tmp_path / "d" / "m.json"))


def test_stream_runs_once_and_resumes(spark, tmp_path):
    src, sink, check = (str(tmp_path / n) for n in ("src", "sink", "check"))
    score = lambda df: df.withColumn("answer", runner.mock_answer(F.col("question"), F.col("context")))
    spark.createDataFrame([(1, "q1", "c1\nc2"), (2, "q2", "")], "id long, question string, context string").write.parquet(src)
    runner.score_stream(spark, src, "id long, question string, context string", sink, check, score).awaitTermination()
    spark.createDataFrame([(2, "q2", "late"), (3, "q3", None)], "id long, question string, context string").write.mode("append").parquet(src)
    runner.score_stream(spark, src, "id long, question string, context string", sink, check, score).awaitTermination()
    got = {r.id: r.answer for r in runner.results(spark, sink, "id").collect()}
    assert got == {1: "q1 → c1", 2: "현재 데이터로는 판단할 수 없습니다.", 3: "현재 데이터로는 판단할 수 없습니다."}


def test_retrieval_pads_with_the_smallest_ids(spark):
    docs = spark.createDataFrame([(3, "alpha beta", "x"), (1, "gamma", "y"), (2, None, "z"), (4, "alpha", "alpha")], "d int, t string, b string")
    q = spark.createDataFrame([(1, "Alpha!"), (2, ""), (3, "nothing here")], "q int, t string")
    got = {(r.qid, r["rank"]): (r.doc, r.score) for r in retrieve.top_k(q, docs, 2, qid="q", question="t", doc="d", content="t", boosts={"b": 5.0}).collect()}
    assert got == {(1, 1): (3, 1.0), (1, 2): (4, 1.0), (2, 1): (1, 0.0), (2, 2): (2, 0.0), (3, 1): (1, 0.0), (3, 2): (2, 0.0)}


def test_context_keeps_citation_order_and_budget(spark):
    rows = spark.createDataFrame([(1, "b|a|zz", "q", "ans"), (2, "", "q", "ans"), (3, None, "w " * 50, "ans")], "k int, c string, question string, answer string")
    rows = rows.withColumns({"query_type": F.lit("Q"), "match_status": F.lit("M"), "sft_bucket": F.lit("B")})
    docs = spark.createDataFrame([("a", "text a"), ("b", "text b"), ("b", "other b")], "d string, body string")
    found = context.cited_documents(rows, docs, key="k", cited="c", doc="d")
    got = {r.k: r for r in context.contextual(rows, found, key="k", content="body", budget=20).collect()}
    assert got[1].n_docs == 2 and got[1].input == "q=Q;m=M;b=B\nd=b;s=other b\nd=a;s=text a" and got[1].status == "kept" and got[2].status == "no_context"
