"""The stages one after another on the small table, each held to what its operator decides."""

import sys

from pyspark.sql import functions as F

sys.path.insert(0, ".")
import corpus_pipeline as C  # noqa: E402
from evidence_engine.llm import jaccard, mixing, quality, winnow  # noqa: E402
from evidence_engine.llm import queries  # noqa: E402
from evidence_engine.llm.shared import settled  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]
    kept = settled(C.STAGES[0][1](spark, docs, sf), "t")
    assert kept.columns == docs.columns
    scored = quality.scored(docs, quality.trained(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.where("score >= 0.7").collect()}
    single = settled(C.STAGES[1][1](spark, kept, sf), "t")
    comp = {r.id: r.comp for r in jaccard.near_classes(kept)[0].collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(comp.values()))
    clean = settled(C.STAGES[2][1](spark, single, sf), "t")
    hit = winnow.decontaminate(single, spark.read.parquet(f"{sf}/benchmark.parquet"))[0].where("n_hit > 0")
    assert clean.count() == single.count() - hit.count()
    mix = settled(C.STAGES[3][1](spark, clean, sf), "t")
    assert mix.columns == docs.columns and mix.where("n_chars <> length(text)").isEmpty()
    ids = settled(C.STAGES[4][1](spark, mix, sf), "t")
    assert ids.count() == mix.count()
    total = ids.agg(F.sum("n_tokens")).first()[0]
    assert ids.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == total
    assert mixing.MOST == 3


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_run_against_the_plain_tokenizer(spark, sf):
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    got = C.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = settled(stage(spark, docs, sf), "t")
    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    upto = 0
    for r in sorted(got, key=lambda r: r.start):  # ascending ids, one document after the other
        assert r.start == upto
        upto += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)
