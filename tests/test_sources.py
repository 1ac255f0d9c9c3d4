"""Files of unsure encoding and frozen inputs: strict to the last byte, with places."""

import hashlib
import os

import pytest

from evidence_engine.sources import frozen, unsure


def test_four_encodings_in_one_folder(spark, tmp_path):
    text = "이름,값\n\"가,나\n다\",1\n\n라,2\n"
    for name, enc in (("a.csv", "utf-8-sig"), ("b.csv", "cp949"), ("c.csv", "euc-kr"), ("d.csv", "utf-8")):
        (tmp_path / name).write_bytes(text.encode(enc))
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "_skip").write_bytes(b"\xff")
    rows = unsure.read_unsure(spark, str(tmp_path), "csv").collect()
    for name in "abcd":
        own = sorted((r for r in rows if r.file.endswith(f"{name}.csv")), key=lambda r: r.line)
        assert [(r.line, r.record) for r in own] == [(2, {"이름": "가,나\n다", "값": "1"}), (5, {"이름": "라", "값": "2"})]
    assert {os.path.basename(r.file): r.encoding for r in rows} == {"a.csv": "utf-8-sig", "b.csv": "cp949", "c.csv": "cp949", "d.csv": "utf-8-sig"}
    assert len(rows) == 8


def test_the_last_byte_counts(spark, tmp_path):
    good = ("가" * 700_000).encode()  # beyond a chunk
    (tmp_path / "x.txt").write_bytes(good)
    assert unsure.read_unsure(spark, f"{tmp_path}/x.txt").first().encoding == "utf-8-sig"
    (tmp_path / "x.txt").write_bytes(good + b"\xff")
    with pytest.raises(Exception, match="decodes .*x.txt"):
        unsure.read_unsure(spark, f"{tmp_path}/x.txt").collect()
    with pytest.raises(Exception, match="nowhere"):
        unsure.read_unsure(spark, f"{tmp_path}/nowhere").collect()


def test_malformed_json_lines_have_their_place(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "하나", "n": 1}\n\n{"q": \n{"q": "둘", "n": 2}\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_bytes('{"q": "셋", "n": 3}\nnone\n'.encode("cp949"))
    records, errors = unsure.read_json_lines(spark, str(tmp_path), "q string, n int")
    assert sorted((os.path.basename(r.file), r.line, r.q, r.n) for r in records.collect()) == [("a.jsonl", 1, "하나", 1), ("a.jsonl", 4, "둘", 2), ("b.jsonl", 1, "셋", 3)]
    assert sorted((os.path.basename(r.file), r.line, r.value) for r in errors.collect()) == [("a.jsonl", 3, '{"q": '), ("b.jsonl", 2, "none")]


def test_a_changed_byte_is_named(spark, tmp_path):
    data = bytes(range(256)) * 40
    for i in range(5):
        (tmp_path / f"f{i}.bin").write_bytes(data * (i + 1) if i else b"")
    tree = lambda: frozen.digest_tree(spark, [str(tmp_path)], 4096)
    before = spark.createDataFrame(tree().collect(), tree().schema)
    one = next(r for r in before.collect() if r.path.endswith("f2.bin"))
    assert list(one.chunks) == [hashlib.sha256((data * 3)[i : i + 4096]).hexdigest() for i in range(0, len(data) * 3, 4096)]
    frozen.require_frozen(before, tree())
    root = frozen.set_root(before)
    assert root == frozen.set_root(tree().repartition(3))
    changed = bytearray(data * 3)
    changed[9000] ^= 1
    (tmp_path / "f2.bin").write_bytes(changed)
    (tmp_path / "f4.bin").unlink()
    (tmp_path / "new.bin").write_bytes(b"x")
    got = {os.path.basename(r.path): (r.state, r.chunks) for r in frozen.changes(before, tree()).collect()}
    assert got == {"f2.bin": ("changed", [2]), "f4.bin": ("missing", None), "new.bin": ("added", None)}
    assert frozen.set_root(tree()) != root
    with pytest.raises(ValueError, match="f2.bin is changed in chunks 2"):
        frozen.require_frozen(before, tree())


def test_publish_takes_stale_results_away(spark, tmp_path):
    (tmp_path / "old.rejected").mkdir()
    target = f"{tmp_path}/result"
    frozen.publish(spark.range(3), target)
    frozen.publish(spark.range(5), target, ("old.rejected",))
    assert spark.read.parquet(target).count() == 5 and sorted(os.listdir(tmp_path)) == ["result"]
