"""M-trees beyond what 64-bit sums hold: exact or refused."""

import numpy as np
import pytest

from evidence_engine.llm import mtree


def test_sums_beyond_64_bits_are_exact():
    v = np.array([(2**31, 2), (2**31, 1), (2**32, 1), (5, 5)], np.int64)
    tree = mtree.MTree(np.arange(4), v)
    assert tree.top(np.array([2**31, 3], np.int64), 4) == [(2**63 + 3, 2), (2**62 + 6, 0), (2**62 + 3, 1), (5 * 2**31 + 15, 3)]


@pytest.mark.parametrize("scale", [1, 2**20, 2**30, 2**40])
def test_against_brute_force_at_all_scales(scale):
    rng = np.random.default_rng(scale % 97)
    v = rng.integers(-9, 10, (900, 6)) * scale + rng.integers(0, 2, (900, 6))
    tree = mtree.MTree(np.arange(900), v)
    for i in range(0, 900, 90):
        want = sorted(((sum(int(a) * int(b) for a, b in zip(v[i], v[j])), j) for j in range(900) if j != i), key=lambda t: (-t[0], t[1]))[:5]
        assert tree.top(v[i], 5, but=i) == want


def test_beyond_a_long_is_refused(spark, tmp_path):
    def run(rows):
        path = f"{tmp_path}/{len(rows)}-{abs(hash(str(rows)))}"
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
        return {(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.op6(spark, path).collect()}

    big = float(2**22)  # 2^30 after the scale
    assert run([(0, [big, 1.0]), (1, [big, 2.0]), (2, [1.0, 1.0])]) == {(0, 1, 1, 2**60 + 2**17), (0, 2, 2, 2**38 + 2**16)}
    with pytest.raises(Exception, match="beyond 64 bits"):
        run([(0, [2.0**24, 1.0]), (1, [2.0**24, 2.0])])
    with pytest.raises(Exception, match="beyond 64 bits"):
        run([(0, [2.0**60, 1.0]), (1, [1.0, 2.0])])
