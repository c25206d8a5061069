"""Circulant signatures, and components against all pairs."""

import numpy as np
import pytest

from codonlake.llm import jaccard_join
from codonlake.llm import minhash_dedup as N

DOCS = "doc_id long, text string, key string, n long, class string"


def near(spark, docs, **kw):
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], DOCS)
    return sorted(map(tuple, N.near_components(df, **kw).collect()), key=repr)


def want(docs, n, num):
    """Rows of equal ids count as one document of the largest set; the tests give those only equal or smaller texts."""
    known = jaccard_join.brute_force([d for d in docs if d[0] is not None], n, num)
    size = lambda t: jaccard_join.brute_force([(0, t)], n, num)[0][0]
    out = []
    for d, t in docs:
        c = None if d is None else known[d][1]
        out.append((d, size(t), c, c == d))
    return sorted(out, key=repr)


def test_coordinates_estimate_similarity():
    """Two permutations give as many coordinates as independent ones would: mean and spread of the matches fit."""
    rng = np.random.default_rng(3)
    seen = []
    for _ in range(60):
        both, own = rng.integers(0, 2**63, 320).astype(np.uint64), rng.integers(0, 2**63, 80).astype(np.uint64)
        x, y = N.signatures([np.concatenate([both, own[:40]]), np.concatenate([both, own[40:]])])
        seen.append((x == y).mean())
    assert abs(np.mean(seen) - 0.8) < 0.015
    assert np.std(seen) < 1.5 * np.sqrt(0.16 / N.COORDINATES)


def test_shift_is_circular():
    x = np.array([0, 1, 2**32 - 1], np.uint32)
    room = np.empty_like(x)
    turned = N._permute((x + np.uint32(1)).astype(np.uint32), room)
    assert turned[2] == N._permute(np.array([0], np.uint32), np.empty(1, np.uint32))[0]
    assert len(np.unique(N._permute(np.arange(1 << 16, dtype=np.uint32), np.empty(1 << 16, np.uint32)))) == 1 << 16


def copies(rng, base, count, changes):
    out = []
    for _ in range(count):
        w = list(base)
        for i in rng.choice(len(w), changes, replace=False):
            w[i] = f"z{rng.integers(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "changes"), [(2, 9), (2, 5), (5, 3)])
def test_groups_of_copies(spark, n, changes):
    """Copies near and under the threshold of each other, of bases that aren't the smallest ids, with exact copies."""
    rng = np.random.default_rng(n + changes)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(130)]
        texts += copies(rng, base, 40, changes) + [" ".join(base)] * 2 + copies(rng, base, 30, 2 * changes)
    texts += [" ".join(f"q{rng.integers(10**6)}" for _ in range(50)) for _ in range(40)]
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    got = near(spark, docs, n=n)
    assert got == want(docs, n, 80)
    assert len({r[2] for r in got}) > 40


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    docs = [(5, "one"), (4, "ONE "), (3, None), (2, ""), (9, " \t\n"), (7, "a b"), (8, "A\x0bB"), (None, "a b"), (None, None), (1, long), (0, long + " tail"), (6, "a b a b"), (6, "a b a b"), (11, "é a"), (12, "É a")]
    assert near(spark, docs, n=2) == want(docs, 2, 80)
    assert near(spark, [], n=2) == []
    with pytest.raises(ValueError):
        near(spark, docs, num=50)
