"""The manifest against a tree built level by level, the log's places, proofs and odd rows."""

import binascii
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from codonlake.llm import merkle_manifest as M

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, root string"


def hx(s):
    return sha256(s.encode()).hexdigest()


def leaf_of(row, extra=0):
    d, s, lang, n, t = row
    n = None if n is None else n + extra
    return hx("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, lang, n, t)))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([hx("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def brute_force(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: b"" if x is None else b"=" + x.encode())
    built = {}
    for lang in order:
        own = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[lang] = (own, levels([leaf_of(r) for r in own]))
    top = levels([built[x][1][-1][0] for x in order])
    root, out = top[-1][0], []
    for k, lang in enumerate(order):
        own, tree = built[lang]
        for i, r in enumerate(own):
            forge = r[0] is not None and r[3] is not None and binascii.crc32(str(r[0]).encode()) % 7 == 0
            now, proof = leaf_of(r, int(forge)), []
            for parts, at in ((tree, i), (top, k)):
                for level in parts[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    now = hx(other + now if at & 1 else now + other)
                    proof.append(other)
                    at >>= 1
            out.append((r[0], leaf_of(r), tree[-1][0], root, hx("".join(proof)), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 5, 7, 8, 11, 16, 23, 64, 65, 100])
def test_places_follow_from_sizes(leaves):
    hashes = [hx(str(i)) for i in range(leaves)]
    log = M.append([h.encode() for h in hashes], M.height_of(leaves))
    tree = levels(hashes)
    assert len(log) == M.WIDE * sum(map(len, tree))
    for level, nodes in enumerate(tree):
        for i, h in enumerate(nodes):
            p = M.WIDE * M.position(level, i, leaves)
            assert log[p : p + M.WIDE].decode() == h


def rows_of(n, langs):
    out = [(i * 3 % 101, "s" if i % 4 else None, langs[i % len(langs)], None if i % 9 == 0 else 10 * i, f"tëxt {i}" if i % 5 else None) for i in range(n)]
    return [*out, (None, None, None, None, None), (None, None, None, None, None), (7, "a", "en", 1, ""), (7, "a", "en", 1, ""), (7, "b", "en", 2, "x" * 70000)]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_equals_brute_force(spark, height):
    rows = rows_of(75, ["en", "de", "en", "en", None, "", "zz"])
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    got = sorted(map(tuple, M.prove(docs, height).collect()), key=repr)
    assert got == brute_force(rows)
    assert {r[6] for r in got} == {True, False}


def test_one_row_and_none(spark):
    one = [(3, "s", None, 4, "t")]
    assert list(map(tuple, M.prove(spark.createDataFrame([(*one[0], "", "", "")], DOCS)).collect())) == brute_force(one)
    assert M.prove(spark.createDataFrame([], DOCS)).collect() == []


def test_log_of_blocks(spark):
    """Blocks written apart make one log: complete blocks have as many nodes each."""
    leaves = [hx(str(i)) for i in range(21)]
    df = spark.createDataFrame([("t", h, i) for i, h in enumerate(leaves)], "tree string, leaf string, ord long")
    made = M.manifest(df, ["ord"], ["ord"], 2)
    log = {r.position: r.digest for r in made.log().collect()}
    assert [log[7 * b + M.position(0, i, 4)] for b in range(5) for i in range(4)] == leaves[:20]
    assert made.roots().select(F.col("root")).first().root == levels(leaves)[-1][0]
