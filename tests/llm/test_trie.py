"""The prefix trie against prefixes counted one by one; places of handles, batches, long shared prefixes, odd rows."""

import binascii
import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from codonlake.llm import prefix_trie as P

CONV = "conv_id long, turn long, role string, text string, top string, path string, low long"


def brute_force(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = binascii.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r != q and r[: len(q)] == q for r in below)]
        ends = ",".join(str(c) for c in sorted(m) if seqs[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CONV)
    return sorted(map(tuple, P.nodes(df, **kw).collect()), key=repr)


def test_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", P.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in rows:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_shared_prefixes_in_batches(spark):
    rng = random.Random(5)
    rows = []
    for c in range(90):
        stem = [("user", f"w{i % 3} é ") for i in range(rng.choice([0, 3, 9, 17]))]
        rows += [(c, i, *t) for i, t in enumerate(stem + [(rng.choice("ab"), f"x {rng.randrange(2)}") for _ in range(rng.randrange(1, 5))])]
    want = brute_force(rows)
    for shares in ((1.0,), (0.1, 1.0), (0.2, 0.5, 1.0)):
        assert got(spark, rows, shares=shares) == want


def test_copies_over_blocks_of_ids(spark):
    rows = [(c, t, "u", "same words") for c in [3, 5, *range(20000, 20040), 9001, 10**12 + 1] for t in range(4)]
    assert got(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "u", "left out"), (1, None, None, None), (1, 2, "u", None), (2, 0, None, "a"), (7, 5, "", "x" * 50000), (40, 0, "u", "base"), (40, 1, "v", "base"), (41, 0, "q", "own"), (41, 9, "q", "own"), (59, 3, "q", "own"), (59, 4, "q", "own"), (59, 5, "q", "own"), (59, 6, "q", "own"), (1, 3, "u", "b"), (1, 4, "u", "b")]
    assert got(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")]])
def test_no_conversation(spark, rows):
    assert got(spark, rows) == []


def test_turnless_only(spark):
    """Base missing and fewer own turns than the rebuilt start takes."""
    c = next(c for c in range(1, 99) if c % 20 and binascii.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "u", "gone")]
    assert got(spark, rows) == brute_force(rows)


def test_locate_finds_what_a_walk_finds(spark):
    """Every path of a second set, also those that leave inside an edge."""
    turns = {"a": "aaaaaaaaaaaa", "b": "aaaaab", "c": "aaaaabcc", "d": "b"}
    more = {"e": "aaaaaaa", "f": "aaaaabd", "g": "bbb", "h": "c", "i": "aaaaaaaaaaaaaa", "j": "aaaaabccd"}

    def seqs(named):
        rows = [(k, [(ord(x), ord(x) * 7, 1) for x in v]) for k, v in named.items()]
        df = spark.createDataFrame(rows, "conv_id string, turns array<struct<a:long,b:long,w:long>>")
        ids = df.select(F.ascii("conv_id").cast("long").alias("conv_id"), "turns")
        return P.paths(ids).select("conv_id", F.element_at("path", -1).alias("end"), "m", "path", "words")

    trie = P.build(seqs(turns), (1.0,))
    found = {chr(r.conv_id): r.l for r in P.locate(trie, seqs(more), 14).collect()}
    lcp = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    want = {k: max(lcp(v, u) for u in turns.values()) for k, v in more.items()}
    assert found == want
