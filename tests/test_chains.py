"""The chain kernel against an exhaustive search under all its conditions, cut into fragments, packed, and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from codonlake.operators.chains import COLUMNS, FORBIDDEN, INTRONS, UNSPLICED, ChainState, Rule, chain_stream, linked, traced

RULES = [
    Rule(frozenset({"First+", "Internal+"}), frozenset({"Internal+", "Terminal+"}), 4, 300, True),
    Rule(frozenset({"Terminal-", "Internal-"}), frozenset({"Internal-", "First-"}), 4, 120),
    Rule(frozenset({"First+", "Internal+", "Intron+"}), frozenset({"Intron+"}), 2, 40),
    Rule(frozenset({"Intron+"}), frozenset({"Internal+", "Terminal+"}), 2, 40),
    Rule(frozenset({"Terminal+", "Single+", "First-", "Single-"}), frozenset({"First+", "Terminal-", "Single+", "Single-"}), 10),
    Rule(frozenset({"Begin+"}), frozenset({"First+", "Internal+", "Terminal-"}), 5, None, True),
]
MINOR = (6.0, 30.0)
NAMES = list(COLUMNS)


def made(n, seed, span=4000):
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = rng.choice(["First", "Internal", "Internal", "Internal", "Terminal", "Single", "Intron", "Other"]) + rng.choice("++-")
        left = rng.randrange(span)
        right = left - 1 if kind.startswith("Internal") and rng.random() < 0.1 else left + rng.randrange(0, 60)
        need = rng.randrange(3) if rng.random() < 0.5 else 0
        give = need if kind.startswith("Intron") else rng.randrange(3) if rng.random() < 0.5 else 0
        rows.append((left, right, kind, float(rng.randrange(-15, 40)), need, give, rng.choice([None, None, None, "g", "h"]), int(rng.random() < 0.1), int(rng.random() < 0.15), int(rng.random() < 0.15), float(rng.randrange(8)), float(rng.randrange(8)), rng.randrange(3), rng.randrange(4)))
    rows += [(0, 0, "Begin+", 50.0, 0, 0, None, 0, 0, 0, 0.0, 0.0, 0, 0)]
    rows.sort(key=lambda r: r[0] + r[7])
    return rows


def exhaustive(rows):
    """For each element and rule the best of all earlier ones that its distances allow; of equal ones that which ends first."""
    now = [dict(zip(NAMES, r, strict=True)) for r in rows]
    totals, befores, best = [], [], None
    for i, e in enumerate(now):
        e["total"], before, kind = e["score"], None, e["kind"][:-1]
        if not any(e["kind"] in r.up | r.down for r in RULES):
            totals.append(None)
            befores.append(None)
            e["total"] = 0
            continue
        need, here = e["need"], e["left"] + e["evidence"]
        for r in RULES:
            if e["kind"] not in r.down:
                continue
            fits = [j for j in range(i) if now[j]["kind"] in r.up and now[j]["total"] > 0 and now[j]["give"] == need and now[j]["rclass"] == e["lclass"] and r.least <= here - now[j]["right"] - now[j]["evidence"] <= (r.most if r.most is not None else 10**9)]
            if not fits:
                continue
            j = max(fits, key=lambda j: (now[j]["total"], -now[j]["right"] - now[j]["evidence"], -j))
            p = now[j]
            if p["total"] + e["score"] <= e["total"] or (r.block and p["grp"] != e["grp"]):
                continue
            if e["lclass"] and kind not in UNSPLICED and not (e["evidence"] or p["evidence"] or (p["rscore"] + e["lscore"] > MINOR[0] and p["score"] + e["score"] > MINOR[1])):
                continue
            if kind in INTRONS or e["right"] == e["left"] - 1:
                e["lvalue"], e["rvalue"] = p["lvalue"], p["rvalue"]
                if kind not in INTRONS:
                    e["need"], e["give"] = p["need"], p["give"]
            elif ((p["rvalue"], e["lvalue"]) if e["kind"][-1] == "+" else (e["rvalue"], p["lvalue"])) in FORBIDDEN:
                continue
            e["total"], before = p["total"] + e["score"], j
        totals.append(e["total"])
        befores.append(before)
        if (best is None or e["total"] > totals[best]) and e["total"] > 0 and not (kind in INTRONS and before is None):
            best = i
    return totals, befores, best


def fed(rows, pieces, pack=True):
    state, out = ChainState(RULES, MINOR), ([], [])
    size = -(-len(rows) // pieces)
    for a in range(0, len(rows), size):
        part = rows[a : a + size]
        got = state.feed({c: [r[k] for r in part] for k, c in enumerate(NAMES)})
        for x, y in zip(out, got, strict=True):
            x += y
        state.evict()
        if pack:
            state = ChainState.unpack(state.pack(), RULES, MINOR)
    return (*out, state)


@pytest.mark.parametrize("seed", range(12))
def test_equals_exhaustive_search(seed):
    rows = made(300, seed, 1200 if seed % 2 else 4000)
    want = exhaustive(rows)
    for pieces in (1, 3, 50):
        total, before, state = fed(rows, pieces)
        assert (total, before) == want[:2]
        assert (state.best[1] if state.best else None) == want[2]
    joined = [i for i, b in enumerate(want[1]) if b is not None]
    assert len(joined) > 60


def test_state_is_bounded():
    """Elements beyond the largest distance leave; without a distance one element stays for each cell."""
    for n in (2000, 20000):
        *_, state = fed(made(n, 1, 20 * n), 40)
        assert state.held() < 250


def test_late_element_is_an_error():
    state = ChainState(RULES)
    with pytest.raises(ValueError, match="comes after"):
        state.feed({c: [r[k] for r in ((10, 12, "First+", 1.0, *COLUMNS.values())[:14], (3, 4, "First+", 1.0, *COLUMNS.values())[:14])] if k < 4 else [COLUMNS[c]] * 2 for k, c in enumerate(NAMES)})


SCHEMA = "locus string, ord long, left long, right long, kind string, score double, need int, give int, grp string, evidence int, lclass int, rclass int, lscore double, rscore double, lvalue int, rvalue int"


def test_linked_and_traced(spark):
    """Several loci in small batches: links, and the one best chain of each."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        loci = {f"l{k}": made(250, 100 + k) for k in range(5)} | {"none": [r for r in made(5, 3) if r[3] < 0 and r[2] != "Begin+"]}
        df = spark.createDataFrame([(k, i, *r) for k, rows in loci.items() for i, r in enumerate(rows)], SCHEMA)
        out = linked(df, "locus", ["ord"], RULES, MINOR).cache()
        got = {(r.locus, r.ord): (r.chain_score, r.before) for r in out.collect()}
        path = sorted((r.locus, r.nth) for r in traced(out, "locus").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k, rows in loci.items():
        total, before, at = exhaustive(rows)
        assert [got[k, i] for i in range(len(rows))] == list(zip(total, before, strict=True))
        while at is not None:
            want.append((k, at))
            at = before[at]
    assert path == sorted(want)


def test_stream_of_fragments(spark, tmp_path):
    """Each file is the next fragment of its loci; the chains are those of whole loci."""
    loci = {f"l{k}": made(240, 50 + k) for k in range(3)}
    rows = [(k, i, *r) for k, x in loci.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    for part in range(6):
        df.where(f"ord >= {part * 41} and ord < {(part + 1) * 41}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = chain_stream(stream, "locus", RULES, MINOR).writeStream.format("memory").queryName("chains").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.locus, r.ord): (r.chain_score, r.before) for r in spark.table("chains").withColumn("before", F.col("before").cast("long")).collect()}
    for k, x in loci.items():
        total, before, _ = exhaustive(x)
        fix = lambda v: None if v is None or v != v else v
        assert [tuple(map(fix, got[k, i])) for i in range(len(x))] == list(zip(total, before, strict=True))
