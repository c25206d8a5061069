"""The chain engine under all its conditions, over orders as elements of the nations' loci.

SQL walks each locus element by element with lists; the engine streams them through one state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.operators.chains import INTRONS, Rule, linked, traced
from codonlake.sources.scratch import kept

#: Which kind may follow which: least and largest distance in tenths of a day, and whether groups must be equal.
RULES = [
    Rule(frozenset({"First+", "Internal+"}), frozenset({"Internal+", "Terminal+"}), 4, 900, True),
    Rule(frozenset({"Terminal-", "Internal-"}), frozenset({"Internal-", "First-"}), 4, 500),
    Rule(frozenset({"First+", "Internal+", "Intron+"}), frozenset({"Intron+"}), 2, 700),
    Rule(frozenset({"Intron+"}), frozenset({"Internal+", "Terminal+"}), 2, 700),
    Rule(frozenset({"Terminal+", "Single+", "First-", "Single-"}), frozenset({"First+", "Terminal-", "Single+", "Single-"}), 10),
]
MINOR = (6.0, 60.0)
#: Kinds by order number modulo 11; no rule names the last.
KINDS = ("Single", "First", "First", "Internal", "Internal", "Internal", "Internal", "Terminal", "Terminal", "Intron", "Other")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("locus"))
    k = F.col("ord")
    step = lambda a, b: F.expr(f"cast(ord div {a} % {b} as int)")
    e = o.join(c, "o_custkey").select("locus", F.col("o_orderkey").alias("ord"), (F.unix_date(F.col("o_orderdate").cast("date")) * 10 + F.col("o_orderkey") % 10).cast("long").alias("left"))
    e = e.withColumn("type", F.get(F.array(*[F.lit(x) for x in KINDS]), (k % 11).cast("int")))
    e = e.withColumn("kind", F.concat("type", F.when(k % 5 < 3, "+").otherwise("-")))
    right = F.when((F.col("type") == "Internal") & (step(11, 9) == 0), F.col("left") - 1).otherwise(F.col("left") + k % 37)
    need = step(3, 3)
    return e.withColumn("right", right).withColumns({
        "score": (k % 101 - 20).cast("double"), "need": need, "give": F.when(F.col("type") == "Intron", need).otherwise(step(7, 3)), "grp": F.when(k % 13 == 0, F.concat(F.lit("g"), (k % 2).cast("string"))), "evidence": (k % 17 == 0).cast("int"),
        "lclass": (step(11, 23) == 0).cast("int"), "rclass": (step(5, 23) == 0).cast("int"), "lscore": (k % 7).cast("double"), "rscore": (k % 8).cast("double"), "lvalue": step(4, 3), "rvalue": step(6, 4),
    }).drop("type")


def chain_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chain that ends at each element of a nation's orders, what comes before it, and whether the nation's best chain holds it."""
    rows = kept(linked(elements(spark, sf_dir), "locus", ["ord"], RULES, MINOR), "linked")
    prev = rows.select("locus", F.col("nth").alias("before"), F.col("ord").alias("before_ord"))
    best = traced(rows, "locus").select("locus", "nth", F.lit(True).alias("best"))
    out = rows.where("chain_score is not null").join(prev, ["locus", "before"], "left").join(best, ["locus", "nth"], "left")
    return out.select("locus", "ord", F.col("chain_score").cast("long").alias("chain_score"), "before_ord", F.coalesce("best", F.lit(False)).alias("on_best"))


def _list(kinds) -> str:
    return "[" + ", ".join(f"'{k}'" for k in sorted(kinds)) + "]"


_RULES = ", ".join(f"{{'c': {c}, 'up': {_list(r.up)}, 'down': {_list(r.down)}, 'least': {r.least}, 'most': {r.most if r.most is not None else 10**12}, 'block': {str(r.block).lower()}}}" for c, r in enumerate(RULES))
_KINDS = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_INTRON = "(" + ", ".join(f"'{k}+', '{k}-'" for k in INTRONS) + ")"
#: For each element: the best earlier one of each rule, those of them that pass all tests, and of these the best.
_SQL = f"""WITH RECURSIVE base AS (SELECT c_nationkey::BIGINT AS locus, o_orderkey AS ord, (o_orderdate::DATE - DATE '1970-01-01') * 10 + o_orderkey % 10 AS lo, ({_KINDS})[o_orderkey % 11 + 1] AS type FROM orders JOIN customer ON c_custkey = o_custkey),
 e0 AS (SELECT locus, {{'ord': ord, 'lo': lo, 'hi': CASE WHEN type = 'Internal' AND ord // 11 % 9 = 0 THEN lo - 1 ELSE lo + ord % 37 END, 'kind': type || CASE WHEN ord % 5 < 3 THEN '+' ELSE '-' END, 'score': ord % 101 - 20, 'need': ord // 3 % 3,
   'give': CASE WHEN type = 'Intron' THEN ord // 3 % 3 ELSE ord // 7 % 3 END, 'grp': CASE WHEN ord % 13 = 0 THEN 'g' || ord % 2 ELSE '' END, 'ev': CASE WHEN ord % 17 = 0 THEN 1 ELSE 0 END, 'lc': CASE WHEN ord // 11 % 23 = 0 THEN 1 ELSE 0 END,
   'rc': CASE WHEN ord // 5 % 23 = 0 THEN 1 ELSE 0 END, 'ls': ord % 7, 'rs': ord % 8, 'lv': ord // 4 % 3, 'rv': ord // 6 % 4}} AS e FROM base),
 e AS (SELECT locus, list(e ORDER BY e.lo + e.ev, e.ord) AS es FROM e0 GROUP BY locus),
 r AS (SELECT locus, es, 0 AS i, CAST([] AS STRUCT(t BIGINT, b BIGINT, lv BIGINT, rv BIGINT, give BIGINT, need BIGINT)[]) AS st FROM e
  UNION ALL SELECT locus, es, i + 1, list_append(st, CASE WHEN NOT known THEN {{'t': NULL, 'b': NULL, 'lv': 0, 'rv': 0, 'give': 0, 'need': 0}} WHEN w IS NULL THEN {{'t': x.score, 'b': NULL, 'lv': x.lv, 'rv': x.rv, 'give': x.give, 'need': x.need}}
    ELSE {{'t': w.t + x.score, 'b': -w.j, 'lv': CASE WHEN passes THEN st[-w.j].lv ELSE x.lv END, 'rv': CASE WHEN passes THEN st[-w.j].rv ELSE x.rv END, 'give': CASE WHEN passes AND NOT intron THEN st[-w.j].give ELSE x.give END, 'need': CASE WHEN passes AND NOT intron THEN st[-w.j].need ELSE x.need END}} END)
  FROM (SELECT *, list_sort([{{'t': b.p.t, 'c': -b.c, 'j': b.p.j}} FOR b IN bests IF b.p IS NOT NULL AND (NOT b.block OR es[-b.p.j].grp = x.grp)
      AND (x.lc = 0 OR x.kind LIKE 'Single%' OR x.ev = 1 OR es[-b.p.j].ev = 1 OR (es[-b.p.j].rs + x.ls > {MINOR[0]} AND es[-b.p.j].score + x.score > {MINOR[1]}))
      AND (passes OR NOT (CASE WHEN x.kind LIKE '%+' THEN st[-b.p.j].rv * 10 + x.lv ELSE x.rv * 10 + st[-b.p.j].lv END IN (11, 22, 32, 33)))], 'DESC')[1] AS w
   FROM (SELECT *, [{{'c': u.c, 'block': u.block, 'p': list_sort([{{'t': st[j].t, 'reach': -(es[j].hi + es[j].ev), 'j': -j}} FOR j IN range(1, i + 1) IF list_contains(u.up, es[j].kind) AND st[j].t > 0 AND st[j].give = x.need AND es[j].rc = x.lc
       AND x.lo + x.ev - es[j].hi - es[j].ev BETWEEN u.least AND u.most], 'DESC')[1]}} FOR u IN rules IF list_contains(u.down, x.kind)] AS bests
    FROM (SELECT *, x.kind IN {_INTRON} AS intron, x.kind IN {_INTRON} OR x.hi = x.lo - 1 AS passes, len([1 FOR u IN rules IF list_contains(u.down, x.kind) OR list_contains(u.up, x.kind)]) > 0 AS known
     FROM (SELECT *, es[i + 1] AS x, [{_RULES}] AS rules FROM r WHERE i < len(es)))))),
 z AS (SELECT * FROM r WHERE i = len(es)),
 rows AS (SELECT locus, unnest(range(1, len(es) + 1)) AS n, unnest(es) AS x, unnest(st) AS s FROM z),
 last AS (SELECT locus, n FROM rows WHERE s.t > 0 AND NOT (x.kind IN {_INTRON} AND s.b IS NULL) QUALIFY row_number() OVER (PARTITION BY locus ORDER BY s.t DESC, n) = 1),
 path AS (SELECT locus, n FROM last UNION ALL SELECT p.locus, rows.s.b FROM path p JOIN rows ON rows.locus = p.locus AND rows.n = p.n WHERE rows.s.b IS NOT NULL)
SELECT rows.locus, x.ord AS ord, s.t AS chain_score, z.es[s.b].ord AS before_ord, path.n IS NOT NULL AS on_best FROM rows JOIN z USING (locus) LEFT JOIN path ON path.locus = rows.locus AND path.n = rows.n WHERE s.t IS NOT NULL"""

ORACLES = {"chain_engine": _SQL}
QUERIES = {name: globals()[name] for name in ORACLES}
