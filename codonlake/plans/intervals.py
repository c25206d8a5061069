"""Interval, coverage, chaining and feature queries over events, orders and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.operators import ranges as R
from codonlake.operators.chains import Rule, chained


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their second of time and a value in hundredths."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.floor(F.col("value") * 100).alias("size"))


_E = "e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, CAST(floor(value * 100) AS BIGINT) AS size FROM events)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "event_type", F.col("at").alias("lo"), (F.col("at") + 60 + F.col("size") % 5400).alias("hi"), "size")


_SPANS = _E + ", s AS (SELECT event_id, event_type, at_s AS lo, at_s + 60 + size % 5400 AS hi, size FROM e)"


def coverage_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of overlapping event spans of each type."""
    out = R.sweep(_spans(spark, sf_dir), ["event_type"], "lo", "hi", 86400)
    return out.select("event_type", "start", "end", F.col("depth").cast("long").alias("depth"))


def coverage_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds at each depth, depths over three counted as three."""
    out = coverage_sweep(spark, sf_dir).groupBy("event_type", F.least("depth", F.lit(3).cast("long")).alias("depth"))
    return out.agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


def max_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best density (size over length) of the spans on each bin of 600 seconds: a span is cut into the bins it touches."""
    s = _spans(spark, sf_dir).withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / 600), F.floor((F.col("hi") - 1) / 600))))
    return s.groupBy("event_type", "bin").agg(F.round(F.max(F.col("size") / (F.col("hi") - F.col("lo"))), 6).alias("best"))


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of events in each hour with any, in order."""
    return _events(spark, sf_dir).groupBy("event_type", F.floor(F.col("at") / 3600).alias("hour")).agg(F.count("*").alias("n"))


_TRACK = _E + ", t AS (SELECT event_type, at_s // 3600 AS hour, count(*) AS n FROM e GROUP BY ALL)"


def peak_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope change six steps on either side, from a running sum."""
    w = W.partitionBy("event_type").orderBy("hour")
    t = R.running_sum(_track(spark, sf_dir), ["event_type"], "hour", F.col("n"), "total")
    t = t.withColumns({"on": F.lead("total", 6).over(w), "back": F.lag("total", 6).over(w)}).where("on is not null and back is not null")
    return t.select("event_type", "hour", F.round(10 * ((F.col("on") - F.col("total")) / 6.0 - (F.col("total") - F.col("back")) / 6.0), 6).cast("double").alias("edge"))


def cluster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring hours: where they begin and end."""
    w = W.partitionBy("event_type").orderBy("hour")
    t = _track(spark, sf_dir).withColumn("gap", F.coalesce(F.col("hour") - F.lag("hour").over(w) > 1, F.lit(True)))
    t = R.islands(t, ["event_type"], F.col("hour"), F.col("gap"), "run")
    return t.groupBy("event_type", "run").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.sum("n").alias("n")).drop("run")


def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours whose count is over both neighbours' and over two."""
    w = W.partitionBy("event_type").orderBy("hour")
    t = _track(spark, sf_dir).withColumns({"back": F.lag("n").over(w), "on": F.lead("n").over(w)})
    return t.where("n > back and n > on and n > 2").select("event_type", "hour", "n")


def anti_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with no click of any user within 120 seconds."""
    e = _events(spark, sf_dir).select("event_type", "event_id", "at").withColumn("day", F.floor(F.col("at") / 86400))
    left, right = e.where("event_type = 'purchase'"), e.where("event_type = 'click'")
    # windows don't cross partitions: what is within reach of a day's border goes to both days
    near = [right.select("day", "at"), right.where("at % 86400 < 120").select((F.col("day") - 1).alias("day"), "at"), right.where("at % 86400 >= 86280").select((F.col("day") + 1).alias("day"), "at")]
    out = R.without_near(left.select("day", "event_id", "at"), near[0].union(near[1]).union(near[2]), ["day"], "at", 120, 121)
    return out.select("event_id", "at")


def asof_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user's last earlier one of a different second."""
    out = R.last_before(_events(spark, sf_dir), ["user_id"], "at", F.lit(True), F.col("at"), "prev_at")
    return out.select("event_id", "user_id", "at", "prev_at")


def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user's next purchase at or after it."""
    out = R.next_at_or_after(_events(spark, sf_dir), ["user_id"], "at", F.col("event_type") == "purchase", "next_at")
    return out.select("event_id", "at", "next_at")


def evidence_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of unknown frame becomes three rows; introns also give their two UTR kinds."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("locus"), "o_orderstatus")
    kind = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("Intron"), F.lit("UTR_5prime_Intron"), F.lit("UTR_3prime_Intron"))).otherwise(F.array(F.lit("Internal")))
    frame = F.when(F.col("o_orderstatus") == "P", F.array(F.pmod("locus", F.lit(3)))).otherwise(F.array(*[F.lit(i).cast("long") for i in range(3)]))
    rows = o.select("locus", F.explode(kind).alias("kind"), frame.alias("frames")).select("locus", "kind", F.explode("frames").alias("frame"))
    swap = F.col("kind").startswith("UTR")
    return rows.select("locus", "kind", F.when(swap, F.pmod(3 - F.col("frame"), F.lit(3))).otherwise(F.col("frame")).alias("frame"), F.when(swap, F.col("frame")).alias("rest"))


def evidence_union_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted rows, then evidence, ranked by left end within a key: the source's rank breaks ties."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("ord"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("left_end"), F.lit(0).cast("long").alias("src"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.lit(0).cast("long").alias("ord"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("left_end"), F.lit(1).cast("long").alias("src"))
    both = line.unionByName(o)
    return both.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("left_end", "src", "ord")).cast("long"))


#: Orders chain by status: which may follow which, and after how many days.
RULES = [Rule(frozenset("OP"), frozenset("F"), 1, 900), Rule(frozenset("F"), frozenset("O"), 10), Rule(frozenset("F"), frozenset("P"), 0, 400)]


def chain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chain of each customer's orders that ends at each order, under RULES."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("long")
    parts = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("ord"), day.alias("left_end"), day.alias("right_end"), F.col("o_orderstatus").alias("kind"), F.floor(F.col("o_totalprice")).cast("double").alias("score"), F.lit("").alias("block_group"))
    return chained(parts, "cust", RULES).select("cust", "ord", F.col("chain_score").cast("long").alias("chain_score"))


def chain_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's best chain: the highest score and the order that ends it."""
    best = chain_rules(spark, sf_dir).groupBy("cust").agg(F.max(F.struct("chain_score", F.expr("-ord").alias("neg"))).alias("b"))
    return best.select("cust", (-F.col("b.neg")).alias("ord"), F.col("b.chain_score").alias("chain_score"))


_LINE = "l AS (SELECT l_orderkey AS gene, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand0, l_partkey * 100 + l_linenumber AS lo, l_partkey * 100 + l_linenumber + CAST(l_quantity AS BIGINT) AS hi, l_quantity AS score FROM lineitem)"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as exons of a gene (the order): strand of the whole gene, ends and score."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lo = F.col("l_partkey") * 100 + F.col("l_linenumber")
    out = line.select(F.col("l_orderkey").alias("gene"), F.col("l_linenumber").cast("long").alias("line"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand0"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long")).alias("hi"), F.col("l_quantity").alias("score"))
    return out.withColumn("strand", F.min("strand0").over(W.partitionBy("gene"))).drop("strand0")


def gene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    return f.groupBy("gene", "strand").agg(F.count("*").alias("n_exons"), F.min("lo").alias("gene_start"), F.max("hi").alias("gene_end"), F.round(F.sum("score"), 6).alias("gene_score"))


def feature_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons numbered along the gene's strand."""
    f = _features(spark, sf_dir)
    order = F.when(F.col("strand") == "-", -F.col("lo")).otherwise(F.col("lo"))
    return f.select("gene", "line", F.row_number().over(W.partitionBy("gene").orderBy(order, "line", "hi")).cast("long").alias("number"))


def intron_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns between neighbouring exons, with the mean of their scores and the phase."""
    w = W.partitionBy("gene").orderBy("lo", "line", "hi")
    before = W.partitionBy("gene").orderBy("lo", "line", "hi").rowsBetween(W.unboundedPreceding, -1)
    f = _features(spark, sf_dir).withColumns({"prev_hi": F.lag("hi").over(w), "prev_score": F.lag("score").over(w), "coding": F.sum(F.col("hi") - F.col("lo") + 1).over(before)})
    return f.where("prev_hi + 1 < lo").select("gene", (F.col("prev_hi") + 1).alias("intron_start"), (F.col("lo") - 1).alias("intron_end"), F.round((F.col("prev_score") + F.col("score")) / 2, 6).alias("score"), F.pmod(3 - F.col("coding") % 3, F.lit(3)).alias("phase"))


def exon_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons that touch or overlap become one; scores add up."""
    furthest = F.max("hi").over(W.partitionBy("gene").orderBy("lo", "line").rowsBetween(W.unboundedPreceding, -1))
    f = R.islands(_features(spark, sf_dir).withColumn("new", F.coalesce(F.col("lo") > furthest + 1, F.lit(True))), ["gene"], F.struct("lo", "line"), F.col("new"), "part")
    return f.groupBy("gene", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.round(F.sum("score"), 6).alias("score")).drop("part")


def gene_rpkm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per thousand bases and million reads of each gene (reads: the score)."""
    g = gene_summary(spark, sf_dir)
    million = g.agg((F.sum("gene_score") / 1e6).alias("million"))
    return g.join(F.broadcast(million)).select("gene", F.round(F.col("gene_score") / ((F.col("gene_end") - F.col("gene_start") + 1) / 1000.0) / F.col("million"), 4).cast("double").alias("rpkm"))


def intron_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introns by kind of splice sites: two scores decide."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    d, a = F.col("l_discount") * 100, F.col("l_tax") * 100
    kind = F.when((d + a > 14) & (F.col("l_quantity") > 40), "U12gtag").when(d + a > 14, "U12atac").when(d > a, "U2gcag").otherwise("U2")
    return line.groupBy(kind.alias("kind"), F.col("l_returnflag").alias("strand")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


def type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.rollup(F.col("l_linestatus").alias("strand"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("total"))


def dedup_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains saved at fragment borders: equal elements are kept once."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").dropDuplicates()


def bed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block lists of an order (sizes and starts) to exon and intron rows."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bed = line.groupBy(F.col("l_orderkey").alias("name")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("i"), F.col("l_quantity").cast("long").alias("size")))).alias("b"))
    placed = bed.select("name", F.expr("aggregate(b, named_struct('at', 0L, 'out', cast(array() as array<struct<lo:bigint,hi:bigint>>)), (s, x) -> named_struct('at', s.at + x.size + 10, 'out', concat(s.out, array(named_struct('lo', s.at, 'hi', s.at + x.size)))), s -> s.out)").alias("blocks"))
    exons = placed.select("name", F.lit("exon").alias("kind"), F.explode("blocks").alias("x"))
    introns = placed.where("size(blocks) > 1").select("name", F.lit("intron").alias("kind"), F.explode(F.expr("transform(sequence(0, size(blocks) - 2), i -> named_struct('lo', blocks[i].hi, 'hi', blocks[i + 1].lo))")).alias("x"))
    return exons.union(introns).select("name", "kind", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))


def read_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spliced reads to introns: equal ones counted."""
    f = intron_lag(spark, sf_dir)
    return f.groupBy((F.col("intron_start") % 10000).alias("lo"), (F.col("intron_end") % 10000).alias("hi")).agg(F.count("*").alias("reads"))


_FEAT = _LINE + ", f AS (SELECT *, min(strand0) OVER (PARTITION BY gene) AS strand FROM l)"
_INTRON = _FEAT + ", i AS (SELECT gene, prev_hi + 1 AS intron_start, lo - 1 AS intron_end, round((prev_score + score) / 2, 6) AS score, CAST((3 - coding % 3) % 3 AS BIGINT) AS phase FROM (SELECT *, lag(hi) OVER w AS prev_hi, lag(score) OVER w AS prev_score, sum(hi - lo + 1) OVER (PARTITION BY gene ORDER BY lo, line, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS coding FROM f WINDOW w AS (PARTITION BY gene ORDER BY lo, line, hi)) WHERE prev_hi + 1 < lo)"
_SWEEP = _SPANS + ", p AS (SELECT event_type, lo AS start, 1 AS d FROM s UNION ALL SELECT event_type, hi, -1 FROM s), q AS (SELECT event_type, start, sum(d) AS d FROM p GROUP BY ALL), c AS (SELECT event_type, start, lead(start) OVER w AS \"end\", CAST(sum(d) OVER (PARTITION BY event_type ORDER BY start) AS BIGINT) AS depth FROM q WINDOW w AS (PARTITION BY event_type ORDER BY start))"
_FROM = {("O", "F"): (1, 900), ("P", "F"): (1, 900), ("F", "O"): (10, 10**9), ("F", "P"): (0, 400)}
_OK = " OR ".join(f"(ks[j] = '{u}' AND ks[i + 1] = '{d}' AND ds[i + 1] - ds[j] BETWEEN {a} AND {b})" for (u, d), (a, b) in _FROM.items())
_CHAIN = f"""RECURSIVE o AS (SELECT o_custkey AS cust, list(o_orderkey ORDER BY o_orderdate::DATE, o_orderkey) AS os, list(o_orderdate::DATE - DATE '1970-01-01' ORDER BY o_orderdate::DATE, o_orderkey) AS ds,
 list(o_orderstatus ORDER BY o_orderdate::DATE, o_orderkey) AS ks, list(CAST(floor(o_totalprice) AS BIGINT) ORDER BY o_orderdate::DATE, o_orderkey) AS vs FROM orders GROUP BY o_custkey),
 r AS (SELECT cust, os, ds, ks, vs, 0 AS i, CAST([] AS BIGINT[]) AS best FROM o UNION ALL
 SELECT cust, os, ds, ks, vs, i + 1, list_append(best, vs[i + 1] + greatest(0, coalesce(list_max([best[j] FOR j IN range(1, i + 1) IF {_OK}]), 0))) FROM r WHERE i < len(os)),
 z AS (SELECT cust, unnest(os) AS ord, unnest(best) AS chain_score FROM r WHERE i = len(os))"""

ORACLES = {
    "coverage_sweep": f"WITH {_SWEEP} SELECT * FROM c WHERE depth > 0",
    "coverage_capped": f"WITH {_SWEEP} SELECT event_type, least(depth, 3) AS depth, CAST(sum(\"end\" - start) AS BIGINT) AS seconds FROM c WHERE depth > 0 GROUP BY ALL",
    "max_projection": f"WITH {_SPANS}, b AS (SELECT *, unnest(range(lo // 600, (hi - 1) // 600 + 1)) AS bin FROM s) SELECT event_type, bin, round(max(size / CAST(hi - lo AS DOUBLE)), 6) AS best FROM b GROUP BY ALL",
    "peak_edges": f"WITH {_TRACK}, u AS (SELECT event_type, hour, sum(n) OVER (PARTITION BY event_type ORDER BY hour) AS total FROM t), v AS (SELECT *, lead(total, 6) OVER w AS nxt, lag(total, 6) OVER w AS prv FROM u WINDOW w AS (PARTITION BY event_type ORDER BY hour)) SELECT event_type, hour, round(10 * ((nxt - total) / 6.0 - (total - prv) / 6.0), 6)::DOUBLE AS edge FROM v WHERE nxt IS NOT NULL AND prv IS NOT NULL",
    "cluster_edges": f"WITH {_TRACK}, g AS (SELECT *, hour - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS run FROM t) SELECT event_type, min(hour) AS first_hour, max(hour) AS last_hour, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY event_type, run",
    "local_peaks": f"WITH {_TRACK} SELECT event_type, hour, n FROM (SELECT *, lag(n) OVER w AS b, lead(n) OVER w AS o FROM t WINDOW w AS (PARTITION BY event_type ORDER BY hour)) WHERE n > b AND n > o AND n > 2",
    "anti_near": f"WITH {_E} SELECT event_id, at_s AS \"at\" FROM e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM e AS c WHERE c.event_type = 'click' AND c.at_s BETWEEN e.at_s - 120 AND e.at_s + 120)",
    "asof_prev": f"WITH {_E} SELECT event_id, user_id, at_s AS \"at\", max(at_s) OVER (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_at FROM e",
    "asof_next": f"WITH {_E} SELECT event_id, at_s AS \"at\", min(CASE WHEN event_type = 'purchase' THEN at_s END) OVER (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_at FROM e",
    "evidence_expand": "WITH o AS (SELECT o_orderkey AS locus, o_orderstatus AS s FROM orders), k AS (SELECT locus, s, unnest(CASE WHEN s = 'O' THEN ['Intron', 'UTR_5prime_Intron', 'UTR_3prime_Intron'] ELSE ['Internal'] END) AS kind FROM o), f AS (SELECT locus, kind, unnest(CASE WHEN s = 'P' THEN [locus % 3] ELSE [0, 1, 2] END) AS frame FROM k) SELECT locus, kind, CASE WHEN kind LIKE 'UTR%' THEN (3 - frame) % 3 ELSE frame END AS frame, CASE WHEN kind LIKE 'UTR%' THEN frame END AS rest FROM f",
    "evidence_union_sort": "WITH b AS (SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS ord, l_shipdate::DATE - DATE '1970-01-01' AS left_end, CAST(0 AS BIGINT) AS src FROM lineitem UNION ALL SELECT o_orderkey, 0, o_orderdate::DATE - DATE '1970-01-01', 1 FROM orders) SELECT *, row_number() OVER (PARTITION BY key ORDER BY left_end, src, ord) AS place FROM b",
    "chain_rules": f"WITH {_CHAIN} SELECT cust, ord, chain_score FROM z",
    "chain_max": f"WITH {_CHAIN} SELECT cust, ord, chain_score FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY chain_score DESC, ord) AS k FROM z) WHERE k = 1",
    "gene_summary": f"WITH {_FEAT} SELECT gene, strand, count(*) AS n_exons, min(lo) AS gene_start, max(hi) AS gene_end, round(sum(score), 6) AS gene_score FROM f GROUP BY ALL",
    "feature_number": f"WITH {_FEAT} SELECT gene, line, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN strand = '-' THEN -lo ELSE lo END, line, hi) AS number FROM f",
    "intron_lag": f"WITH {_INTRON} SELECT * FROM i",
    "exon_merge": f"WITH {_FEAT}, m AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY gene ORDER BY lo, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM f), g AS (SELECT *, sum(new) OVER (PARTITION BY gene ORDER BY lo, line) AS part FROM m) SELECT gene, min(lo) AS lo, max(hi) AS hi, round(sum(score), 6) AS score FROM g GROUP BY gene, part",
    "gene_rpkm": f"WITH {_FEAT}, g AS (SELECT gene, min(lo) AS a, max(hi) AS b, round(sum(score), 6) AS s FROM f GROUP BY gene) SELECT gene, round(s / ((b - a + 1) / 1000.0) / ((SELECT sum(s) FROM g) / 1e6), 4)::DOUBLE AS rpkm FROM g",
    "intron_class": "SELECT CASE WHEN l_discount * 100 + l_tax * 100 > 14 AND l_quantity > 40 THEN 'U12gtag' WHEN l_discount * 100 + l_tax * 100 > 14 THEN 'U12atac' WHEN l_discount * 100 > l_tax * 100 THEN 'U2gcag' ELSE 'U2' END AS kind, l_returnflag AS strand, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY ALL",
    "type_rollup": "SELECT l_linestatus AS strand, l_returnflag AS kind, count(*) AS n, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)",
    "dedup_state": "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem",
    "bed_blocks": "WITH b AS (SELECT l_orderkey AS name, l_linenumber AS i, CAST(sum(CAST(l_quantity AS BIGINT) + 10) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, CAST(l_quantity AS BIGINT) AS size FROM lineitem), x AS (SELECT name, i, e - size - 10 AS lo, e - 10 AS hi FROM b) SELECT name, 'exon' AS kind, lo, hi FROM x UNION ALL SELECT name, 'intron', hi, nxt FROM (SELECT name, hi, lead(lo) OVER (PARTITION BY name ORDER BY lo) AS nxt FROM x) WHERE nxt IS NOT NULL",
    "read_introns": f"WITH {_INTRON} SELECT intron_start % 10000 AS lo, intron_end % 10000 AS hi, count(*) AS reads FROM i GROUP BY ALL",
}
QUERIES = {name: globals()[name] for name in ORACLES}
