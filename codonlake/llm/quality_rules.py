"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Statistics of a text become rules "reject when a ratio is over its cutoff". Cutoffs are chosen on
all labelled holdouts, for each stratum (length band) apart. The rules tighten together, along a fixed
path from loose to tight (PATHS), and what is tested at each step is their union: a step is certified
while an exact binomial test shows that good documents are rejected, by any of the rules, at a rate
of at most ALPHA. The level DELTA is divided by the number of strata (Bonferroni); along the path the
tests are in a fixed order, which needs no further correction. So with probability 1 - DELTA no
stratum loses more than ALPHA of its good documents to the method. Of the certified steps the one is
used that rejects the most bad documents, with COST times the share of rejected good ones taken off.
Where labels are too few for a proof nothing is rejected beyond the base.

Edge cases: a null or empty text has no words and fails the base; null statistics don't occur;
repeated rows get the same verdict each; an empty table gives an empty result; without labels
only the base decides; labels of one id count once, as bad if any says so. Extra columns stay as they
are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codonlake.llm.session import stash, table

GAP = r"[\x20\x09-\x0D]+"
#: False-rejection rate, error level, price of a good document.
ALPHA, DELTA, COST = 0.01, 0.05, 10.0
#: Loosest and tightest cutoff of each rule: shares of characters, characters, lines and words. All take STEPS steps.
PATHS = {"symbol": (0.8, 0.01), "shout": (0.9, 0.2), "dup_line": (0.9, 0.1), "repeat": (0.2, 0.05)}
STEPS = 30
GRIDS = [[round(a * (b / a) ** (i / (STEPS - 1)), 4) for i in range(STEPS)] for a, b in PATHS.values()]
STRATA = 3
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_lines")
P = "__quality_"
#: Bits of a number that hold the place of a window, the others are its hash.
SPOT_BITS = 22


def _window_hash(w: str) -> str:
    return f"xxhash64({w}[i], {w}[i + 1], {w}[i + 2], {w}[i + 3], {w}[i + 4])"


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns STATS, each after the prefix P."""
    body = F.coalesce(F.col(text), F.lit(""))
    one = docs.withColumns(
        {
            P + "words": F.array_remove(F.split(body, GAP), ""),
            P + "lines": F.filter(F.split(body, "\n", -1), lambda x: F.ltrim(x, F.lit(" \t\n\v\f\r")) != ""),
            P + "n_symbols": F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long"),
            P + "n_shouts": F.length(F.regexp_replace(body, "[^A-Z!]+", "")).cast("long"),
        }
    )
    w, h, d, s = (P + c for c in ("words", "hashes", "again", "sorted"))
    spot, windows = (1 << SPOT_BITS) - 1, f"sequence(0, size({w}) - 5)"
    two = one.withColumns(
        {
            P + "n_words": F.size(w).cast("long"),
            P + "word_chars": F.length(F.array_join(w, "")).cast("long"),
            P + "n_lines": F.size(P + "lines").cast("long"),
            P + "n_dup_lines": (F.size(P + "lines") - F.size(F.array_distinct(P + "lines"))).cast("long"),
            # windows of five words as plain numbers, which sort without objects: bits of a hash, then the place
            h: F.expr(
                f"if(size({w}) < 5, cast(array() as array<bigint>), sort_array(transform({windows}, i -> ({_window_hash(w)} & {~spot}L) | (cast(i as bigint) & {spot}L))))"
            ),
        }
    )
    # equal windows have equal hashes: where all hashes differ nothing repeats
    same = f"(shiftright({{a}}, {SPOT_BITS}) = shiftright({{b}}, {SPOT_BITS}))"
    before, after = same.format(a="x", b=f"{h}[i - 1]"), same.format(a="x", b=f"{h}[i + 1]")
    three = two.withColumn(
        d,
        F.expr(
            f"if(size(filter({h}, (x, i) -> i > 0 and {before})) = 0, cast(array() as array<bigint>),"
            f" filter({h}, (x, i) -> (i > 0 and {before}) or (i < size({h}) - 1 and {after})))"
        ),
    ).drop(h)
    # a text in which windows share a hash but no words, or of more words than there are places, has its windows sorted whole
    one_, other = (f"cast({d}[i{back}] & {spot}L as int)" for back in ("", " - 1"))
    differ = " or ".join(f"{w}[{one_} + {k}] != {w}[{other} + {k}]" for k in range(5))
    mixed = f"exists(sequence(0, size({d}) - 1), i -> i > 0 and {same.format(a=f'{d}[i]', b=f'{d}[i - 1]')} and ({differ}))"
    four = three.withColumn(
        s,
        F.expr(
            f"if(size({d}) > 0 and (size({w}) > {spot} or {mixed}),"
            f" sort_array(transform({windows}, i -> struct(array({w}[i], {w}[i + 1], {w}[i + 2], {w}[i + 3], {w}[i + 4]) as g, i as at))), null)"
        ),
    )
    whole = f"filter({s}, (x, i) -> (i > 0 and x.g = {s}[i - 1].g) or (i < size({s}) - 1 and x.g = {s}[i + 1].g))"
    five = four.withColumn(
        P + "places",
        F.expr(f"sort_array(if({s} is null, transform({d}, x -> cast(x & {spot}L as int)), transform({whole}, x -> x.at)))"),
    ).drop(d, s)
    covered = F.expr(
        f"aggregate({P}places, named_struct('n', 0L, 'e', 0), (s, x) -> named_struct('n', s.n + (x + 5 - greatest(x, s.e)), 'e', x + 5), s -> s.n)"
    )
    six = five.withColumn(P + "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # a generator is a fence: filters on the statistics must not be pushed down, which would put
    # the splitting of the text inside the lambdas over its words
    made = [P + c for c in STATS]
    return six.select(*docs.columns, F.inline(F.array(F.struct(*made))).alias(*made))


def _ratio(over: str, under: str) -> Column:
    return F.col(P + over) / F.greatest(F.col(P + under), F.lit(1)).cast("double")


def _rule_values() -> Column:
    ratios = (("n_symbols", "word_chars"), ("n_shouts", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))
    return F.array(*[_ratio(a, b) for a, b in ratios])


def _reaches(value: Column):
    """Whether a cutoff lets a value pass."""
    return lambda c: value <= c


def base_failed() -> Column:
    return (F.col(P + "n_words") < 10) | (100 * F.col(P + "n_repeat_words") > 20 * F.col(P + "n_words"))


def _stratum() -> Column:
    n = F.col(P + "n_words")
    return F.when(n < 100, 0).when(n < 1000, 1).otherwise(2)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X binomial (n, p), summed term by term; k and n are whole."""
    step = f"ln((s.n - i + 1) / cast(i as double)) + {math.log(p / (1 - p))!r}"
    state = "named_struct('n', s.n, 't', s.t + ({d}), 's', greatest(s.s, s.t + ({d})) + ln(1 + exp(-abs(s.s - (s.t + ({d}))))))".format(d=step)
    zero = f"n * ln({1 - p!r}D)"
    start = f"named_struct('n', cast(n as double), 't', {zero}, 's', {zero})"
    return F.expr(f"aggregate(if(k < 1, cast(array() as array<bigint>), sequence(1L, k)), {start}, (s, i) -> {state}, s -> s.s)")


def fit_cutoffs(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row (stratum, cutoffs: one for each rule) for each stratum where a step is certified.

    All labelled documents are counted.
    """
    return _fit(with_statistics(docs.select("doc_id", "text")), labels, alpha, delta)


def _fit(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """fit_cutoffs() of rows with a doc_id and STATS. Only ids and numbers meet the labels: no text is shuffled."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # the first step at which any rule rejects: all tighter ones do, too
    values = _rule_values()
    first = F.least(*[F.size(F.filter(F.array(*[F.lit(c) for c in grid]), _reaches(values[r]))) for r, grid in enumerate(GRIDS)])
    steps_of = stats.where(~base_failed()).select("doc_id", _stratum().alias("stratum"), first.alias("step"))
    hits = steps_of.join(marked, "doc_id")
    side = lambda good: F.sum(F.when((F.col("quality") == 1) == good, 1).otherwise(0))
    counts = stash(hits.groupBy("stratum", "step").agg(side(True).alias("good"), side(False).alias("bad")), "counts")
    upto = W.partitionBy("stratum").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    steps = F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step")
    full = counts.select("stratum").distinct().select("stratum", steps).join(counts, ["stratum", "step"], "left").na.fill(0, ["good", "bad"])
    totals = counts.groupBy("stratum").agg(F.sum("good").alias("n"), F.sum("bad").alias("m"))
    curve = full.withColumns({"k": F.sum("good").over(upto), "caught": F.sum("bad").over(upto)}).join(totals, "stratum")
    level = math.log(delta / STRATA)
    tested = curve.withColumn("proved", (F.col("n") > 0) & (F.col("k") <= alpha * F.col("n")) & (F.when(F.col("k") <= alpha * F.col("n"), binomial_tail(F.col("k"), F.col("n"), alpha)) <= level))
    certified = tested.withColumn("holds", F.min(F.col("proved").cast("int")).over(upto)).where("holds = 1")
    gain = F.col("caught") / F.greatest("m", F.lit(1)) - COST * F.col("k") / F.col("n")
    best = certified.withColumn("gain", gain).where("gain > 0").groupBy("stratum").agg(F.max(F.struct("gain", (-F.col("step")).alias("neg"))).alias("best"))
    cutoffs = F.array(*[F.get(F.array(*[F.lit(c) for c in grid]), -F.col("best.neg")) for grid in GRIDS])
    return stash(best.select("stratum", cutoffs.alias("cutoffs")), "cutoffs")


def _verdicts(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows with STATS get ``base_failed`` and ``kept``, both after the prefix P."""
    named = cutoffs.select(F.col("stratum").alias(P + "stratum"), F.col("cutoffs").alias(P + "cutoffs"))
    seen = stats.withColumns({P + "stratum": _stratum(), P + "values": _rule_values()})
    out = seen.join(F.broadcast(named), P + "stratum", "left")  # three rows
    over = F.coalesce(F.expr(f"exists(arrays_zip({P}values, {P}cutoffs), x -> coalesce(x.{P}values > x.{P}cutoffs, false))"), F.lit(False))
    return out.withColumns({P + "base_failed": base_failed(), P + "kept": ~base_failed() & ~over}).drop(P + "stratum", P + "values", P + "cutoffs")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with STATS, ``base_failed`` and ``kept``, all after the prefix P. Texts are scanned twice and never shuffled."""
    return _verdicts(with_statistics(docs), fit_cutoffs(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are."""
    return judged(docs, labels).where(P + "kept").select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and what judged() says, without the texts, which are scanned once."""
    stats = stash(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics", scan=True)
    out = _verdicts(stats, _fit(stats, labels))
    return out.select("doc_id", *[F.col(P + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
