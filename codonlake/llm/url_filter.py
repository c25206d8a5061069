"""URL filters with redirect equivalence; DataFrame functions only.

Rules (action, host, path) fit a host with all its subdomains where the path starts with the
rule's; the longest rule wins. URLs that lead to one another are one class: canonical links and
refresh redirects of the pages, a table of known redirects if given, and URLs that differ only in
fragment or tracking parameters. Classes are connected components found by distributed joins. A
page without a rule of its own is blocked when its class holds a blocked URL and no explicitly
allowed one; a page's own rule always stands.

Edge cases: a null URL, or one without "://", has empty host and path and fits no rule; repeated
pages get the same verdict each; null html has no links; all links of a page count, relative ones
against its URL, in letters of either case; an empty table gives an empty result;
extra columns are ignored. Of two rules of the same host and path, allow wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonlake.llm.graph import components
from codonlake.llm.session import stash, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are written into the expression; more are joined by host suffix.
INLINE_RULES = 500
TRACKING = r"(?:utm_[^=&#]*|ref|fbclid|gclid|mc_cid|mc_eid)=[^&#]*"


def _after(url: Column) -> Column:
    """What follows the first "://", or the empty string."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _best(fitting: Column) -> Column:
    """Of an array of (host, path, action) the longest; allow on a tie."""
    ranked = F.transform(fitting, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), (r["action"] == "allow").alias("allow"), F.concat(r["host"], r["path"]).alias("rule"), r["action"].alias("action")))
    return F.array_max(ranked)


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path and ``best`` (struct with rule and action, null without one)."""
    out = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if isinstance(rules, list) and len(rules) <= INLINE_RULES:
        if not rules:
            return out.withColumn("best", F.lit(None).cast("struct<size:int,allow:boolean,rule:string,action:string>"))
        every = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules])
        fits = F.filter(every, lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col("path"), r["path"]))
        return out.withColumn("best", _best(fits))
    frame = urls.sparkSession.createDataFrame(rules, "action string, rule_host string, rule_path string") if isinstance(rules, list) else rules.toDF("action", "rule_host", "rule_path")
    # a host meets the rules of its suffixes; URLs are made distinct first, so popular ones meet them once
    one = out.select(url, "host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = one.select(url, "path", F.explode(suffixes).alias("rule_host")).join(frame, "rule_host").where(F.startswith(F.col("path"), F.col("rule_path")))
    size = F.length("rule_host") + F.length("rule_path")
    best = met.groupBy(url).agg(F.max(F.struct(size.alias("size"), (F.col("action") == "allow").alias("allow"), F.concat("rule_host", "rule_path").alias("rule"), "action")).alias("best"))
    return out.join(best, url, "left")


def plain(url: Column) -> Column:
    """The URL without fragment and tracking parameters."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"(?<=[?&])" + TRACKING + r"(?:&|$)", "")
    return F.regexp_replace(bare, r"[?&]$", "")


def resolved(base: Column, ref: Column) -> Column:
    """What the reference ``ref`` of a page at the URL ``base`` leads to."""
    root = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    bare = F.regexp_replace(base, r"(?s)[?#].*$", "")
    path = F.substring(bare, F.length(root) + 1, F.length(bare))
    here = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"(?s)^.*/", 0)).otherwise("/")
    step = F.regexp_extract(ref, r"^[^?#]*", 0)
    tail = F.substring(ref, F.length(step) + 1, F.length(ref))
    parts = F.split(F.concat(F.when(F.startswith(step, F.lit("/")), F.lit("")).otherwise(here), step), "/", -1)
    parts = F.slice(F.concat(parts, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), 2, F.length(base) + F.length(ref) + 2)
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda s, x: F.when(x == ".", s).when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))),
    )
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, r"^[^:/?#]+:", 0), ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(F.regexp_replace(base, r"(?s)#.*$", ""), ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(bare, ref))
        .otherwise(F.concat(root, F.lit("/"), F.array_join(walked, "/"), tail))
    )


def _tags(html: Column, keyword: str, tag: str, attribute: str) -> Column:
    """The values of ``attribute`` in all tags of the page that fit ``tag``."""
    found = F.when(F.contains(F.lower(html), F.lit(keyword)), F.regexp_extract_all(html, F.lit(tag), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(found, lambda t: F.regexp_extract(t, attribute, 1)), lambda v: v != "")


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Distinct edges (u, v) between URLs that lead to one another."""
    html = F.coalesce(F.col("html"), F.lit(""))
    links = _tags(html, "canonical", r"(?i)<link\b[^>]*\brel=[\"']?canonical[\"']?[^>]*>", r"(?i)\bhref=[\"']?([^\"'\s>]+)")
    refreshes = _tags(html, "refresh", r"(?i)<meta\b[^>]*\bhttp-equiv=[\"']?refresh[\"']?[^>]*>", r"(?i)\burl=[\"']?([^\"'\s>;]+)")
    targets = F.concat(F.array(plain(F.col("url"))), F.transform(F.concat(links, refreshes), lambda v: resolved(F.col("url"), v)))
    edges = pages.where(F.contains("url", F.lit("://"))).select(F.col("url").alias("u"), F.explode(targets).alias("v"))
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("src"), F.col("dst")))
    return edges.where(F.contains("v", F.lit("://")) & (F.col("u") != F.col("v"))).distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html)."""
    classes = components(alias_edges(pages, redirects))
    ruled = with_rule(classes.withColumnRenamed("node", "url"), rules)
    verdicts = ruled.groupBy("component").agg(F.max((F.col("best.action") == "block").cast("int")).alias("blocked"), F.max((F.col("best.action") == "allow").cast("int")).alias("allowed"))
    blocked = stash(verdicts.where("blocked = 1 and coalesce(allowed, 0) = 0").select("component"), "blocked")
    by_url = stash(classes.join(blocked, "component", "left_semi").select(F.col("node").alias("url"), F.lit(True).alias("through")), "through")
    own = with_rule(pages.select("page_id", "url"), rules)
    out = own.join(by_url, "url", "left")
    verdict = F.coalesce("best.action", F.when(F.col("through"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


#: The contract's rules: action, host, start of the path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES)


#: The verdicts by rule; aliases in the given pages share host and path, so no other page is blocked.
OP3_SQL = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM b)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM c
"""
