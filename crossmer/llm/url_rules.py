"""URL filters by a sort-merge range join with a stack of nested rules (operator 2).

A rule has a host and a path prefix; it fits its host, all subdomains, and paths
that start with its path. The longest fitting rule (host and path together, then
the longer host) gives the verdict, otherwise the method's own: allow.

Canonical keys have the host reversed, label by label (`org.example.a`), so a
rule's host covers one key per url: the url's reversed host cut to as many labels.
Below such a key a path prefix is an interval of the sorted paths, and two rules
are nested or disjoint. Rules and urls are sorted together by key and path and
swept: each rule carries the stack that is open after it (its ancestors and
itself), and a url takes the last rule before it and from that stack the longest
rule that still covers its path. No url meets a rule that is not next to it.

Keys of many urls are cut into salted slices, each swept with a copy of that
key's rules. Only built-in functions are used.

Cases: a null url, or one without `://`, has empty host and path and gets the
method's verdict; equal urls are judged once and every row of theirs gets the
result; rules with null parts count as empty, an empty rule host fits nothing;
repeated rules count once, an allow wins over an equal block; extra columns of
the input are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from crossmer.llm.common import table

URLS_PER_SLICE = 50_000
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def prepared(rules: DataFrame) -> DataFrame:
    """key, labels, path, stack: one row per rule with the rules open after it, outermost first."""
    clean = (
        rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
                     F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .filter("host <> ''")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .select(reversed_host(F.col("host")).alias("key"), F.size(F.split("host", r"\.")).alias("labels"),
                "path", "verdict", F.concat("host", "path").alias("rule"),
                F.length("host").alias("host_length"))
    )
    starts = clean.select(
        F.col("key").alias("k"), F.col("path").alias("own"),
        F.explode(F.expr("transform(sequence(0, length(path)), n -> substring(path, 1, n))")).alias("p"))
    outer = F.struct(F.col("path").alias("path"), F.col("rule").alias("rule"),
                     F.col("verdict").alias("verdict"), F.col("host_length").alias("host_length"))
    return (
        starts.join(clean, (F.col("k") == F.col("key")) & (F.col("p") == F.col("path")))
        .groupBy("key", "labels", F.col("own").alias("path"))
        .agg(F.sort_array(F.collect_list(outer)).alias("stack"))     # prefixes of one path: sorted is outermost first
    )


def judge(urls: DataFrame, rules: DataFrame, *, url_column: str = "url") -> DataFrame:
    """url, host, path, rule, verdict for every distinct url that some rule fits.

    `rules` has the columns verdict, host and path.
    """
    stacks = prepared(rules)
    keys = stacks.select("key", "labels").distinct()
    depths = [r["labels"] for r in keys.select("labels").distinct().orderBy("labels").collect()]
    parts = (
        urls.select(F.col(url_column).alias("url")).filter("url IS NOT NULL").distinct()
        .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .filter("host <> ''")
    )
    reverse = F.split(reversed_host(F.col("host")), r"\.")
    probes = (
        parts.select("url", "path", reverse.alias("labels_of"))
        .select("url", "path", F.explode(F.filter(
            F.array(*[F.when(F.size("labels_of") >= d, F.array_join(F.slice("labels_of", 1, d), "."))
                      for d in depths] or [F.lit(None).cast("string")]),
            lambda k: k.isNotNull())).alias("key"))
        .join(keys.select("key"), "key", "left_semi")
    )
    slices = probes.groupBy("key").agg(F.ceil(F.count("*") / URLS_PER_SLICE).cast("int").alias("slices"))
    placed = probes.join(slices, "key").withColumn("slice", F.pmod(F.xxhash64("url"), F.col("slices")).cast("int"))
    openings = stacks.join(slices, "key").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    events = (
        placed.select("key", "slice", "path", F.lit(1).alias("kind"), "url",
                      F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
        .unionByName(openings.select("key", "slice", "path", F.lit(0).alias("kind"),
                                     F.lit(None).cast("string").alias("url"), "stack"))
    )
    sweep = W.partitionBy("key", "slice").orderBy("path", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    covering = F.filter("open", lambda r: F.col("path").startswith(r["path"]))
    best = F.struct(F.length("rule").alias("n"), "host_length", "rule", "verdict")
    return (
        events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
        .filter("kind = 1")
        .select("url", F.get(F.reverse(covering), F.lit(0)).alias("r"))
        .filter("r IS NOT NULL")
        .select("url", "r.*")
        .groupBy("url").agg(F.max(best).alias("best"))
        .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )


def filter_urls(rows: DataFrame, rules: DataFrame, keep: Sequence[str] = (), default: str = "allow",
                url_column: str = "url") -> DataFrame:
    """The `keep` columns with host, path, rule (null if none fits) and verdict of every row."""
    asked = rows.select(*keep, F.col(url_column).alias("url"))
    judged = judge(asked, rules).select(F.col("url").alias("judged_url"), "rule", "verdict")
    return (
        asked.join(judged, F.col("url") == F.col("judged_url"), "left")
        .select(*keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
                F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return filter_urls(pages, rule_frame(spark, RULES), keep=("page_id",))


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
              ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*') END,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
              ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END AS path,
         row_number() OVER () AS row_id
  FROM pages),
rules(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT p.row_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.row_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM parts p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.row_id = f.row_id AND f.place = 1
"""
