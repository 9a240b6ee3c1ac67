"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each distinct url gives the suffixes of its host (by label) times the folder prefixes of its path.  An
expression meets a rule where the first 32 bits of their SHA-256 agree; then the whole digests and the rest of
the rule's path are compared, and of the rules that fit the longest wins.  Everything is DataFrame expressions.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; rules with a
null or empty host fit nothing and a rule's null path is empty; a rule given twice counts once, and of an allow
and a block rule for the same host and path the block rule holds.  Repeated pages give repeated rows, an empty
table none; other columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, ascii_lower, join_small, read

URL = r"(?s)://([^/?#]*)([^?#]*)"
#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def expressions(host: Column, path: Column, labels: int, folders: int) -> Column:
    """Suffixes of host of up to so many labels, each with the empty path and the first folders of path."""
    names, parts = F.split(host, r"\."), F.split(path, "/")
    n = F.least(F.size(names), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), "."))
    slashes = F.least(F.size(parts) - 1, F.lit(folders))
    deep = F.transform(F.sequence(F.lit(0), slashes), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(deep, lambda p: F.concat(h, p))))


def _rules(rules: DataFrame) -> DataFrame:
    """One row for each host and path, with the digest of its host and the path's folders."""
    host, path = ascii_lower(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    r = rules.where("host is not null and host <> ''").select(F.col("verdict").alias("rule_verdict"), host.alias("rule_host"), path.alias("rule_path"))
    r = r.groupBy("rule_host", "rule_path").agg(F.max(F.col("rule_verdict")).alias("rule_verdict"))
    folder = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 1)
    return r.withColumn("rule_digest", F.sha2(F.concat("rule_host", folder), 256)).withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_HEX))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each page; rules: verdict, host, path; default where none fits."""
    key = F.coalesce(F.col("url"), F.lit(""))
    pages = pages.select("page_id", key.alias("url"))
    rules = _rules(rules)
    depth = rules.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.size(F.split("rule_path", "/")) - 1)).first()
    urls = pages.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    # No expression with more labels or folders than any rule has can fit one.
    tried = urls.select("url", "path", F.explode(expressions(F.col("host"), F.col("path"), depth[0] or 1, depth[1] or 0)).alias("tried"))
    tried = tried.select("url", "path", F.sha2("tried", 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    met = join_small(tried, rules, F.col("prefix") == F.col("rule_prefix"), F.col("url"), "inner")
    met = met.where((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = met.groupBy(F.col("url").alias("met_url")).agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    return pages.join(best, F.col("url") == F.col("met_url"), "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.sql("select * from values " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules) + " as t(verdict, host, path)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), rule_table(spark))


SQL = f"""
with rules(verdict, rh, rp) as (values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host,
             regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path from pages)
select page_id, host, path,
  (select max_by(rh || rp, length(rh || rp)) from rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as rule,
  coalesce((select max_by(verdict, length(rh || rp)) from rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)), 'allow') as verdict
from u
"""
