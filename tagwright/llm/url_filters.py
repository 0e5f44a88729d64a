"""Operator 2 - URL filters by hashed host-suffix / path-prefix expressions.

Every URL is expanded into (host suffix x path prefix) expressions, each hashed
with SHA-256; the first 32 bits of the digest are the equi-join key against the
rule list, then the full digest is confirmed and the longest rule wins. Only
suffixes with a label count, and prefixes with a length, that occur among the
rules are generated: no other expression can equal a rule.

Distinct (host, path) pairs are judged once, so one hot URL costs one row. The
rule side is broadcast only while its counted rows stay within
``BROADCAST_RULES``; beyond that both sides are shuffled on the hash prefix,
salted so that an expression shared by most URLs does not land in one task.

Precedence: longest rule string; on equal length the longer host, then block
before allow. Defined cases: NULL or ``://``-less URLs have empty host and path
and match no rule, as every rule has a host; repeated rows are all returned; an empty rule list or table
works; only page_id and url are read, so clashing extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query: (host, path, action).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Rules up to this count (about 100 bytes each) are broadcast.
BROADCAST_RULES = 100_000
SALTS = 16


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def parse(url):
    """(host, path) columns of a URL column."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def _keyed(df: DataFrame, expression: str) -> DataFrame:
    digest = F.sha2(F.col(expression), 256)
    return df.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages(page_id, url)``."""
    rules = (
        rules.select("host", "path", "action")
        .groupBy("host", "path").agg(F.max("action").alias("action"))  # 'block' > 'allow'
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("rank", F.struct(F.length("rule").alias("l"), F.length("host").alias("h"), F.col("action").alias("a")))
    )
    shape = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths"), F.count("*").alias("n")
    ).first()  # distinct shapes and a count: small whatever the rule list
    labels, lengths = sorted(shape["labels"]) or [0], sorted(shape["lengths"]) or [0]

    host, path = parse(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    named = urls.filter("host <> ''")  # the others match no rule, and would meet under one key
    distinct = named.groupBy("host", "path").agg(F.lit(1).alias("_"))
    parts = F.split("host", r"\.")
    suffixes = F.expr(
        f"transform(filter(array({', '.join(map(str, labels))}), n -> n <= size(_h)), n -> array_join(slice(_h, size(_h) - n + 1, n), '.'))"
    )
    prefixes = F.expr(f"transform(filter(array({', '.join(map(str, lengths))}), n -> n <= length(path)), n -> substring(path, 1, n))")
    expanded = (
        distinct.withColumn("_h", parts)
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("expression", F.explode(F.transform(prefixes, lambda p: F.concat("suffix", p))))
    )
    expanded = _keyed(expanded.select("host", "path", "expression"), "expression")
    keyed = _keyed(rules, "rule").select("short", F.col("digest").alias("rule_digest"), "rule", "rank")
    if shape["n"] <= BROADCAST_RULES:
        hits = expanded.join(F.broadcast(keyed), "short")
    else:
        salted = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
        hits = expanded.withColumn("salt", own).join(salted, ["short", "salt"])
    best = (
        hits.filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path").agg(F.max(F.struct("rank", "rule")).alias("b"))
        .select("host", "path", F.col("b.rule").alias("rule"), F.col("b.rank.a").alias("action"))
    )
    judged = named.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", "action")
    judged = judged.unionByName(urls.filter("host = ''"), allowMissingColumns=True)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark))


ORACLE_SQL = r"""
WITH r(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
       ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT row_number() OVER () AS rid, page_id,
             translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.rid, r.host || r.path AS rule, r.action,
             row_number() OVER (PARTITION BY p.rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.action DESC) AS k
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM p LEFT JOIN m ON p.rid = m.rid AND m.k = 1"""
