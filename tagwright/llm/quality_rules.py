"""Operator 3 - quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and gives the measurements
and one ``failed_bits`` long (bit i set: rule i failed); ``store`` writes it. A policy is a named,
versioned mask over those bits; ``apply_policy`` and ``ablations`` work on the
stored bits alone, so trying another policy never touches the text again.

Only built-in expressions are used: no Python runs on the executors and the
ledger is a narrow pass over the input, without any shuffle.

Defined cases: a NULL or empty text has no words and fails ``few_words``; a
text of a single very long word fails ``word_length`` as well; repeated rows are
judged independently; an empty table gives an empty ledger; clashing extra
columns of the input are ignored, as only doc_id and text are read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh_path, words_of


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a changed rule gets a new bit, so stored ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "2 * n_symbols > 3 * n_words"),
    Rule(3, "word_length", "word_chars < 2 * n_words OR word_chars > 30 * n_words"),
    Rule(4, "duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
)
#: Policies by version: the mask of the rules that reject a document.
POLICIES = {
    "base-1": 0b00011,
    "strict-1": 0b11111,
}
BASE_MASK = POLICIES["base-1"]
DEFAULT_POLICY = "strict-1"


def _repeat_words(words: str) -> list[tuple[str, str]]:
    """Named steps that count the words inside 3-word windows found twice or more in the text.

    Candidates come from one primitive sort of (32 hash bits, position) longs;
    only windows that share those bits are compared as strings, so the count is
    exact whatever the hash does.
    """
    return [
        ("_p", f"""CASE WHEN size({words}) >= 3 THEN transform(sequence(0, size({words}) - 3),
              i -> (xxhash64(get({words}, i), get({words}, i + 1), get({words}, i + 2)) & -4294967296L) | cast(i AS BIGINT))
              ELSE cast(array() AS ARRAY<BIGINT>) END"""),
        ("_s", "sort_array(_p)"),
        ("_c", """filter(_s, (x, i) -> shiftright(x, 32) = shiftright(get(_s, i + 1), 32)
                                     OR shiftright(x, 32) = shiftright(get(_s, i - 1), 32))"""),
        ("_g", f"""sort_array(transform(_c, x -> named_struct(
              'g', concat_ws(' ', get({words}, cast(x & 4294967295L AS INT)), get({words}, cast(x & 4294967295L AS INT) + 1),
                             get({words}, cast(x & 4294967295L AS INT) + 2)),
              'p', cast(x & 4294967295L AS INT))))"""),
        ("_f", """transform(filter(_g, (x, i) -> x.g = get(_g, i + 1).g OR x.g = get(_g, i - 1).g), x -> x.p)"""),
        ("n_repeat_words", "cast(size(array_distinct(flatten(transform(_f, p -> array(p, p + 1, p + 2))))) AS BIGINT)"),
    ]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        "doc_id",
        words_of(F.col("text")).alias("_w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
    )
    out = out.select(
        "doc_id", "_w", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    for name, sql in _repeat_words("_w"):
        out = out.withColumn(name, F.expr(sql))
    return out.select("doc_id", *MEASURES)


def failed_bits(rules=RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: doc_id, the measurements, failed_bits."""
    return measures(docs).withColumn("failed_bits", failed_bits(rules))


def store(docs: DataFrame, path: str | None = None, rules=RULES) -> DataFrame:
    """The ledger, written to ``path`` (a fresh shared table if there is none) and read back from there."""
    path = path or fresh_path(docs.sparkSession, "rule-ledger")
    led = ledger(docs, rules)
    led.write.parquet(path)
    return docs.sparkSession.read.schema(led.schema).parquet(path)


def apply_policy(ledger_df: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``kept`` and ``policy`` to a ledger."""
    hit = F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long"))
    return ledger_df.withColumn("kept", hit == 0).withColumn("policy", F.lit(policy))


def ablations(ledger_df: DataFrame, policy: str = DEFAULT_POLICY, rules=RULES) -> DataFrame:
    """Per rule of the policy: documents failing it, failing only it, and kept if it were dropped.

    The ledger is first counted by bit pattern (at most 2**rules rows), so the
    ablation of any number of policies costs one small aggregation.
    """
    mask = POLICIES[policy]
    patterns = ledger_df.groupBy("failed_bits").agg(F.count("*").alias("n"))
    used = [r for r in rules if mask >> r.bit & 1]
    per = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in used]))
    bits, whole = F.col("failed_bits"), F.lit(mask).cast("long")
    rest = whole.bitwiseXOR(F.col("r.bit"))
    return (
        patterns.select("failed_bits", "n", per.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(bits.bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(bits.bitwiseAND(whole) == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(bits.bitwiseAND(rest) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def query(spark, sf_dir):
    from .common import table

    led = apply_policy(store(table(spark, sf_dir, "documents")))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(BASE_MASK).cast("long")) != 0).alias("base_failed"),
        "kept", "n_lines", "failed_bits",
    )


def ablation_query(spark, sf_dir):
    """What each rule of every policy rejects, alone and with others, all from one stored ledger."""
    from .common import table

    led = store(table(spark, sf_dir, "documents"))
    return functools.reduce(DataFrame.unionByName, (ablations(led, p).withColumn("policy", F.lit(p)) for p in POLICIES))


#: The measurements in DuckDB SQL, as a common table ``m`` over ``docs``.
def measures_sql(docs: str) -> str:
    return rf"""
    w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
          FROM {docs}),
    tri AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
            FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
    cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid),
    m AS (SELECT w.rid, doc_id, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
                 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN cov USING (rid)),
    q AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
                 (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                  + CASE WHEN 2 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
                  + CASE WHEN word_chars < 2 * n_words OR word_chars > 30 * n_words THEN 8 ELSE 0 END
                  + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 16 ELSE 0 END)::BIGINT AS failed_bits
          FROM m)"""


ORACLE_SQL = f"""WITH {measures_sql('documents')}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       failed_bits = 0 AS kept, n_lines, failed_bits FROM q"""
ABLATION_SQL = f"""WITH {measures_sql('documents')},
r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('word_length', 8), ('duplicate_lines', 16)),
p(policy, mask) AS (VALUES ('base-1', 3), ('strict-1', 31))
SELECT policy, rule, count(CASE WHEN failed_bits & bit <> 0 THEN 1 END) AS n_failed, count(CASE WHEN failed_bits & mask = bit THEN 1 END) AS n_failed_alone,
       count(CASE WHEN failed_bits & (mask - bit) = 0 THEN 1 END) AS n_kept_without FROM q, r, p WHERE mask & bit <> 0 GROUP BY policy, rule"""


def kept_rows(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, all columns: one narrow pass that needs no key."""
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc_id"), docs["text"])
    # the filter stays above a non-deterministic column: pushed down, it would repeat the measurements inside lambdas
    led = measures(inner).withColumn("_part", F.spark_partition_id()).withColumn("failed_bits", failed_bits())
    return apply_policy(led, policy).filter(F.col("kept") & (F.col("_part") >= 0)).select("doc_id.*")
